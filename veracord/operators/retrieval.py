"""Hybrid retrieval: reciprocal-rank fusion of keyword hits and embedding similarity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracord.functions.vectors import dot, vector
from veracord.sources.tables import numbered

K = 60


def keyword_hits(text: Column, keywords: Sequence[str]) -> Column:
    """How many keywords occur in the text, as substrings without regard to case, each once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for k in keywords:
        total = total + F.contains(low, F.lit(k.lower())).cast("int")
    return total


def dense_ranks(df: DataFrame, scores: dict[str, tuple[Column, bool, bool]]) -> DataFrame:
    """``df`` with a dense rank column for each score (name: score, descending, few).

    Distinct scores are ranked and joined back, so that rows never meet in one task. Scores of
    ``few`` values are broadcast: dealt by value, most rows would go to one task. Others are ranged
    over tasks, as they may be as many as rows; their table has two numbers a row.
    """
    base = df
    for name, (score, descending, few) in scores.items():
        df = df.withColumn("__s", score)
        order = F.desc("__s") if descending else F.asc("__s")
        distinct = base.select(score.alias("__s")).distinct()
        ranks = F.broadcast(distinct.withColumn(name, F.dense_rank().over(Window.orderBy(order)))) if few else numbered(distinct, [order], [], name)
        ranks = ranks.withColumnRenamed("__s", "__r")
        df = df.join(ranks, F.col("__s").eqNullSafe(F.col("__r"))).drop("__s", "__r")
    return df


def rrf_score(df: DataFrame, text: str, embedding: str | None, query: Sequence[float], include: Sequence[str], exclude: Sequence[str], name: str = "score", digits: int | None = None) -> DataFrame:
    """Sum of ``1 / (60 + rank)`` over three dense ranks: wanted keywords (most first), unwanted
    keywords (fewest first), similarity to the query vector (greatest first)."""
    similarity = dot(F.col(embedding), vector(query)) if embedding else F.lit(0.0)
    if digits is not None:
        similarity = F.round(similarity, digits)
    ranked = dense_ranks(df, {"__r1": (keyword_hits(F.col(text), include), True, True), "__r2": (keyword_hits(F.col(text), exclude), False, True), "__r3": (similarity, True, not embedding)})
    score = 1 / (K + F.col("__r1")) + 1 / (K + F.col("__r2")) + 1 / (K + F.col("__r3"))
    return ranked.withColumn(name, score).drop("__r1", "__r2", "__r3")


def retrieve(df: DataFrame, key: str, text: str, embedding: str | None, query: Sequence[float], include: Sequence[str], exclude: Sequence[str], filters: dict[str, object], k: int, offset: int = 0) -> DataFrame:
    """The ``k`` best rows behind ``offset`` among those that meet the equality filters."""
    for c, v in filters.items():
        df = df.where(F.col(c) == F.lit(v))
    best = rrf_score(df, text, embedding, query, include, exclude).orderBy(F.desc("score"), F.col(key))
    return best.offset(offset).limit(k)


def threshold_sweep(df: DataFrame, similarity: Column, truth: Column, thresholds: Sequence[float]) -> DataFrame:
    """threshold, selected, true_positives: what a similarity filter would keep at each threshold."""
    at = F.explode(F.array(*(F.lit(float(t)) for t in thresholds))).alias("threshold")
    rows = df.select(similarity.alias("__s"), truth.alias("__t"), at)
    hit = F.col("__s") >= F.col("threshold")
    return rows.groupBy("threshold").agg(F.count_if(hit).alias("selected"), F.count_if(hit & F.col("__t")).alias("true_positives"))


def explode_sentences(df: DataFrame, text: str, *keep: str) -> DataFrame:
    """One row for each sentence of a text, with its place; a text without one gives none."""
    parts = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s) != "")
    return df.select(*keep, F.posexplode(parts).alias("at", "sentence"))


def within_budget(df: DataFrame, order: Sequence[str], tokens: Column, budget: int, by: Sequence[str] = ()) -> DataFrame:
    """Rows in order until their tokens together pass the budget."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("__sum", F.sum(tokens).over(w)).where(F.col("__sum") <= budget).drop("__sum")
