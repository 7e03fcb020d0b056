"""Aggregates of experiment results: cost, ablations, summaries, the efficient frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cost(df: DataFrame, prices: DataFrame, model: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """``df`` with ``cost``: tokens times the list price per million. ``prices``: one row per model."""
    priced = df.join(prices, model, "left")
    return priced.withColumn("cost", (F.col(tokens_in) * F.col("price_in") + F.col(tokens_out) * F.col("price_out")) / 1e6).drop("price_in", "price_out")


def trial_summary(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean, least and greatest of a value over trials."""
    return df.groupBy(*by).agg(F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("greatest"), F.count(value).alias("trials"))


def micro_average(df: DataFrame, operator: str, by: list[str]) -> DataFrame:
    """Pooled counts: each operator once, then sums of tp, fp and fn, then the ratios."""
    once = df.dropDuplicates([*by, operator]).groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return once.select(*by, ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"))


def ablation(df: DataFrame, claim: str, variant: str, base: str, value: str, variants: list[str]) -> DataFrame:
    """A row per claim, a column per variant: its mean minus the base variant's."""
    wide = df.groupBy(claim).pivot(variant, [base, *variants]).agg(F.avg(value))
    return wide.select(claim, *((F.col(f"`{v}`") - F.col(f"`{base}`")).alias(f"delta_{v}") for v in variants))


def geometric_mean_ratio(df: DataFrame, by: list[str], numerator: Column, denominator: Column) -> DataFrame:
    return df.groupBy(*by).agg(F.exp(F.avg(F.log(numerator / denominator))).alias("multiplier"))


def two_level_mean(df: DataFrame, outer: list[str], inner: str, value: str) -> DataFrame:
    """Mean over groups of the groups' means, and the sample deviation of those."""
    means = df.groupBy(*outer, inner).agg(F.avg(value).alias("m"))
    return means.groupBy(*outer).agg(F.avg("m").alias("mean"), F.stddev_samp("m").alias("deviation"))


def correctness_matrix(df: DataFrame, claim: str, system: str, correct: Column, systems: list[str]) -> DataFrame:
    """Share and number of correct verdicts, a row per claim, columns per system."""
    return df.withColumn("__c", correct.cast("double")).groupBy(claim).pivot(system, systems).agg(F.avg("__c").alias("share"), F.sum("__c").alias("correct"))


def frontier(df: DataFrame, cheap: str, good: str) -> DataFrame:
    """Rows that no other row beats: as cheap and better, or cheaper and as good.

    One pass over the rows in order of cost with a running best, so no pair is formed.
    """
    from pyspark.sql import Window

    best = df.groupBy(cheap).agg(F.max(good).alias("__g"))
    before = Window.orderBy(cheap).rowsBetween(Window.unboundedPreceding, -1)
    kept = best.withColumn("__b", F.max("__g").over(before)).where(F.col("__b").isNull() | (F.col("__g") > F.col("__b")))
    return df.join(kept.select(cheap, "__g"), cheap).where(F.col(good) == F.col("__g")).drop("__g")
