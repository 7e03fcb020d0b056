"""Quality of filters, maps and explanations against a reference, and agreement statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veracord.functions.intervals import wilson


@dataclass(frozen=True)
class FilterQuality:
    true_positives: int
    false_positives: int
    false_negatives: int

    @property
    def precision(self) -> float:
        n = self.true_positives + self.false_positives
        return self.true_positives / n if n else 0.0

    @property
    def recall(self) -> float:
        n = self.true_positives + self.false_negatives
        return self.true_positives / n if n else 0.0

    @property
    def f1(self) -> float:
        p, r = self.precision, self.recall
        return 2 * p * r / (p + r) if p + r else 0.0


def filter_quality(reference: DataFrame, before: DataFrame, after: DataFrame, key: list[str]) -> DataFrame:
    """One row of counts: ``after`` is what a filter kept of ``before``; ``reference`` is what it should keep.

    A reference row counts as missed only if it reached the filter.
    """
    r, b, a = (df.select(*key).distinct() for df in (reference, before, after))
    flags = b.withColumn("b", F.lit(True)).join(a.withColumn("a", F.lit(True)), key, "full").join(r.withColumn("r", F.lit(True)), key, "left")
    t = lambda c: F.coalesce(F.col(c), F.lit(False))
    return flags.agg(F.count_if(t("a") & t("r")).alias("true_positives"), F.count_if(t("a") & ~t("r")).alias("false_positives"), F.count_if(t("b") & ~t("a") & t("r")).alias("false_negatives"))


def map_quality(reference: DataFrame, after: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row: rows met, and the share of equal values for each column (null equals null)."""
    both = reference.select(*key, *(F.col(c).alias(f"__{c}") for c in columns)).join(after.select(*key, *columns), key)
    share = lambda c: F.coalesce(F.avg(F.col(c).eqNullSafe(F.col(f"__{c}")).cast("double")), F.lit(0.0)).alias(c)
    return both.agg(F.count("*").alias("rows"), *(share(c) for c in columns))


def classification_quality(df: DataFrame, truth: Column, said: Column, *by: str) -> DataFrame:
    """Precision, recall, F1 and accuracy by group; the positive class is a claim that does not hold."""
    flags = df.select(*by, (~truth).alias("t"), (~said).alias("s"))
    n = flags.groupBy(*by).agg(F.count_if(F.col("t") & F.col("s")).alias("tp"), F.count_if(~F.col("t") & F.col("s")).alias("fp"), F.count_if(F.col("t") & ~F.col("s")).alias("fn"), F.count("*").alias("n"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = (F.col(c) for c in ("tp", "fp", "fn"))
    return n.select(*by, ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(F.col("n") - fp - fn, F.col("n")).alias("accuracy"))


def agreement(df: DataFrame, a: Column, b: Column, *by: str) -> DataFrame:
    """Agreement of two boolean labellings by group: rows, share, Wilson interval, Cohen's kappa."""
    rows = df.select(*by, a.alias("a"), b.alias("b"))
    n = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("a") == F.col("b")).alias("k"), F.avg(F.col("a").cast("double")).alias("pa"), F.avg(F.col("b").cast("double")).alias("pb"))
    low, high = wilson(F.col("k"), F.col("n"))
    share = F.col("k") / F.col("n")
    chance = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    kappa = F.when(chance == 1, F.lit(1.0)).otherwise((share - chance) / F.when(chance == 1, F.lit(1.0)).otherwise(1 - chance))
    return n.select(*by, "n", share.alias("agreement"), low.alias("lower"), high.alias("upper"), kappa.alias("kappa"))


def stratified_sample(df: DataFrame, label: str, key: str, seed: str, n: int) -> DataFrame:
    """``n`` rows, round-robin over labels, by keyed md5 within a label; a larger n extends a smaller one."""
    place = F.row_number().over(Window.partitionBy(label).orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key))
    return df.withColumn("place", place).orderBy("place", label).limit(n)


def seeded_shuffle(df: DataFrame, keys: list[str], row: str, seed: str) -> DataFrame:
    """Groups in random order at each key depth, rows in random order within; md5, so any engine can repeat it."""
    order: list[Column] = []
    said = F.lit(seed)
    for k in keys:
        said = F.concat(said, F.lit("|"), F.col(k).cast("string"))
        order += [F.md5(said), F.col(k)]
    order += [F.md5(F.concat(F.lit(f"{seed}|"), F.col(row).cast("string"))), F.col(row)]
    return df.orderBy(*order)


def majority(df: DataFrame, votes: list[str], name: str = "vote") -> DataFrame:
    """Majority of several vote columns; on a tie the leader that the earliest column gave."""
    all_votes = F.array(*(F.col(v) for v in votes))
    ranked = F.transform(all_votes, lambda v, i: F.struct(F.size(F.filter(all_votes, lambda w: w == v)).alias("n"), (-i).alias("first"), v.alias("v")))
    return df.withColumn(name, F.array_max(ranked)["v"])
