"""Quality rules: a fixed base rule, then a learned ordered list of threshold rules.

Features are plain DataFrame expressions over the whole text, evaluated row by row
without a shuffle. The decision list is learned by sequential covering: a rule is
grown on two thirds of the labelled rows as a conjunction of thresholds (best
information gain per step), pruned from its end on the other third (best
``(p - n) / (p + n)``), and kept while its precision on the pruning rows is at least
``min_precision``; the rows it covers are then taken out. The result is an ordered
CASE expression whose default keeps the document.

Learning asks Spark for class counts per (feature, bin) of the rows that the rule so
far covers: a few dozen aggregations of at most features x bins x 4 rows each, over
at most ``max_labelled`` labelled rows (those with the smallest keyed hash of doc_id).
Thresholds are quantiles of the labelled rows. No Python touches rows.

Defined results: null and empty texts have all statistics 0 and fail the base rule;
without labelled rows of both classes the list is empty and only the base rule
decides. Null labels are no evidence; a doc_id labelled twice is learned from twice.
Repeated documents are judged each. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracord.llm.common import WORD_SEP_CHARS, cut, words

SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
WINDOW = 5
#: Learned features, all derived from the statistics.
FEATURES = {
    "n_words": "CAST(n_words AS DOUBLE)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "symbol_share": "n_symbols / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "exclaim_share": "n_exclaim / greatest(n_words, 1)",
}


def statistics(docs: DataFrame, *carry: str) -> DataFrame:
    """doc_id, the five base statistics and what else the learned features need.

    ``n_repeat_words`` counts the words inside five-word windows that occur at least
    twice: equal windows are found by sorting (window hash, position) pairs within the
    row, and only for texts in which some window repeats at all.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    less = lambda chars: F.length(text) - F.length(F.translate(text, chars, ""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.translate(x, WORD_SEP_CHARS, "") != "")
    a = docs.select(
        "doc_id", *carry, words(F.col("text")).alias("__w"), lines.alias("__l"),
        F.length(F.translate(text, WORD_SEP_CHARS, "")).cast("long").alias("word_chars"), less(SYMBOLS).cast("long").alias("n_symbols"),
        less("0123456789").cast("long").alias("n_digits"), less("ABCDEFGHIJKLMNOPQRSTUVWXYZ").cast("long").alias("n_upper"), less("!").cast("long").alias("n_exclaim"),
    )
    b = a.select(
        *(c for c in a.columns if c not in ("__w", "__l")), F.size("__w").cast("long").alias("n_words"), F.size("__l").cast("long").alias("n_lines"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"), F.transform("__w", lambda w: F.xxhash64(w)).alias("__h"),
    )
    windows = F.when(F.size("__h") < WINDOW, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(F.size("__h") - (WINDOW - 1), F.lit(1))), lambda i: F.xxhash64(F.slice("__h", i, WINDOW)))
    )
    c = b.select(*(x for x in b.columns if x != "__h"), F.size(F.array_distinct("__h")).cast("long").alias("n_distinct_words"), windows.alias("__win"))
    repeats = F.size("__win") > F.size(F.array_distinct("__win"))
    pairs = F.when(repeats, F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    d = c.select(*(x for x in c.columns if x != "__win"), pairs.alias("__p"))
    same = lambda x, j: F.coalesce(F.get("__p", j)["h"] == x["h"], F.lit(False))
    starts = F.array_sort(F.transform(F.filter("__p", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))
    e = d.select(*(x for x in d.columns if x != "__p"), starts.alias("__s"))
    covered = F.aggregate(
        "__s", F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda acc, i: F.struct((acc["n"] + F.least(i - acc["last"], F.lit(WINDOW))).alias("n"), i.alias("last")),
    )["n"]
    return e.select("doc_id", *carry, *BASE[:4], F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"), "n_lines", "n_distinct_words", "n_digits", "n_upper", "n_exclaim")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # feature > threshold, else feature <= threshold
    threshold: float

    def sql(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    """Reject a document that meets all conditions."""

    conditions: tuple[Condition, ...]
    caught: int
    wrong: int

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -1.0


def learn(labelled: DataFrame, max_labelled: int = 20000, bins: int = 24, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_caught: int = 5) -> list[Rule]:
    """Ordered rejection rules from ``labelled``: the FEATURES columns, doc_id and boolean ``bad``."""
    rows = labelled.orderBy(F.xxhash64(F.lit("fold"), "doc_id"), "doc_id").limit(max_labelled)
    grow = F.pmod(F.xxhash64(F.lit("grow"), "doc_id"), F.lit(3)) != 0
    rows = cut(rows.select(*FEATURES, "bad", grow.alias("grow")), "quality-sample")
    at = rows.select(*(F.percentile_approx(f, [i / bins for i in range(1, bins)], 10000).alias(f) for f in FEATURES)).head()
    cuts = {f: sorted({float(v) for v in at[f] or []}) for f in FEATURES}
    if not any(cuts.values()):
        return []  # no labelled rows

    def class_counts(where: str) -> dict[tuple[str, bool], list[tuple[int, int]]]:
        """For each feature and fold, (bad, good) rows by bin: the number of thresholds below the value."""
        below = lambda f: lambda t: t < F.col(f)
        pairs = F.array(*(F.struct(F.lit(f).alias("f"), F.size(F.filter(F.array(*map(F.lit, c)), below(f))).alias("b")) for f, c in cuts.items() if c))
        got = rows.where(where).select("bad", "grow", F.explode(pairs).alias("x")).groupBy("x.f", "grow", "x.b").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()
        out = {(f, fold): [(0, 0)] * (len(c) + 1) for f, c in cuts.items() for fold in (True, False)}
        for f, fold, b, p, n in got:
            out[f, fold][b] = (p, n)
        return out

    rules: list[Rule] = []
    uncovered = "true"
    while len(rules) < max_rules:
        conditions: list[Condition] = []
        trail: list[tuple[int, int]] = []  # (caught, wrong) on the pruning rows after each condition
        while len(conditions) < max_conditions:
            counts = class_counts(" AND ".join([uncovered, *(c.sql() for c in conditions)]))
            p0, n0 = (sum(x[i] for x in next(iter(v for (_, fold), v in counts.items() if fold))) for i in (0, 1))
            if not p0 or not n0:
                break
            best: tuple[float, Condition | None, tuple[int, int]] = (0.0, None, (0, 0))
            for f, c in cuts.items():
                for i, t in enumerate(c):
                    for above in (True, False):
                        take = slice(i + 1, None) if above else slice(0, i + 1)
                        p, n = (sum(x[k] for x in counts[f, True][take]) for k in (0, 1))
                        if p >= min_caught and (g := _gain(p, n, p0, n0)) > best[0] + 1e-9:
                            best = (g, Condition(f, above, t), tuple(sum(x[k] for x in counts[f, False][take]) for k in (0, 1)))
            if best[1] is None:
                break
            conditions.append(best[1])
            trail.append(best[2])
        if not conditions:
            break
        worth = [(p - n) / (p + n) if p + n else -1.0 for p, n in trail]
        k = max(range(len(worth)), key=lambda i: (worth[i], -i))
        p, n = trail[k]
        if p < min_caught or p < min_precision * (p + n):
            break
        rules.append(Rule(tuple(conditions[: k + 1]), p, n))
        uncovered += f" AND NOT ({rules[-1].sql()})"
    return rules


def verdict(rules: list[Rule]) -> Column:
    """Ordered conditional expression: number of the first rule that fires, 0 if none does."""
    return F.expr("CASE " + " ".join(f"WHEN {r.sql()} THEN {i}" for i, r in enumerate(rules, 1)) + " ELSE 0 END") if rules else F.lit(0)


def judge(docs: DataFrame, labels: DataFrame, *carry: str, row: Column | None = None, **learning) -> DataFrame:
    """doc_id, the base statistics, base_failed, rule (0: none fired) and kept for every document.

    The model is fitted on the documents' labels (quality 0 is bad).
    """
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", (F.col("quality") == 0).alias("bad"))
    sample = known.orderBy(F.xxhash64(F.lit("fold"), "doc_id"), "doc_id").limit(learning.get("max_labelled", 20000))
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # at most max_labelled rows of two small columns
    with_features = lambda df: df.withColumns({f"__f_{k}": F.expr(v) for k, v in FEATURES.items()})
    learned = learn(with_features(statistics(texts, "bad")).select("doc_id", "bad", *(F.col(f"__f_{k}").alias(k) for k in FEATURES)), **learning)
    stats = with_features(statistics(docs, *carry)).withColumns({} if row is None else {"__row": row})
    rule = verdict([Rule(tuple(Condition(f"__f_{c.feature}", c.above, c.threshold) for c in r.conditions), r.caught, r.wrong) for r in learned])
    out = stats.select("doc_id", *carry, *BASE, base_failed().alias("base_failed"), rule.alias("rule"), *([] if row is None else ["__row"]))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def kept_documents(docs: DataFrame, labels: DataFrame, **learning) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns, whatever their names:
    they are carried as one struct.

    The row number keeps the filter where it is: moved below the statistics, it would
    have them worked out once more inside it, step by step for each of its uses.
    """
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__doc")
    judged = judge(docs.select("doc_id", "text", whole), labels, "__doc", row=F.monotonically_increasing_id(), **learning)
    return judged.where(F.col("kept") & (F.col("__row") >= 0)).select("__doc.*")


def base_oracle() -> str:
    """DuckDB SQL of doc_id, the base statistics and base_failed (the learned verdict has no SQL)."""
    sep = r"[\x20\x09-\x0D]+"
    return rf"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    w AS (SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '{sep}'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT r, i, w[i:i + 4] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
    twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1),
    rep AS (SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r)
    SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '{sep}', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(w) < 10 OR 100 * coalesce(n, 0) > 20 * len(w) AS base_failed
    FROM w LEFT JOIN rep USING (r)"""
