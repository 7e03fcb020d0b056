"""Early stopping and estimation: same verdicts, fewer prompts."""

import random

import pytest
from pyspark.sql import functions as F

from veracord import Field, Schema, Session, bool_and, bool_or, col, count_if, prompt, proportion
from veracord.functions.confseq import BettingSequence, estimate_mean, spend, split_budget
from veracord.functions.intervals import Interval
from veracord.models.language import RuleModel
from veracord.operators.dialogs import thread_roots
from veracord.plans.waves import Accumulator, settled
from veracord.sources.tables import numbered

MODEL = RuleModel({"yes in {word}": ("contains", "word", ("yes",))})
WORDS = Schema((Field("id", int), Field("group", str), Field("word", str)), ("id",))


def words(n, share, seed=1):
    return [(i, "AB"[i % 2], "yes" if random.Random(f"{seed}{i}").random() < share else "no") for i in range(n)]


def session(spark, **on):
    s = Session(spark).register_model(MODEL).enable_batching(8).enable_minimal_provenance()
    for k, v in on.items():
        getattr(s, k)(**v)
    return s


@pytest.mark.parametrize("agg,check,share", [
    (bool_or(col("a")), col("x"), 0.3), (bool_or(col("a")), col("x"), 0.0), (bool_and(col("a")), col("x"), 0.7), (bool_and(col("a")), col("x"), 1.0),
    (count_if(col("a")), col("x") >= 5, 0.4), (count_if(col("a")), col("x") < 5, 0.4), (count_if(col("a")), col("x").eq(7), 0.5),
    (proportion(col("a")), col("x") > 0.6, 0.3), (proportion(col("a")), col("x") <= 0.6, 0.3),
])
def test_stopping_keeps_the_verdict(spark, agg, check, share):
    data = words(90, share)
    exact, early = ([s.read_rows(data, WORDS).map(prompt("yes in {word}").alias("a")).aggregate([agg.alias("x")]).check(check).collect() for s in (session(spark), session(spark, enable_early_stop={}))])
    assert exact.verdict == early.verdict
    assert early.metrics.rows_seen <= 90


def test_groups_stop_each_for_itself_and_feed_the_outer_quantifier(spark):
    data = [(i, "A" if i < 60 else "B", "yes" if i < 60 else "no") for i in range(120)]
    f = session(spark, enable_early_stop={}).read_rows(data, WORDS).map(prompt("yes in {word}").alias("a"))
    f = f.aggregate([count_if(col("a")).alias("n")], [col("group")]).aggregate([bool_or(col("n") >= 3).alias("x")]).check(col("x"))
    r = f.collect()
    assert r.verdict and len(r.provenance("x").tokens) == 3
    assert r.metrics.rows_seen < 120


def test_estimation_needs_few_rows_and_errs_rarely(spark):
    s = session(spark, enable_estimation={"seed": 3})
    r = s.read_rows(words(2000, 0.9), WORDS).map(prompt("yes in {word}").alias("a")).aggregate([proportion(col("a")).alias("p")]).check(col("p") >= 0.5).collect()
    assert r.verdict and r.metrics.rows_seen < 200


def test_relevant_rows_first(spark):
    s = session(spark, enable_relevance_sort={})
    data = [(i, "A", "yes" if i == 77 else "no") for i in range(100)]
    f = s.read_rows(data, WORDS).map(prompt("yes in {word}").alias("a")).aggregate([bool_or(col("a")).alias("x")]).check(col("x"))
    assert [n.split("(")[0] for n in f.optimized_logical_plan().display().split() if n[0].isupper()] == ["Check", "Aggregate", "Project", "RelevanceSort", "CountScan", "Scan"]
    r = f.collect()
    assert r.verdict and r.metrics.rows_seen == 8


def test_plan_shapes(spark):
    shape = lambda f: [n.split("(")[0] for n in f.optimized_logical_plan().display().split() if n[0].isupper() and n != "B'"]
    s = session(spark, enable_estimation={}, enable_relevance_sort={})
    base = s.read_rows([], WORDS).map(prompt("yes in {word}").alias("a"))
    assert shape(base.aggregate([proportion(col("a")).alias("p")]).check(col("p") > 0.5)) == ["Check", "Aggregate", "Project", "Shuffle", "CountScan", "Scan"]
    grouped = base.aggregate([bool_or(col("a")).alias("x")], [col("group")]).check(col("x"))
    assert shape(grouped) == ["Check", "Aggregate", "Project", "Shuffle", "Sort", "RelevanceSort", "Scan"]


def test_confidence_sequence_covers():
    random.seed(5)
    missed = 0
    for _ in range(60):
        cs = BettingSequence(0.9)
        bad = False
        for _ in range(150):
            cs.update(float(random.random() < 0.35))
            low, high = cs.interval()
            bad |= not low <= 0.35 <= high
        missed += bad
    assert missed <= 6


def test_whole_population_gives_its_mean():
    seen = [k * k % 7 < 3 for k in range(23)]
    low, high = estimate_mean(seen, 0.9, len(seen))
    assert low == high == pytest.approx(sum(seen) / len(seen))
    low, high = estimate_mean(seen, 0.9)
    assert 0 <= low < sum(seen) / len(seen) < high <= 1


@pytest.mark.parametrize("level", [0.8, 0.99])
@pytest.mark.parametrize("parts", [1, 3, 8])
def test_budget(level, parts):
    assert parts * (1 - split_budget(level, parts)) == pytest.approx(1 - level)
    spent = sum(parts * (1 - spend(level, parts, g)) for g in range(40))
    assert spent == pytest.approx(1 - level) and 1 - spend(level, parts, 3) == pytest.approx((1 - spend(level, parts, 2)) / 2)


def test_rows_are_numbered_by_group_and_order(spark):
    rng = random.Random(4)
    data = [(i, "hot" if rng.random() < 0.7 else rng.choice([None, "a", "b"]), rng.random()) for i in range(600)]
    df = spark.createDataFrame(data, "id long, g string, x double").repartition(5)
    for groups in ([], ["g"]):
        got = {r.id: r.place for r in numbered(df, [F.desc("x"), F.col("id")], groups, "place").collect()}
        order = sorted(data, key=lambda r: (-r[2], r[0]))
        for g in {r[1] for r in data} if groups else [...]:
            mine = [r[0] for r in order if g is ... or r[1] == g]
            assert [got[i] for i in mine] == list(range(1, len(mine) + 1))
    assert numbered(df.limit(0), [F.col("id")], ["g"], "place").count() == 0


def test_waves_have_no_window_over_all_rows(spark):
    s = session(spark, enable_early_stop={}).disable_provenance()
    f = s.read_rows(words(90, 0.3), WORDS).map(prompt("yes in {word}").alias("a")).aggregate([count_if(col("a")).alias("x")]).check(col("x") >= 5)
    r = f.collect()
    assert r.verdict and r.metrics.rows_seen < 90


def test_roots_of_long_threads_and_circles(spark):
    chain = [(i, i - 1 if i else None) for i in range(45)] + [(100, 99), (101, 100), (102, 100)]
    table = spark.createDataFrame(chain, "m long, p long")
    got = {r.m: (r.root, r.depth) for r in thread_roots(table, "m", "p").collect()}
    assert got == {i: (0, i) for i in range(45)} | {100: (100, 0), 101: (100, 1), 102: (100, 1)}
    with pytest.raises(ValueError, match="circle"):
        thread_roots(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, None)], "m long, p long"), "m", "p")


def test_interval_comparisons():
    x = Interval(0.4, 0.5, 0.95, 0.05)
    assert x.satisfies(">", 0.3) and not x.satisfies(">", 0.45) and not x.satisfies("==", 0.45) and not x.satisfies("!=", 0.45)
    assert x.satisfies("!=", 0.9) and (x * 10).upper == 5.0 and 0.45 in x and x.intersects(Interval(0.5, 1))
    with pytest.raises(ValueError):
        x * -1


@pytest.mark.parametrize("op", ["<", "<=", ">", ">=", "==", "!="])
def test_settled_means_settled(op):
    value = {"<": lambda v, t: v < t, "<=": lambda v, t: v <= t, ">": lambda v, t: v > t, ">=": lambda v, t: v >= t, "==": lambda v, t: v == t, "!=": lambda v, t: v != t}[op]
    for low in range(5):
        for high in range(low, 6):
            for t in range(-1, 7):
                if settled(op, t, low, high):
                    assert len({value(v, t) for v in range(low, high + 1)}) == 1


def test_accumulator_reports_what_it_saw():
    a = Accumulator("count_if", (">=", 2), 10)
    for v in (True, False, True):
        assert not a.decided()
        a.update(v)
    assert a.decided() and a.value() == 2
