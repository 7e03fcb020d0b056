"""Semiring laws and explanations of each quantifier."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from veracord import Field, Schema, Session, bool_and, bool_or, col, count_if, proportion
from veracord.functions.provenance import ONE, ZERO, Prov

FLAGS = Schema((Field("id", int), Field("f", bool)), ("id",))
polynomials = st.lists(st.sets(st.integers(0, 5), max_size=3), max_size=4).map(lambda ms: Prov([{("t", x) for x in m} for m in ms]))


@given(polynomials, polynomials, polynomials)
@settings(max_examples=150, deadline=None)
def test_laws(a, b, c):
    assert a + b == b + a and a * b == b * a
    assert a + (b + c) == (a + b) + c and a * (b * c) == (a * b) * c
    assert a * (b + c) == a * b + a * c
    assert a + a == a and a * a == a and a + a * b == a
    assert a + ZERO == a and a * ONE == a and a * ZERO == ZERO and a + ONE == ONE


def t(i, sign=True, p="f"):
    return Prov.token((i,), p, sign)


def explained(spark, flags, agg, check, minimal=False):
    s = Session(spark)
    s = s.enable_minimal_provenance() if minimal else s
    r = s.read_rows([(i + 1, f) for i, f in enumerate(flags)], FLAGS).aggregate([agg.alias("x")]).check(check).collect()
    return r.verdict, r.provenance(str(check))


CASES = [
    (bool_or(col("f")), col("x"), "FTFT", True, t(2) + t(4), t(2)),
    (bool_or(col("f")), col("x"), "FF", False, t(1, False) * t(2, False), None),
    (bool_and(col("f")), col("x"), "TT", True, t(1) * t(2), None),
    (bool_and(col("f")), col("x"), "FTF", False, t(1, False) + t(3, False), t(1, False)),
    (count_if(col("f")), col("x") > 1, "TTFT", True, t(1) * t(2) + t(1) * t(4) + t(2) * t(4), t(1) * t(2)),
    (count_if(col("f")), col("x") >= 2, "TFT", True, t(1) * t(3), None),
    (count_if(col("f")), col("x") > 2, "TFT", False, t(1) * t(2, False) * t(3), None),
    (count_if(col("f")), col("x") < 2, "TFT", False, t(1) * t(3), None),
    (count_if(col("f")), col("x").eq(2), "TFT", True, t(1) * t(2, False) * t(3), None),
    (count_if(col("f")), col("x") >= 0, "TF", True, ONE, None),
    (proportion(col("f")), col("x") >= 0.5, "TFTF", True, t(1) * t(3), None),
    (proportion(col("f")), col("x") <= 0.25, "TFTF", False, t(1) * t(3), None),
    (proportion(col("f")), col("x") >= 0.0, "", True, ONE, None),
]


@pytest.mark.parametrize("agg,check,flags,verdict,full,minimal", CASES)
def test_quantifiers(spark, agg, check, flags, verdict, full, minimal):
    flags = [c == "T" for c in flags]
    assert explained(spark, flags, agg, check) == (verdict, full)
    if minimal is not None:
        assert explained(spark, flags, agg, check, True) == (verdict, minimal)


def test_threshold_is_not_upset_by_rounding(spark):
    verdict, why = explained(spark, [i < 7 for i in range(100)], proportion(col("f")), col("x") >= 0.07, True)
    assert verdict and len(why.tokens) == 7


GROUPS = Schema((Field("id", int), Field("g", str), Field("f", bool)), ("id",))


def test_nested_and_rank(spark):
    data = [(20, "north", True), (21, "south", True), (22, "south", True), (23, "south", True), (24, "west", False), (25, "north", False)]
    counts = Session(spark).read_rows(data, GROUPS).aggregate([count_if(col("f")).alias("n")], [col("g")])
    r = counts.aggregate([bool_or(col("n") > 2).alias("x")]).check(col("x")).collect()
    assert r.provenance("x") == t(21) * t(22) * t(23)
    some = t(20) + t(21) + t(22) + t(23)
    assert counts.aggregate([bool_or(col("n") > 0).alias("x")]).check(col("x")).collect().provenance("x") == some
    ranks = counts.with_rank(col("n"))
    assert [(r.values[0], r.values[-1]) for r in ranks.collect().rows] == [("south", 1), ("north", 2), ("west", 3)]
    for g, rank, verdict in (("south", 1, True), ("north", 2, True), ("west", 2, False)):
        r = ranks.filter(col("g").eq(g)).check(col("rank").eq(rank)).collect()
        assert r.verdict == verdict
        assert {x for m in r.provenance(f"rank == {rank}").monomials for x in m} <= {next(iter(t(i, f).tokens)) for i, _, f in data}


def test_logic(spark):
    data = [(1, "only", True), (2, "only", False)]
    two = Session(spark).read_rows(data, GROUPS).aggregate([bool_or(col("f")).alias("o"), bool_and(col("f")).alias("a")])
    assert two.check(col("o") | col("a")).collect().provenance("o | a") == t(1)
    assert two.check(col("o") & col("a")).collect().provenance("o & a") == t(2, False)


def test_tokens_are_valid_or_not(spark):
    f = Session(spark).read_rows([(1, True), (2, False)], FLAGS)
    tokens = [*t(1).tokens, *t(2).tokens, *t(2, False).tokens, *t(9).tokens]
    assert f.evaluate_tokens(tokens, {"f": col("f")}) == [True, False, True, False]
    assert f.count_valid_tokens(tokens, {"f": col("f")}) == 2


def test_large_product():
    p = ONE
    big = Prov([{("t", i) for i in range(10_000)}])
    assert (p * big).tokens == big.tokens
    assert len(Prov([{("t", i)} for i in range(10_000)]).monomials) == 10_000


BOUNDED = [
    (count_if(col("f")), col("x") >= 2, "FTFTFTFTFT", t(2) * t(4)),
    (count_if(col("f")), col("x") > 2, "FTFTFTFTFT", t(2) * t(4) * t(6)),
    (count_if(col("f")), col("x") < 2, "FTFTFTFTFT", t(2) * t(4)),
    (count_if(col("f")), (col("x") >= 1) & (col("x") >= 3), "FTFTFTFTFT", t(2) * t(4) * t(6)),
    (count_if(col("f")), col("x") >= 6, "FTFTF", t(1, False) * t(2) * t(3, False) * t(4) * t(5, False)),
    (proportion(col("f")), col("x") > 0.2, "FTFTFTFTFT", t(2) * t(4) * t(6)),
    (bool_or(col("f")), col("x"), "FTFTFTFTFT", t(2)),
    (bool_and(col("f")), col("x"), "FTFTFTFTFT", t(1, False)),
]


@pytest.mark.parametrize("agg,check,flags,why", BOUNDED)
def test_minimal_explanations_bring_their_own_rows_only(spark, agg, check, flags, why):
    from veracord.plans.lower import lower

    s = Session(spark).enable_minimal_provenance()
    f = s.read_rows([(i + 1, c == "T") for i, c in enumerate(flags)], FLAGS).aggregate([agg.alias("x")]).check(check)
    text = lower(f.optimized_logical_plan(), f._context()).df.head()[f"__p_{check}"]
    got = f.collect().provenance(str(check))
    assert got == why
    assert len(set(re.findall(r'"t":\[\[(\d+)', text))) == len(got.tokens)


def test_minimal_explanations_of_groups(spark):
    data = [(i, "mxq"[i % 3] if i % 10 else None, i % 4 == 0) for i in range(90)]
    n = Session(spark).enable_minimal_provenance().read_rows(data, GROUPS).aggregate([count_if(col("f")).alias("n"), bool_and(col("f")).alias("a")], [col("g")])
    many = n.check(col("n") >= 5)
    for r in many.collect().rows:
        true = [i for i, g, f in data if g == r.values[0] and f]
        assert r.values[1] == (len(true) >= 5)
        own = {next(iter(t(i, f).tokens)) for i, g, f in data if g == r.values[0]}
        assert r.provenance["n >= 5"].tokens == ({next(iter(t(i).tokens)) for i in true[:5]} if r.values[1] else own)
    # a group's rows are not gathered where five of them are the explanation
    sides = lambda f: [len(r["__pos_n"]) + len(r["__neg_n"]) for r in _lowered(f).df.where("n >= 5").collect()]
    assert set(sides(many)) == {5}


def _lowered(check):
    from veracord.plans.lower import lower

    return lower(check.optimized_logical_plan().input, check._context())
