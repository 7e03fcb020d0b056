"""Frames: schemas, rows, naming, quantifiers, rank."""

from enum import Enum

import pytest

from veracord import Field, Row, Schema, Session, bool_and, bool_or, col, count_if, prompt, proportion
from veracord.models.language import RuleModel

BOATS = Schema((Field("hull", int), Field("harbour", str), Field("metres", int)), ("hull",))
FLEET = [(10, "Bergen", 7), (11, "Porto", 14), (12, "Gdansk", 9), (13, "Porto", 22)]
LONG = col("metres") >= 9


@pytest.fixture
def fleet(spark):
    return Session(spark).read_rows(FLEET, BOATS)


def rows(frame):
    return [r.values for r in frame.collect().rows]


def test_scan_filter_map(fleet):
    assert fleet.schema() == BOATS
    assert rows(fleet) == FLEET
    assert rows(fleet.filter(col("harbour").ne("Porto"))) == [FLEET[0], FLEET[2]]
    f = fleet.filter(LONG & ~col("harbour").eq("Gdansk")).map(col("metres") > 20)
    assert f.schema().names == ["hull", "harbour", "metres", "metres > 20"]
    assert rows(f) == [(11, "Porto", 14, False), (13, "Porto", 22, True)]
    assert [r[-1] for r in rows(fleet.map(((col("metres") < 8) | col("hull").eq(12)).alias("small")))] == [True, False, True, False]


def test_unknown_column(fleet):
    with pytest.raises(KeyError):
        fleet.filter(col("draught") < 2)


def test_names(fleet):
    assert fleet.aggregate([proportion(LONG)]).schema().names == ["_id", "proportion(metres >= 9)"]
    assert fleet.check(~LONG).schema().names == ["hull", "~metres >= 9"]


ALL_FOUR = [count_if(LONG).alias("n"), proportion(LONG).alias("p"), bool_and(LONG).alias("a"), bool_or(LONG).alias("o")]


def test_several_aggregates(fleet):
    assert rows(fleet.aggregate(ALL_FOUR)) == [("_agg", 3, 0.75, False, True)]
    assert rows(fleet.aggregate(ALL_FOUR, [col("harbour")])) == [("Bergen", 0, 0.0, False, False), ("Gdansk", 1, 1.0, True, True), ("Porto", 2, 1.0, True, True)]


def test_no_rows(fleet):
    none = fleet.filter(col("metres") > 100)
    assert rows(none.aggregate(ALL_FOUR)) == [("_agg", 0, 0.0, True, False)]
    assert rows(none.aggregate(ALL_FOUR[:1], [col("harbour")])) == []


def test_groups_come_in_key_order(spark):
    s = Schema((Field("n", int), Field("deck", str), Field("wet", bool)), ("n",))
    data = [(i, "xqmxqm"[i], i % 4 == 0) for i in range(6)]
    assert rows(Session(spark).read_rows(data, s).aggregate([count_if(col("wet")).alias("k")], [col("deck")])) == [("m", 0), ("q", 1), ("x", 1)]


def test_rank_is_dense(spark):
    s = Schema((Field("n", int), Field("points", int)), ("n",))
    f = Session(spark).read_rows(list(enumerate([4, 9, 4, 1, 9, 9])), s).with_rank(col("points"))
    assert [(r[0], r[-1]) for r in rows(f)] == [(1, 1), (4, 1), (5, 1), (0, 2), (2, 2), (3, 3)]
    assert rows(f.filter(col("n").eq(3)).check(col("rank").eq(6))) == [(3, False)]
    assert f.schema().names[-1] == "rank"


def test_enum_and_compound_check(spark):
    class Tide(Enum):
        EBB = "ebb"
        FLOOD = "flood"
        SLACK = "slack"

    s = Schema((Field("hour", int), Field("tide", Tide)), ("hour",))
    f = Session(spark).read_rows([Row((i, (Tide.EBB, Tide.FLOOD, Tide.FLOOD, Tide.SLACK)[i % 4])) for i in range(12)], s)
    assert f.collect().rows[3].values == (3, Tide.SLACK)
    shares = f.aggregate([proportion(col("tide").eq(Tide.FLOOD)).alias("up"), proportion(col("tide").eq(Tide.SLACK)).alias("still")])
    assert shares.check((col("up") >= 0.5) & (col("still") < 0.3)).collect().verdict
    assert not shares.check((col("up") > 0.5) | (col("still") > 0.3)).collect().verdict


def test_null_arguments_fail_unless_allowed(spark):
    s = Schema((Field("n", int), Field("wet", bool)), ("n",))
    data = [(7, None), (8, True), (9, True)]
    with pytest.raises(Exception, match="is null"):
        Session(spark).disable_provenance().read_rows(data, s).aggregate([count_if(col("wet")).alias("k")]).collect()
    assert rows(Session(spark).disable_provenance().allow_nulls().read_rows(data, s).aggregate([count_if(col("wet")).alias("k")])) == [("_agg", 2)]


def test_log_and_json(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"z": 1, "a": "q", "flag": true}\n{"a": "r", "z": 2, "extra": 5, "flag": false}\n{"z": 3}\n')
    s = Session(spark)
    f = s.read_json(str(tmp_path / "x.jsonl"), ("z",))
    assert f.schema().names == ["z", "a", "flag"]
    assert rows(f) == [(1, "q", True), (2, "r", False), (3, None, None)]
    f.filter(col("z") < 3).log(str(tmp_path / "log")).collect()
    again = s.read_log(str(tmp_path / "log"))
    assert again.schema().key == ("z",)
    assert [r[0] for r in rows(again)] == [1, 2]


SOUTH = {"does {harbour} lie south": ("contains", "harbour", ("porto",)), "initial of {harbour}": ("extract", "harbour", "^(.)")}


def test_prompts_fused_cached_counted(spark, tmp_path):
    s = Session(spark).register_model(RuleModel(SOUTH)).enable_fusion()
    f = s.read_rows(FLEET, BOATS).filter(prompt("does {harbour} lie south")).map(prompt("initial of {harbour}", str).alias("first"))
    assert "Fused" in f.optimized_logical_plan().display()
    assert rows(f) == [(11, "Porto", 14, "P"), (13, "Porto", 22, "P")]
    cached = Session(spark).register_model(RuleModel(SOUTH)).enable_cache(str(tmp_path / "answers"))
    frame = cached.read_rows(FLEET, BOATS).map(prompt("does {harbour} lie south").alias("s"))
    first, second = frame.collect(), frame.collect()
    assert (first.metrics.requests, first.metrics.cache_hits) == (3, 0)  # harbours that differ
    assert (second.metrics.requests, second.metrics.cache_hits) == (0, 3)
    assert [r.values for r in first.rows] == [r.values for r in second.rows]
    cached.clear_cache()
    assert frame.collect().metrics.requests == 3


def test_prompt_is_asked_once(spark):
    f = Session(spark).register_model(RuleModel(SOUTH)).disable_provenance().read_rows(FLEET, BOATS).map(prompt("does {harbour} lie south").alias("s")).filter(col("s"))
    plan = f.to_spark()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_structured_filter_goes_below_a_prompt(spark):
    f = Session(spark).read_rows(FLEET, BOATS).map(prompt("does {harbour} lie south").alias("s")).filter(col("metres") > 10)
    assert f.optimized_logical_plan().display().split() == ["Project(s)", "Filter(metres", ">", "10)", "Scan"]


def test_quality(spark):
    s = Session(spark)
    f = s.read_rows(FLEET, BOATS)
    q = f.filter(LONG).evaluate_filter(f, f.filter(col("metres") < 20))
    assert (q.true_positives, q.false_positives, q.false_negatives) == (2, 1, 1)
    assert q.precision == q.recall == q.f1 == pytest.approx(2 / 3)
    changed = s.read_rows([(h, "Oslo" if h == 12 else p, m) for h, p, m in FLEET], BOATS)
    assert f.evaluate_map(changed, ["harbour", "metres"]) == {"harbour": 0.75, "metres": 1.0}
