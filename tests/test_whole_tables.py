from pyspark.sql import functions as F

from veracord.functions import confseq
from veracord.queries import judged_orders


def test_tokens_of_all_orders_are_judged(spark):
    orders = spark.range(500).select(F.col("id").alias("o_orderkey"), F.when(F.col("id") % 7 != 0, F.col("id") * 1000.0).alias("o_totalprice"))
    got = {r.o_orderkey: (r.holds, r.valid) for r in judged_orders(spark, orders).collect()}
    assert len(got) == 500
    for k in range(500):
        assert got[k][1] == (k % 7 != 0 and k > 100), k
        assert bool(got[k][0]) == got[k][1], k


def test_bounds_of_users_agree_with_the_class(spark):
    from veracord.queries import _user_bounds

    rows = [(i, i % 7, float(i * 37 % 101)) for i in range(400)]
    got = {r.user_id: r for r in _user_bounds(spark.createDataFrame(rows, "event_id long, user_id long, value double"), 2).collect()}
    for u in range(7):
        x = [v > 50 for i, k, v in rows if k == u]
        low, high = confseq.estimate_mean(x, 0.95, 2 * len(x))
        assert (got[u].n, got[u].lower, got[u].upper) == (len(x), round(low, 9), round(high, 9))
        assert low <= sum(x) / len(x) <= high


def test_interval_of_a_whole_population_is_its_mean():
    for n in (30, 201, 450):
        x = [i % 3 == 0 for i in range(n)]
        low, high = confseq.estimate_mean(x, 0.95, n)
        assert abs(low - sum(x) / n) < 1e-9 and abs(high - sum(x) / n) < 1e-9


def test_rows_are_not_dealt_by_a_score_of_few_values(spark):
    from veracord.operators.retrieval import rrf_score

    rows = [(i, "a license" if i % 3 else "the text!!", None if i == 7 else [float(i % 5), 1.0]) for i in range(60)]
    docs = spark.createDataFrame(rows, "id long, text string, e array<double>")
    plan = rrf_score(docs, "text", None, [1.0, 0.0], ["licens", "the"], ["!!"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == 2 and "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan  # the third score is a constant
    got = {r.id: r.score for r in rrf_score(docs, "text", "e", [1.0, 0.0], ["licens"], ["!!"]).collect()}
    assert len(got) == 60
    for i, _, e in rows:
        similar = 6 if e is None else 5 - i % 5
        first, second = (1, 1) if i % 3 else (2, 2)
        assert abs(got[i] - sum(1 / (60 + r) for r in (first, second, similar))) < 1e-12, i


def test_places_without_groups_move_rows_once(spark):
    from veracord.sources.tables import numbered

    key = "spark.sql.autoBroadcastJoinThreshold"
    spark.conf.set(key, "-1")
    try:
        df = numbered(spark.range(1000).select((F.col("id") * 7 % 1000).alias("id")), [F.desc("id")], [], "place")
        assert "SortMergeJoin" not in df._jdf.queryExecution().executedPlan().toString()
        assert all(r.place == 1000 - r.id for r in df.collect())
    finally:
        spark.conf.unset(key)


def test_a_model_gets_a_batch_in_parts(spark):
    from veracord import Session, prompt
    from veracord.models.language import LanguageModel

    class Counting(LanguageModel):
        name = "counting"

        def answer(self, requests, dtype=bool):
            return [len(requests) <= 512 and r.value("word") is not None for r in requests]

    words = spark.range(6000).coalesce(1).select("id", F.when(F.col("id") % 3001 != 0, F.concat(F.lit("w"), F.col("id") % 3000)).alias("word"))
    asked = Session(spark).disable_provenance().register_model(Counting()).read_frame(words, ("id",)).map(prompt("is {word} there").alias("there")).collect()
    assert {r.values[0] for r in asked.rows if not r.values[-1]} == {0, 3001}
    assert asked.metrics.requests == 3001  # each distinct one once
