"""Further confidence sequences; the hosted model; the similarity filter and other switches."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import numpy as np
import pytest

from veracord import Field, Schema, Session, col, prompt, proportion
from veracord.functions import confseq
from veracord.models.language import HostedModel, Request, Retrying, RuleModel


def samples(n, mean, runs=60):
    rng = np.random.default_rng(17)
    return [(rng.random(n) < mean).astype(float) for _ in range(runs)]


@pytest.mark.parametrize("make", [confseq.empirical_bernstein, confseq.mixed_bets])
@pytest.mark.parametrize("mean", [0.08, 0.6])
def test_sequences_cover_and_narrow(make, mean):
    runs = [make(x, 0.9) for x in samples(200, mean)]
    assert confseq.share_missed(runs, mean) <= 0.1
    widths = np.mean([high - low for low, high in runs], axis=0)
    assert widths[-1] < 0.6 * widths[19] and all((low >= 0).all() and (high <= 1).all() for low, high in runs)


def test_lower_bounds_cover_and_are_tighter_than_an_interval():
    runs = [confseq.lower_bounds(x, 0.9) for x in samples(150, 0.7)]
    assert sum((low > 0.7).any() for low in runs) <= 6
    both = [confseq.BettingSequence(0.9) for _ in runs]
    for cs, x in zip(both, samples(150, 0.7), strict=True):
        for v in x:
            cs.update(v)
    assert np.mean([low[-1] for low in runs]) >= np.mean([cs.interval()[0] for cs in both]) - 0.01


def test_intervals_at_fixed_times():
    xs = samples(240, 0.35)
    got = [confseq.intervals_at(x, [60, 240], 0.9) for x in xs]
    assert sum(not low <= 0.35 <= high for pair in got for low, high in pair) <= 12
    assert np.mean([p[1][1] - p[1][0] for p in got]) < np.mean([p[0][1] - p[0][0] for p in got])


def test_running_intersection():
    low, high = confseq.running_intersection(np.array([0.1, 0.05, 0.3]), np.array([0.9, 0.95, 0.7]))
    assert low.tolist() == [0.1, 0.1, 0.3] and high.tolist() == [0.9, 0.9, 0.7]


@pytest.fixture
def endpoint():
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            calls.append(body)
            if len(calls) == 1:
                return self.send_error(503)
            answers = [{"index": p["index"], "value": "tide" in p["text"]} for p in reversed(body["prompts"])]
            said = json.dumps({"answers": answers, "usage": {"input_tokens": 10 * len(answers)}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(said)))
            self.end_headers()
            self.wfile.write(said)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/", calls
    server.shutdown()


def test_hosted_model_answers_in_order_and_is_tried_again(endpoint):
    url, calls = endpoint
    model = HostedModel(url, "m", batch=2)
    requests = [Request("is it about the sea", (("note", t),)) for t in ("high tide", "a hill", "low tide")]
    assert Retrying(model, 3).answer(requests) == [True, False, True]
    assert calls[1]["format"] == {"type": "boolean"} and [len(c["prompts"]) for c in calls] == [2, 2, 1] and model.usage == {"input_tokens": 30}


NOTES = Schema((Field("n", int), Field("note", str)), ("n",))


def test_estimated_share_is_explained_by_the_true_rows_seen(spark):
    model = RuleModel({"is {note} wet": ("contains", "note", ("wet",))})
    s = Session(spark).register_model(model).enable_batching(8).enable_estimation(seed=5)
    data = [(i, "wet" if i % 12 else "dry") for i in range(1500)]
    r = s.read_rows(data, NOTES).map(prompt("is {note} wet").alias("w")).aggregate([proportion(col("w")).alias("p")]).check(col("p") >= 0.4).collect()
    assert r.verdict and r.metrics.rows_seen < 400
    why = r.provenance("p >= 0.4")
    assert len(why.monomials) == 1 and 0 < len(why.tokens) <= r.metrics.rows_seen


def test_csv_is_read(spark, tmp_path):
    from veracord.sources.tables import read_csv

    (tmp_path / "x.csv").write_text('n,note\n1,"two\nlines, ""quoted"""\n2,plain\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "x.csv"), "n long, note string").collect()] == [(1, 'two\nlines, "quoted"'), (2, "plain")]


SEA = {"mentions a storm at sea: {note}": ("contains", "note", ("storm",)), "is {note} calm": ("contains", "note", ("calm",))}
LOG = [
    (1, "The storm at sea broke two masts. We lost the anchor."), (2, "Bought rope and flour in port."), (3, "A calm morning. A storm at sea by noon."),
    (4, "Letters from home."), (5, "Painted the hull."), (6, "Far off a storm at sea was seen."),
]


def embedded(spark, **session):
    from veracord.models.embedding import add_embeddings

    df = add_embeddings(spark.createDataFrame(LOG, "n long, note string"), "note")
    s = Session(spark).register_model(RuleModel(SEA))
    for k, v in session.items():
        getattr(s, k)(**v)
    return s.read_frame(df, ("n",))


def test_similarity_filter_asks_fewer_and_keeps_the_rows(spark):
    storm = prompt("mentions a storm at sea: {note}")
    every = embedded(spark).filter(storm).collect()
    few = embedded(spark, enable_similarity_filter={"threshold": 0.3}).filter(storm)
    assert "MAX_DOT" in few.optimized_logical_plan().display() or "Filter" in few.optimized_logical_plan().display().replace("Filter(mentions", "", 1)
    got = few.collect()
    assert [r.values[0] for r in got.rows] == [r.values[0] for r in every.rows] == [1, 3, 6]
    assert 3 <= got.metrics.requests < every.metrics.requests == 6


def test_similarity_filter_needs_sentence_embeddings_and_one_field(spark):
    plain = Session(spark).register_model(RuleModel(SEA)).enable_similarity_filter().read_rows(LOG, NOTES).filter(prompt("is {note} calm"))
    metrics = plain.collect().metrics
    assert metrics.requests == 6
    assert metrics.characters == sum(len(Request("is {note} calm", (("note", t),)).text(bool)) for _, t in LOG)
    with pytest.raises(ValueError):
        Session(spark).enable_similarity_filter(1.5)


def test_all_switches_together(spark, tmp_path):
    from veracord.models.embedding import add_embeddings

    df = add_embeddings(spark.createDataFrame(LOG, "n long, note string"), "note")
    s = Session.optimised(spark, seed=3, cache=str(tmp_path / "answers")).register_model(RuleModel(SEA))
    o = s.options
    assert o.early_stop and o.fusion and o.minimal and o.relevance and o.similarity and o.estimation and o.cache
    f = s.read_frame(df, ("n",)).map(prompt("is {note} calm").alias("c")).aggregate([proportion(col("c")).alias("p")]).check(col("p") < 0.5)
    assert f.collect().verdict


def shape(frame):
    """Names of the optimised plan's nodes, from the top."""
    return [type(n).__name__ for n in frame.optimized_logical_plan().walk()]


def test_plans(spark):
    calm, storm = prompt("is {note} calm"), prompt("mentions a storm at sea: {note}")
    plain = Session(spark).register_model(RuleModel(SEA)).read_rows(LOG, NOTES)
    assert shape(plain.filter(calm).map(storm.alias("s"))) == ["Project", "Filter", "Scan"]
    fused = Session(spark).register_model(RuleModel(SEA)).enable_fusion().read_rows(LOG, NOTES)
    assert shape(fused.filter(calm).map(storm.alias("s"))) == ["Fused", "Scan"]
    assert shape(fused.map(storm.alias("s")).filter(col("n") > 2)) == ["Project", "Filter", "Scan"], "structured filters go down"
    assert shape(fused.map(storm.alias("s")).filter(col("s"))) == ["Filter", "Project", "Scan"], "not below what they read"
    early = Session(spark).register_model(RuleModel(SEA)).enable_early_stop().read_rows(LOG, NOTES)
    asked = early.map(calm.alias("c")).aggregate([proportion(col("c")).alias("p")]).check(col("p") > 0.5)
    assert shape(asked)[:2] == ["Check", "Aggregate"] and shape(asked)[-1] == "Scan" and "CountScan" in shape(asked)
