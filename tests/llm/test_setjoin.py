"""N-gram Jaccard join, connected components, word arrays."""

import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest

from veracord.llm import graph, setjoin
from veracord.llm.graph import components
from veracord.llm.vector import Table, Words, forest, mix, shingle_sets


def brute_sets(texts, width):
    out = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)})) if x]
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def brute_components(pairs, width, num, den):
    """(id, set size, smallest id reachable) by comparing all pairs."""
    sets, at = brute_sets([t for _, t in pairs], width), {}
    of = {i: i for i, _ in pairs}
    for (i, _), x in zip(pairs, sets, strict=True):
        for (j, _), y in zip(pairs, sets, strict=True):
            if i != j and x and y and den * len(x & y) >= num * len(x | y):
                low, high = sorted((of[i], of[j]))
                of = {k: low if v == high else v for k, v in of.items()}
    for (i, _), x in zip(pairs, sets, strict=True):
        at.setdefault(i, []).append(len(x))
    return sorted((i, n, of[i]) for i, ns in at.items() for n in ns)


def near_copies(rng, groups=12, words=40):
    """Texts in groups that differ in few places, around the threshold, with passages that many share."""
    shared = [f"s{k}" for k in range(30)]
    out = []
    for g in range(groups):
        base = [f"g{g}w{rng.randrange(10**6)}" for _ in range(rng.randrange(5, words))] + (shared if g % 2 else [])
        for _ in range(rng.randrange(1, 7)):
            t = list(base)
            for _ in range(rng.randrange(0, 5)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t += [f"e{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 4))]
            out.append(" ".join(t))
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("width", "num", "cell"), [(3, 90, 512), (5, 80, 512), (5, 80, 4), (1, 50, 4)])
def test_components_agree_with_all_pairs(spark, docs, monkeypatch, width, num, cell):
    monkeypatch.setattr(setjoin, "CELL", cell)  # small cells take every path of large neighbourhoods
    pairs = near_copies(random.Random(width + num))
    got = setjoin.jaccard_components(docs(pairs), width, num, 100).collect()
    assert sorted(map(tuple, got)) == brute_components(pairs, width, num, 100)


def test_odd_rows(spark, docs, odd):
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in setjoin.jaccard_components(docs(odd)).collect()), key=str)
    want = brute_components([(i, t) for i, t in odd if i is not None], 3, 90, 100)
    assert got == sorted([*want, (0, 2, None)], key=str)
    assert setjoin.jaccard_components(docs([])).count() == 0


def test_rows_that_share_an_id_are_searched_each(spark, docs):
    long, other = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(10))
    got = sorted(map(tuple, setjoin.jaccard_components(docs([(1, long), (1, other), (2, long), (3, other + " z")])).collect()))
    assert got == [(1, 8, 1), (1, 28, 1), (2, 28, 1), (3, 9, 3)]


def test_one_of_each(spark, docs):
    long, other = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    near = long + " z"
    one = setjoin.one_of_each(docs([(1, long), (2, near), (3, other), (4, None), (5, None), (None, long)]))
    assert sorted((r.doc_id or 0) for r in one.collect()) == [0, 1, 3, 4, 5] and one.columns == docs([]).columns
    shared = setjoin.one_of_each(docs([(7, long), (7, other), (7, long), (8, near), (9, "alone"), (None, "x")]))
    assert sorted((r.doc_id or 0, r.text) for r in shared.collect()) == sorted([(0, "x"), (7, long), (7, other), (9, "alone")])
    assert setjoin.one_of_each(docs([])).count() == 0


def test_sql_agrees(spark, docs):
    pairs = near_copies(random.Random(9), groups=8)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(pairs, columns=["doc_id", "text"]))
    want = con.sql(setjoin.oracle(3, 90, 100)).df()[["doc_id", "n_shingles", "component_id"]]
    got = setjoin.jaccard_components(docs(pairs)).toPandas()[want.columns]
    pd.testing.assert_frame_equal(*(x.sort_values("doc_id").reset_index(drop=True) for x in (got, want)), check_dtype=False)


def test_components_of_a_chain_and_of_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, i) for i in range(1001, 1400)]
    odd = [(5, 5), (None, 3), (7, None)]
    rows = chain + hub + odd
    random.Random(1).shuffle(rows)
    got = {r.node: r.component for r in components(spark.createDataFrame(rows, "a long, b long").repartition(5)).collect()}
    assert got == {i: 0 for i in range(301)} | {i: 1000 for i in range(1000, 1400)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_table_agree_with_dicts():
    rng = np.random.default_rng(3)
    a, b = rng.integers(0, 500, 400), rng.integers(0, 500, 400)
    of = {int(x): int(x) for x in np.concatenate([a, b])}
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        low, high = sorted((of[x], of[y]))
        of = {k: low if v == high else v for k, v in of.items()}
    assert dict(zip(*(x.tolist() for x in forest(a, b)), strict=True)) == {k: v for k, v in of.items() if k != v}
    table, keys = Table(12), mix(np.arange(1, 3000, dtype=np.uint64))
    table.put(keys, np.arange(len(keys)))
    value, missing = table.find(keys)
    there = np.delete(np.arange(len(keys)), missing)
    assert (value[there] == there).all() and len(there) > 2500
    assert len(table.find(mix(np.arange(5000, 6000, dtype=np.uint64)))[1]) == 1000


def test_word_arrays_agree_with_split():
    rng = random.Random(4)
    texts = ["", "A b  a", "\n x\ty\n\nzz zz", "日本 é\x0b"] + ["".join(rng.choice("aB \n\t#é") for _ in range(rng.randrange(40))) for _ in range(50)]
    words = Words([t.encode() for t in texts])
    sets = brute_sets(texts, 2)
    seen = {}
    for t, a, b in zip(texts, words.first[:-1], words.first[1:], strict=True):
        own = [x for x in re.split(r"[\x20\x09-\x0D]+", t.replace("A", "a").replace("B", "b")) if x]
        assert len(own) == b - a
        for w, h in zip(own, words.h[a:b].tolist(), strict=True):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    assert [len(x) for x in shingle_sets(words, 2)] == [len(x) for x in sets]
    begin, count = words.lines()
    assert count.tolist() == [len(x) for t in texts for x in (re.sub(r"[\x09\x0b-\x0d]", " ", y).split(" ") for y in t.split("\n")) for x in [[w for w in x if w]] if x]


def test_counts_of_unshared_shingles_come_as_one_row_for_each_text(spark, docs, monkeypatch):
    sent = []
    real = setjoin.shuffle_packed
    monkeypatch.setattr(setjoin, "shuffle_packed", lambda rows, make, ddl, parts: sent.append(real(rows, make, ddl, parts)) or sent[-1])
    monkeypatch.setattr(setjoin, "partitions", lambda df: 64)
    monkeypatch.setattr(setjoin, "HELD", 100)
    pairs = near_copies(random.Random(5)) + [(900, ""), (901, None), (902, " ".join(f"u{i}" for i in range(400)))]
    texts = docs(pairs).selectExpr("doc_id AS id", "text")
    sets = brute_sets([t for _, t in pairs], 3)
    got = {r.id: r for r in setjoin.unshared(texts, 3, 1).collect()}
    assert len(got) == len(pairs) and setjoin.unshared(texts, 3, 1).count() == len(pairs)
    for k, (i, _) in enumerate(pairs):
        others = set().union(*(x for j, x in enumerate(sets) if j != k))
        assert (got[i].n, got[i].alone) == (len(sets[k]), len(sets[k] - others))
    counts = [np.frombuffer(r.data, np.int64, len(r.data) // 12, len(r.data) // 12 * 4) for r in sent[0].collect() if r.kind == setjoin.COUNT]
    assert 902 not in np.concatenate(counts), "a text that shares nothing sends no count, whatever the partitions"


def test_what_is_broadcast_to_pass_over_texts_is_bounded(spark, docs, monkeypatch):
    ids = spark.range(-150_000, 150_000)
    marks = setjoin.slots_of(ids)
    assert marks.count() <= setjoin.SLOTS // 64 < 150_000, "a row for each id, or for each of its hashes, is held by the driver"
    wanted = {hash for (hash,) in ids.selectExpr(f"pmod(xxhash64(id), {setjoin.SLOTS}L)").distinct().collect()}
    assert {r.word * 64 + i for r in marks.collect() for i in range(64) if r.marks >> i & 1} == wanted
    joined = []
    monkeypatch.setattr(setjoin, "slots_of", lambda x, real=setjoin.slots_of: joined.append(real(x)) or joined[-1])
    texts = docs([(i, f"t{i}") for i in range(-500, 500)]).selectExpr("doc_id AS id", "text")
    for slots in (setjoin.SLOTS, 128):  # with 128 all hashes are there, and no text is passed over
        monkeypatch.setattr(setjoin, "SLOTS", slots)
        got = setjoin.texts_of(texts, spark.range(-400, 400, 3))
        assert sorted(map(tuple, got.collect())) == [(i, f"t{i}") for i in range(-400, 400, 3)]
    assert len(joined) == 2 and joined[1].count() == 2


def jobs_of(spark, run):
    """(what ``run`` gives, how many Spark jobs it took)."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_edges_are_joined_without_rounds(spark, monkeypatch):
    rows = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5, 5), (None, 3), (7, None)]
    random.Random(2).shuffle(rows)
    edges = spark.createDataFrame(rows, "a long, b long").repartition(5)
    found = lambda: sorted(map(tuple, components(edges).collect()))
    few, fewer = jobs_of(spark, found)
    assert few == sorted([(i, 0) for i in range(301)] + [(i, 1000) for i in range(1000, 1400)])
    monkeypatch.setattr(graph, "FEW", 100)
    many, more = jobs_of(spark, found)
    assert many == few
    assert fewer <= 7 < more, (fewer, more)


def test_tables_that_grow_are_not_gathered_on_the_driver(spark):
    from veracord.llm.common import cut

    docs = cut(spark.createDataFrame([(i, " ".join(f"w{j}" for j in range(i // 2 * 9, i // 2 * 9 + 12))) for i in range(40)], "doc_id long, text string"))
    for out, n in ((setjoin.jaccard_components(docs), 40), (setjoin.one_of_each(docs), 20)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
        assert out.count() == n
    joins = []
    hinted = setjoin.dealt_join
    setjoin.dealt_join = lambda *a: joins.append(hinted(*a)) or joins[-1]
    try:
        setjoin.texts_of(docs.select(docs.doc_id.alias("id"), "text"), cut(docs.select(docs.doc_id.alias("id")))).count()
    finally:
        setjoin.dealt_join = hinted
    assert joins[0]._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1  # the bitmap


def test_the_driver_gives_native_memory_back(spark):
    from veracord.llm.common import give_back_native

    assert "native heap" in give_back_native(spark)
