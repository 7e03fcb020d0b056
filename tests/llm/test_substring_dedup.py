import os
import random
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa

from veracord.llm import substring_dedup, vector


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def components_by_brute_force(lines, num=80, den=100):
    """First index of each line's component, of links between all pairs."""
    sets, of = [shingles(x) for x in lines], list(range(len(lines)))
    for i in range(len(lines)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and den * both >= num * (len(sets[i]) + len(sets[j]) - both):
                low, high = sorted((of[i], of[j]))
                of = [low if x == high else x for x in of]
    return of


def test_near_copies_of_short_lines(spark, docs):
    rng = random.Random(5)
    lines = []
    for n in range(5, 15):
        for _ in range(4):
            w = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            x, y, z = (f"v{rng.randrange(10**6)}" for _ in range(3))
            lines += [" ".join(w), " ".join([*w, x]), " ".join([y, *w[1:]]), " ".join([z, *w])]
    of = components_by_brute_force(lines)
    assert sum(of[i] != i and len(x.split()) < 13 for i, x in enumerate(lines)) > 30
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(docs(list(enumerate(lines))), least=5).collect()}
    for i, x in enumerate(lines):
        assert got[i].n_removed == (len(x.split()) if of[i] != i else 0), (x, lines[of[i]])


def passages_by_brute_force(texts, n=20):
    """Words of each text that lie in ``n`` words that stand earlier too, or in a whole line of five words or more that does."""
    seen, lines, out = set(), set(), []
    for text in texts:
        words, gone, at = text.split(), set(), 0
        for i in range(len(words) - n + 1):
            key = tuple(words[i : i + n])
            gone.update(range(i, i + n) if key in seen else ())
            seen.add(key)
        for line in text.split("\n"):
            k = len(line.split())
            gone.update(range(at, at + k) if k >= 5 and line in lines else ())
            lines.add(line)
            at += k
        out.append(gone)
    return out


def test_every_passage_of_twenty_words_goes_to_its_ends(spark, docs):
    rng = random.Random(7)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for n in (19, 20, 21, 25, 30, 35, 45, 60):
        for _ in range(6):
            p = some(n)
            texts.append(" ".join(some(3) + p[5:14] + some(3)))  # a part of it stands earlier elsewhere
            texts += [" ".join(some(rng.randrange(10, 30)) + p + some(rng.randrange(10, 30))) for _ in range(3)]
            texts.append(" ".join(some(9) + p[:8]) + "\n" + " ".join(p[8:] + some(9)))
            texts.append(" ".join(p + some(20) + p))
    texts += ["again " * 50, " ".join(some(8)) + "\n" + " ".join(some(30)), "short line\n" + " ".join(some(40))]
    texts.append(texts[-2])
    want = passages_by_brute_force(texts)
    got = {r.doc_id: r for r in substring_dedup.repeated_spans(docs(list(enumerate(texts))), least=5).collect()}
    for i, x in enumerate(texts):
        assert {k for s in got[i].spans for k in range(s.at, s.at + s.words)} == want[i], x
        assert got[i].n_removed == len(want[i])


def test_filter_of_ids_takes_one_job_whatever_the_partitions(spark):
    ids = [1, 63, 64, substring_dedup.FILTER_BITS - 1, substring_dedup.FILTER_BITS + 7, -1, -(1 << 63), (1 << 63) - 1]
    table = spark.createDataFrame([(i,) for i in ids], "id long").repartition(40, "id")
    group, before = "filter of ids", spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.sparkContext.setJobGroup(group, group)
    try:
        bits = substring_dedup.id_filter(table)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) < 10
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    asked = np.array([*ids, 2, 65, 8], np.int64).view(np.uint64)
    assert substring_dedup.passes(bits, asked).tolist() == [True] * len(ids) + [False] * 3
    assert not substring_dedup.id_filter(table.where("id = 12345")).any()


class Kept:
    """Stands for a table; keeps the function that its tasks would run."""

    def __getattr__(self, name):
        def step(*args):
            self.run = args[0] if name == "mapInArrow" else None
            return self

        return step


def traced_peak(run) -> int:
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def resident() -> int:
    return int(Path("/proc/self/statm").read_text().split()[1]) * os.sysconf("SC_PAGE_SIZE")


def test_few_rows_of_a_batch_are_python_objects_at_a_time(spark):
    texts = pa.array([f"{i} " + "x" * 2000 for i in range(10_000)] + [None, ""])  # 20 MB
    assert traced_peak(lambda: [None for _ in vector.grouped(texts)]) < 4 << 20
    groups = list(vector.grouped(texts))
    assert [x for _, part in groups for x in part] == [(x or "").encode() for x in texts.to_pylist()]
    assert [at for at, _ in groups] == [sum(len(part) for _, part in groups[:i]) for i in range(len(groups))]
    rows = vector.packed([(b, 1, bytes([b]) * 100_000) for b in range(200)], 1)  # 20 MB

    class Fold:
        def fold(self, kind, data):
            got.append((kind, b"".join(data)[:1], sum(map(len, data))))
            yield from ()

        def end(self):
            yield from ()

    got, run = [], vector.shuffle_packed(Kept(), Fold, "a long", 1).run
    assert traced_peak(lambda: list(run(iter([rows, rows.slice(199)])))) < 15 << 20  # the last bucket goes on in another batch
    assert got == [(1, bytes([b]), 100_000) for b in range(199)] + [(1, bytes([199]), 200_000)]


def test_a_task_gives_freed_memory_back(spark):
    pins, sizes = [], []

    class Fold:
        def fold(self, kind, data):
            blocks = [bytes(50_000) for _ in range(4_000)]  # 200 MB
            pins.append(blocks[-1])  # so that the heap's end stays in use
            sizes.append(resident())
            yield from ()

        def end(self):
            yield from ()

    run, before = vector.shuffle_packed(Kept(), Fold, "a long", 1).run, resident()
    assert list(run(iter([vector.packed([(0, 1, b"x")], 1)]))) == []
    assert sizes[0] - before > 150 << 20
    assert resident() - before < 50 << 20


def test_large_batches_go_in_pieces():
    rows = pa.RecordBatch.from_pydict({"n": list(range(3_000)), "data": [bytes([i % 256]) * 5_000 for i in range(3_000)]})
    got = list(vector.lean(lambda batches: batches)(iter([rows, rows.slice(0, 0), rows.slice(5, 2)])))
    assert max(b.nbytes for b in got) <= vector.LARGE < rows.nbytes
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches([rows, rows.slice(5, 2)]).to_pydict()
