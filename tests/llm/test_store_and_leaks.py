"""Token store, pre-tokens, benchmark decontamination, corpus pipeline."""

import glob
import os
import random
import shutil
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veracord.llm import bpe, decontaminate, pretokens, token_store

tokenizers = pytest.importorskip("tokenizers")
BPE = bpe.tokenizer_path("byte_bpe_50k.json")


def test_ids_agree_with_the_library():
    raw = open(BPE, "rb").read()
    library, ids = tokenizers.Tokenizer.from_file(BPE), pretokens.Ids(raw, bits=10, pool=4000)  # small: the table overflows and is emptied
    rng = random.Random(4)
    parts = [*"abAB 2_\n\t'sdé.#!ñ", "²", "Ⅷ", "日", "🎉", "\x1c", "<|endoftext|>", "'ll", "'re", "'ve", "'\"", "  ", "\r\n", "　", "\xa0", "\x00", "x" * 40, "ʼ", "the ", " of"]
    for _ in range(40):
        texts = ["".join(rng.choices(parts, k=rng.randrange(30))) for _ in range(40)]
        got, bounds = ids(texts)
        for t, a, b in zip(texts, bounds[:-1], bounds[1:], strict=True):
            assert got[a:b].tolist() == library.encode(t, add_special_tokens=False).ids, t


def want_digests(rows):
    library, start, out = tokenizers.Tokenizer.from_file(BPE), 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    shared = " ".join(f"word{rng.randrange(50)}" for _ in range(3000))
    return [(i, "".join(rng.choices(["the ", "of ", "\n", "ab", "é"], k=rng.randrange(400))) + (shared if i % 3 == 0 else "")) for i in range(40)] + [(100, None), (101, "")]


@pytest.fixture
def store(spark, docs, texts, tmp_path):
    path = f"file://{tmp_path}/store"
    token_store.write_store(docs(texts), path, BPE)
    return path


def test_store_round_trip(spark, texts, store):
    assert sorted(map(tuple, token_store.digests(spark, store).collect())) == want_digests(texts)
    library = tokenizers.Tokenizer.from_file(BPE)
    got = {r.doc_id: r.ids for r in token_store.read_ids(spark, store).collect()}
    assert got == {i: [*library.encode(t or "", add_special_tokens=False).ids, 0] for i, t in texts}
    chunks = token_store.chunk_table(spark, store)
    assert chunks.count() == chunks.select("hash").distinct().count()
    assert chunks.agg(F.sum("n")).head()[0] < 0.6 * sum(map(len, got.values())), "shared passages are stored once"


def test_odd_rows(spark, docs, odd, tmp_path):
    path = f"file://{tmp_path}/odd"
    token_store.write_store(docs(odd), path, BPE)
    got = token_store.digests(spark, path).collect()
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want_digests(odd)))  # rows of one id have equal texts here
    token_store.write_store(docs([]), f"{path}-none", BPE)
    assert token_store.digests(spark, f"{path}-none").count() == 0


def damaged(kind, folder):
    """Breaks the files below ``folder`` in one way."""
    files = lambda where: sorted(glob.glob(f"{folder}/{where}/**/*.parquet", recursive=True), key=os.path.getsize)
    if kind == "lost chunks":
        os.remove(files("chunks/kind=chunk")[-1])
    elif kind == "lost recipes":
        os.remove(files("recipes/kind=recipe")[-1])
    elif kind == "lost manifest":
        os.remove(files("recipes/kind=manifest")[0])
    else:
        import pyarrow as pa
        import pyarrow.parquet as pq

        name = files("chunks/kind=chunk" if kind == "changed chunk" else "recipes/kind=recipe")[-1]
        rows = pq.ParquetFile(name).read()
        if kind == "changed chunk":
            data = rows["data"].to_pylist()
            data[0] = bytes([data[0][0] ^ 1]) + data[0][1:]
            rows = rows.set_column(rows.schema.get_field_index("data"), "data", pa.array(data, pa.binary()))
        else:  # a recipe and its root, changed together
            hashes, roots = rows["hashes"].to_pylist(), rows["root"].to_pylist()
            i = next(i for i, h in enumerate(hashes) if len(h) > 1)
            hashes[i] = hashes[i][::-1]
            roots[i] = token_store.merkle(hashes[i])
            rows = rows.set_column(rows.schema.get_field_index("root"), "root", pa.array(roots, pa.binary()))
            rows = rows.set_column(rows.schema.get_field_index("hashes"), "hashes", pa.array(hashes, rows.schema.field("hashes").type))
        pq.write_table(rows, name)
    for crc in glob.glob(f"{folder}/**/.*.crc", recursive=True):
        os.remove(crc)


@pytest.mark.parametrize("kind", ["lost chunks", "lost recipes", "lost manifest", "changed chunk", "changed recipe"])
def test_damage_is_found(spark, store, tmp_path, kind):
    folder = store.removeprefix("file://")
    shutil.copytree(folder, f"{folder}-2")
    damaged(kind, f"{folder}-2")
    with pytest.raises(Exception, match="does not match|missing|do not add up"):
        token_store.digests(spark, f"file://{folder}-2").collect()


def test_streamed_tree_is_the_tree_by_levels():
    import hashlib

    def levels(leaves):
        row = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [bytes(16)]
        while len(row) > 1:
            row = [hashlib.blake2b(b"\1" + row[i] + row[i + 1], digest_size=16).digest() if i + 1 < len(row) else row[i] for i in range(0, len(row), 2)]
        return row[0]

    for n in range(20):
        leaves = [bytes([i]) for i in range(n)]
        assert token_store.merkle(leaves) == levels(leaves)


# --- decontamination


@pytest.fixture(scope="module")
def bench():
    rng = random.Random(11)
    vocab = [f"v{i}" for i in range(1500)]
    common = ["the", "of", "and", "to", "in", "is", "for"]
    word = lambda: rng.choice(common) if rng.random() < 0.4 else rng.choice(vocab)
    sentence = lambda n: [word() for _ in range(n)]
    items = [(i, sentence(n)) for i, n in enumerate([14, 20, 30, 40, 50, 60, 120, 150] * 4)]
    docs, clean = [], list(range(200, 300))
    for i, w in items:
        around = lambda: (sentence(rng.randrange(5, 120)), sentence(rng.randrange(5, 120)))
        a, b = around()
        docs.append((i, a + w + b))  # verbatim
        a, b = around()
        near = [x if rng.random() > 0.12 or x in w[:0] else word() for x in w]
        docs.append((100 + i, a + near + b))  # words replaced
    docs += [(i, sentence(rng.randrange(10, 300))) for i in clean]
    return items, docs, clean


def test_leaks_are_found_and_clean_documents_left(spark, docs, bench):
    items, rows, clean = bench
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items] + [(900, None), (901, " "), (None, "x y")], "item_id long, text string")
    odd = [(500, None), (501, ""), (502, "a"), (503, "word " * 20000)]
    got = {r.doc_id: r for r in decontaminate.find_leaks(docs([(i, " ".join(w)) for i, w in rows] + odd), table, carry=("lang",)).collect()}
    verbatim = [i for i, _ in items if i in got[i].item_ids]
    near = [i for i, _ in items if i in got[100 + i].item_ids]
    assert len(verbatim) == len(items) and len(near) >= 0.9 * len(items)
    assert not any(got[i].contaminated for i in clean) and not any(got[i].contaminated for i in (500, 501, 502, 503))
    assert decontaminate.find_leaks(docs(odd), table.limit(0)).where("contaminated").count() == 0
    assert decontaminate.find_leaks(docs([]), table).count() == 0


def test_fifty_words_of_a_long_item_are_found(spark, docs, bench):
    items, _, _ = bench
    item, words = next((i, w) for i, w in items if len(w) >= 120)
    rng = random.Random(1)
    rows = [(k, " ".join([f"o{rng.randrange(900)}" for _ in range(70)] + words[k : k + 50] + [f"o{rng.randrange(900)}" for _ in range(70)])) for k in range(0, 70, 7)]
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = decontaminate.find_leaks(docs(rows), table).collect()
    assert all(item in r.item_ids for r in got)


def space_of(bench, rank=256):
    items, rows, _ = bench
    vocabulary = decontaminate.Vocabulary([" ".join(w) for _, w in items])
    texts = [" ".join(w).encode() for _, w in rows]
    words = decontaminate.Words(texts, edges=decontaminate.EDGES)
    ids, first = vocabulary.numbers(words.h), words.first
    df = np.zeros(vocabulary.size + decontaminate.COUNTERS)
    for a, b in zip(first[:-1], first[1:], strict=True):
        df[np.unique(ids[a:b])] += 1
    idf = np.log((len(rows) + 1) / (df + 1)) + 0.1
    passages = [(i, w[s : s + 32]) for i, w in enumerate(vocabulary.items) for s in range(0, max(len(w) - 16, 1), 32)]
    space = decontaminate.Space([w for _, w in passages], vocabulary.size, idf)
    space._sampled = lambda sample, q: space.gram([space.row(ids[a : a + 32]) for a in first[:-1]], q)
    space.fit(None, 16.0, rank, 7)
    return vocabulary, space, passages, idf, ids, first


def every_window(first):
    for t, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        for k in range(-(-max(b - a - 32, 0) // 8) + (b > a)):
            yield t, a + 8 * k, min(a + 8 * k + 32, b)


def test_recall_of_the_latent_search_and_the_bound(bench):
    _, space, _, _, ids, first = space_of(bench)
    dense = lambda row: np.bincount(row[0], row[1], space.width)
    passages = np.stack([dense(r) for r in space.rows])
    found = {(t, p, s) for x in space.candidates(ids, first, 0.4) for t, p, s, _ in zip(*(y.tolist() for y in x), strict=True)}
    want, bounds = set(), []
    spans = list(every_window(first))
    bound = space.bound(ids, np.array([s for _, s, _ in spans]), np.array([e for _, _, e in spans]))
    for (t, s, e), most in zip(spans, bound, strict=True):
        cosine = passages @ dense(space.row(ids[s:e]))
        bounds.append(cosine.max() ** 2 <= most + 1e-5)
        want |= {(t, int(p), s) for p in np.flatnonzero(cosine >= 0.4)}
    assert all(bounds), "no window is passed over whose cosine is above the bound"
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want)


@pytest.mark.parametrize("rank", [256, 32])
def test_recall_of_a_space_of_the_whole_benchmark_and_no_sample(bench, rank):
    vocabulary, old, passages, idf, ids, first = space_of(bench)
    space = decontaminate.Space([w for _, w in passages], vocabulary.size, idf)
    space.fit(None, 1.0, rank, 7)
    dense = lambda row: np.bincount(row[0], row[1], space.width)
    matrix = np.stack([dense(r) for r in space.rows])
    found = {(t, p, s) for x in space.candidates(ids, first, 0.4) for t, p, s, _ in zip(*(y.tolist() for y in x), strict=True)}
    want = {(t, int(p), s) for t, s, e in every_window(first) for p in np.flatnonzero(matrix @ dense(space.row(ids[s:e])) >= 0.4)}
    assert len(want) > 100 and len(want & found) >= 0.9 * len(want)


def test_no_sample_of_the_documents_shapes_the_space(spark, docs, bench, monkeypatch):
    items, rows, _ = bench
    given = []
    fit = decontaminate.Space.fit
    monkeypatch.setattr(decontaminate.Space, "fit", lambda self, further, *args: given.append(further) or fit(self, further, *args))
    table = spark.createDataFrame([(i, " ".join(w)) for i, w in items[:4]], "item_id long, text string")
    assert decontaminate.find_leaks(docs([(i, " ".join(w)) for i, w in rows[:8]]), table).where("contaminated").count() == 8
    assert given == [None]


def test_bound_holds_where_one_word_is_repeated(bench):
    vocabulary, space, _, _, _, _ = space_of(bench)
    ids = np.array([vocabulary.items[0][0]] * 8 + [vocabulary.size + i for i in range(24)])
    dense = lambda row: np.bincount(row[0], row[1], space.width)
    cosine = max(float(dense(r) @ dense(space.row(ids))) for r in space.rows)
    assert space.bound(ids, np.array([0]), np.array([32]))[0] >= cosine**2 - 1e-6


def test_windows_that_are_not_projected_can_pass_no_check(bench):
    vocabulary, space, passages, idf, ids, first = space_of(bench)
    judge = decontaminate.Judge(vocabulary.items, passages, idf, 0.75, 0.55, 6)
    live = judge.live(ids)
    passed = 0
    for t, s, e in every_window(first):
        for p in range(len(passages)):
            if judge.share(ids, p, s, e, int(first[t]), int(first[t + 1]))[1]:
                passed += 1
                assert live[0][s] and judge.possible(live, len(ids), np.array([p]), np.array([s]))[0]
    assert passed > 50


def test_common_subsequence_agrees_with_the_table():
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randrange(12))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        assert decontaminate.common_subsequence(a, b) == row[-1]


# --- pipeline


@pytest.fixture
def corpus(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    item = prose(40)
    a, b = prose(80), prose(90)
    docs = [
        (1, a), (2, a), (3, a + " tail"), (4, b), (5, prose(50) + " " + item + " " + prose(50)), (6, "too short"), (7, None), (8, ""), (9, "spam line " * 40),
        (10, prose(60) + " call +1 (966) 555-0400 or write to a.b1@mail8.example.com"), (None, prose(70)), (11, prose(30000)),
    ]
    rows = [(i, t, "en", "src", len(t or ""), "clash") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, n_words string").write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"file://{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    return f"file://{tmp_path}", dict(docs)


def test_pipeline_keeps_what_it_should(spark, corpus):
    folder, docs = corpus
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    assert set(out) == {1, 4, 10, None, 11}
    assert all(r.round_trip and r.n_pieces == len(r.ids) > 0 for r in out.values())
    table = spark.read.parquet(f"{folder}/documents.parquet")
    changed = {r.doc_id: r for r in corpus_pipeline.pseudonyms(spark, table, folder).collect()}
    assert changed[10].text != docs[10] and changed[10].n_chars == len(changed[10].text) and changed[4].text == docs[4] and changed[4].n_words == "clash"


def test_each_stage_takes_an_empty_table(spark, corpus):
    folder, _ = corpus
    none = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, folder)
        assert out.count() == 0 and (name == "sentencepiece" or out.columns == none.columns)


def test_cut_points_of_a_group_are_those_of_each_document():
    rng = np.random.default_rng(6)
    for _ in range(60):
        sizes = rng.integers(1, 400, rng.integers(1, 30))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        ids = rng.integers(0, 50, bounds[-1]).astype("<u2")
        together = list(token_store.cut_points(ids, bounds, 16, 4, 60))
        for a, b, ends in zip(bounds[:-1], bounds[1:], together, strict=True):
            assert ends == next(token_store.cut_points(ids[a:b], np.array([0, b - a]), 16, 4, 60))
            assert ends[-1] == b - a and all(0 < y - x <= 60 for x, y in zip([0, *ends], ends, strict=False))


def test_a_task_gives_its_chunks_on_in_small_batches(spark):
    import pyarrow as pa

    sent = {}

    class Rows:  # stands for the table: keeps the function that encodes
        sparkSession = spark

        def select(self, *_):
            return self

        def mapInArrow(self, f, _):
            sent["encode"] = f
            raise InterruptedError

    with pytest.raises(InterruptedError):
        token_store.write_store(Rows(), "", BPE)
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefgh ij", k=3000)) for _ in range(1500)]
    whole = pa.RecordBatch.from_arrays([pa.array(range(1500), pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "text"])
    out = list(sent["encode"](iter([whole, whole.slice(0, 0)])))
    assert [i for b in out for i in b.column("doc_id").to_pylist() if i is not None] == list(range(1500))
    assert max(b.nbytes for b in out) < 3 << 20 < sum(b.nbytes for b in out)
