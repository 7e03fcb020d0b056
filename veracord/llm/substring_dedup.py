r"""Substring dedup: near-duplicate paragraphs and repeated passages across documents.

A paragraph is a \n-split line.

* *Near-duplicate paragraphs.* MinHash signatures over the five-word shingles of every
  line of five words or more, ``BANDS`` bands of ``ROWS`` rows: two paragraphs of Jaccard
  0.8 share a band with probability ``1 - (1 - 0.8**2)**6`` = 0.998, 0.9 with 0.99995.
  Paragraphs of a band bucket are joined to one of them as a star; within the components
  of the stars the exact Jaccard is computed (the T-occurrence search of
  :mod:`setjoin`), and the verified links are clustered by components. All members but
  the first of a component, by (doc_id, place), are ``copies`` of it; those of ``least``
  words or more go.
* *Repeated passages.* Every stretch of ``min_words`` words, line ends or not, that
  equals an earlier one (by doc_id, place; the two may overlap) goes, whatever lies
  around it. A stretch is asked for by its seed: the least hash of its ``SEED``-word
  windows, which equal stretches have in common wherever they stand. One pass finds the
  seeds that stand at two places or more; the next one compares all stretches that have
  such a seed, word for word up to 64-bit hashes, so spans reach to the true ends.

What goes and touches is one span. Short lines that stand in many clean documents
(formulas, headings, turns of phrase) are reported and stay, unless ``least`` is lowered.

Scale: two passes over the texts. The first shuffles signatures, lines and about one
seed in seven words; the second the stretches that may repeat, once per task each, and
the lines that need verification; both packed by task and bucket. The seeds are asked for
by a filter of fixed size: when it fills, more stretches than needed are compared, none is
left out. A document's spans, not its text, are put together by its id. Candidates are
never paired within a bucket.

Defined results: null and empty texts have no words and no spans; words are as in the
other contracts, compared after lower-casing A-Z. Repeats within one document count
too. Rows with a null doc_id are passed over and returned with no spans. Rows that share a
doc_id are documents each, in the order of (doc_id, hash of the text): of two equal rows
the second goes. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracord.llm.common import cut, release
from veracord.llm.setjoin import EDGE, HELD, ITEM, SIG, Sender, StarFold, partitions, repeated_ids, star_batch, verified_components
from veracord.llm.vector import PACKED, U, Words, dealt, grouped, lean, mix, packed, shuffle_packed, stretch_hashes, unpacked, windows

WIDTH, BANDS, ROWS, SEED = 5, 6, 2, 8
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * U(0x9E3779B97F4A7C15))
#: Kinds of rows beside those of a star join.
SEEDED, LINE, COPY, WINDOW, GONE, TEXT = range(10, 16)
ROW = "kind int, a long, b long, c long, d long"
ANSWER = "kind int, a long, b long, c long, text string"


def line_rows(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    rows = star_batch(kind, *cols[:3])
    last = cols[3] if len(cols) > 3 else np.zeros(rows.num_rows, np.int64)
    return pa.RecordBatch.from_arrays([*rows.columns, pa.array(last, pa.int64())], names=["kind", "a", "b", "c", "d"])


def sliding(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """``of`` (np.minimum, np.maximum) each ``n`` adjacent elements."""
    size = 1
    while 2 * size <= n:
        x = of(x[:-size], x[size:])
        size *= 2
    return of(x[: size - n], x[n - size :]) if size < n else x


class Paragraphs(Words):
    """A group's words with its lines: ``ids`` hash lines, ``begin`` and ``count`` are their
    first words and lengths, ``row`` and ``at`` the text and the place of each in it."""

    def __init__(self, texts: list[bytes]):
        super().__init__(texts)
        begin, count = self.lines()
        own = count >= WIDTH
        self.begin, self.count = begin[own], count[own]
        self.ids = stretch_hashes(mix(self.h), self.begin, self.begin + self.count).view(np.int64)
        self.row = np.searchsorted(self.first, self.begin, "right") - 1
        self.at = self.begin - self.first[self.row]

    def bands(self) -> np.ndarray:
        """[band, line] signatures of the lines that have a shingle."""
        if not len(self.begin):
            return np.empty((BANDS, 0), np.uint64)
        n = self.count - WIDTH + 1
        first = np.cumsum(n) - n
        at = np.arange(int(n.sum())) - np.repeat(first, n) + np.repeat(self.begin, n)
        shingle = windows(self.h, WIDTH)[at]
        least = np.stack([np.minimum.reduceat(mix(shingle ^ s), first) for s in SEEDS])
        band = least[::ROWS] * U(0x9E3779B97F4A7C15) + least[1::ROWS]
        return mix(band + np.arange(1, BANDS + 1, dtype=np.uint64)[:, None])

    def least_windows(self, min_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash of each SEED-word window, seed of each stretch of ``min_words`` words, whether that lies in one text)."""
        n = len(self.h)
        if n < min_words:
            return self.h[:0], self.h[:0], np.zeros(0, bool)
        k = min(SEED, min_words)
        x = windows(self.h, k)
        least = sliding(x, min_words - k + 1, np.minimum)
        end = np.repeat(self.first[1:], np.diff(self.first))[: len(least)]
        return x, least, end - np.arange(len(least)) >= min_words

    def seeds(self, min_words: int) -> np.ndarray:
        """The seed at each place that has one."""
        x, least, inside = self.least_windows(min_words)
        if not len(x):
            return x
        w = min_words - min(SEED, min_words) + 1
        around = np.zeros(w - 1, np.uint64)
        return x[sliding(np.concatenate([around, np.where(inside, least, U(0)), around]), w, np.maximum) == x]


def firsts(key: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by key and then place, whether it is the first of its key)."""
    order = np.argsort(key)
    k = key[order]
    first = np.concatenate([[True], k[1:] != k[:-1]])
    if not first.all():
        order = np.lexsort((at, doc, key))
    return order, first


class FindSender(Sender):
    """A task's signatures, seeds and lines, its own repeats already combined."""

    def __init__(self, parts: int):
        super().__init__(parts)
        self.seeds, self.lines = [], []

    def take(self, group: Paragraphs, docs: np.ndarray, min_words: int) -> None:
        self.seeds.append(group.seeds(min_words))
        self.held += len(self.seeds[-1]) + len(group.ids)
        bands = group.bands()
        self.add(bands.ravel(), np.tile(group.ids, BANDS))
        self.lines.append((group.ids, docs[group.row], group.at, group.count))

    def flush(self) -> list[tuple[int, int, bytes]]:
        rows = super().flush() if sum(map(len, self.sigs)) else []
        seeds, lines, self.seeds, self.lines, self.sigs, self.nodes, self.held = self.seeds, self.lines, [], [], [], [], 0
        if seeds:
            seed, count = np.unique(np.concatenate(seeds), return_counts=True)
            rows += dealt(SEEDED, self.parts, seed, count)
        if lines:
            ids, doc, at, n = (np.concatenate(x) for x in zip(*lines, strict=True))
            order, first = firsts(ids, doc, at)
            ids, doc, at, n = ids[order], doc[order], at[order], n[order]
            rows += self.by_node(LINE, ids[first], doc[first], at[first], n[first])
            rows += self.by_node(COPY, doc[~first], ids[~first], at[~first], n[~first])
        return rows


class FindFold(StarFold):
    """Stars of signatures; seeds at two places or more; the first of equal lines and its copies."""

    def fold(self, kind: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == SEEDED:
            seed, count = unpacked(data, 2)
            order = np.argsort(seed)
            seed, count = seed[order], count[order]
            begin = np.flatnonzero(np.concatenate([[True], seed[1:] != seed[:-1]])) if len(seed) else seed
            if len(begin):
                again = seed[begin][np.add.reduceat(count, begin) > 1]
                yield line_rows(SEEDED, again)
        elif kind == LINE:
            _, ids, doc, at, n = unpacked(data, 5)
            order, first = firsts(ids, doc, at)
            for k, some in ((LINE, order[first]), (COPY, order[~first])):
                if len(some):
                    yield line_rows(k, ids[some], doc[some], at[some], n[some])
        elif kind == COPY:
            _, doc, ids, at, n = unpacked(data, 5)
            yield line_rows(COPY, ids, doc, at, n)
        else:
            for rows in super().fold(kind, data):
                yield line_rows(rows.column(0)[0].as_py(), *(rows.column(i).to_numpy() for i in (1, 2, 3))) if rows.num_rows else line_rows(EDGE, np.zeros(0, np.int64))

    def end(self) -> Iterator[pa.RecordBatch]:
        for rows in super().end():
            if rows.num_rows:
                yield line_rows(EDGE, rows.column(1).to_numpy(), rows.column(2).to_numpy())


def find(texts: DataFrame, min_words: int) -> DataFrame:
    """ROW rows of ``texts(doc, text)``: EDGE (a, b); SEEDED (seed); LINE and COPY (id, doc, at, words); ITEM (doc, words)."""
    parts = partitions(texts)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = FindSender(parts)
        for batch in batches:
            docs, counts = batch.column("doc").to_numpy(), []
            for at, part in grouped(batch.column("text")):
                group = Paragraphs(part)
                sender.take(group, docs[at : at + len(part)], min_words)
                counts.append(np.diff(group.first))
                if sender.held > HELD:
                    yield packed(sender.flush(), parts)
            if len(docs):
                yield packed(sender.by_node(ITEM, docs, np.concatenate(counts), np.zeros(len(docs), np.int64)), parts)
        yield packed(sender.flush(), parts)

    return shuffle_packed(texts.mapInArrow(lean(send), PACKED), FindFold, ROW, parts)


#: Bits of the filters of seeds and of lines; their size is fixed.
FILTER_BITS = 1 << 24


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bit map of ``ids`` modulo FILTER_BITS: 2 MB at most, whatever the number of ids."""
    at = ids.select(F.pmod(F.col("id"), F.lit(FILTER_BITS)).alias("at"))
    rows = at.groupBy(F.expr("CAST(at DIV 64 AS INT)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(at % 64 AS INT)))").alias("bits"))
    out = np.zeros(FILTER_BITS // 64, np.int64)
    found = rows.toArrow()  # in one job; an iterator would run one for each partition
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def passes(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Whether each id passes the filter."""
    at = ids & U(FILTER_BITS - 1)
    return (bits[(at >> U(6)).astype(np.int64)] >> (at & U(63)) & U(1)).astype(bool)


def runs_of(doc: np.ndarray, at: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, place, words) of the stretches of ``words`` words at these places, those that follow each other as one."""
    order = np.lexsort((at, doc))
    doc, at = doc[order], at[order]
    begins = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] > at[:-1] + 1)])
    ends = np.concatenate([begins[1:], [True]])
    return doc[begins], at[begins], at[ends] - at[begins] + words


class AnswerFold:
    """All but the first of equal stretches as GONE; the first of equal lines' texts."""

    def __init__(self, min_words: int):
        self.min_words = min_words

    def rows(self, kind: int, *cols: np.ndarray, texts: list | None = None) -> pa.RecordBatch:
        rows = star_batch(kind, *cols)
        text = pa.nulls(rows.num_rows, pa.string()) if texts is None else pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays([*rows.columns, text], names=["kind", "a", "b", "c", "text"])

    def fold(self, kind: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == WINDOW:
            key, doc, at = unpacked(data, 3)
            order, first = firsts(key, doc, at)
            again = order[~first]
            if len(again):
                yield self.rows(GONE, *runs_of(doc[again], at[again], self.min_words))
        elif kind == GONE:
            yield self.rows(GONE, *unpacked(data, 4)[1:])
        else:
            texts: dict[int, bytes] = {}
            for x in data:
                n = int.from_bytes(x[:8], "little")
                texts.update(zip(np.frombuffer(x, np.int64, n, 8).tolist(), x[8 + 8 * n :].split(b"\n"), strict=True))
            yield self.rows(TEXT, np.array(list(texts), np.int64), texts=[t.decode() for t in texts.values()])

    def end(self) -> Iterator[pa.RecordBatch]:
        yield from ()


def ask(texts: DataFrame, wanted: np.ndarray, seeds: np.ndarray, min_words: int) -> DataFrame:
    """ANSWER rows: GONE (doc, at, words) of stretches that stand earlier; TEXT (id, text) of lines that pass ``wanted``."""
    parts = partitions(texts)
    filters = texts.sparkSession.sparkContext.broadcast((wanted, seeds))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines, places = filters.value
        sender, held, size = Sender(parts), [], 0

        def flush() -> list:
            key, doc, at = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order, first = firsts(key, doc, at)
            key, doc, at = key[order], doc[order], at[order]
            rows = dealt(WINDOW, parts, key[first], doc[first], at[first])
            return rows + (sender.by_node(GONE, *runs_of(doc[~first], at[~first], min_words)) if not first.all() else [])

        for batch in batches:
            docs, found = batch.column("doc").to_numpy(), {}
            for at, part in grouped(batch.column("text")):
                group = Paragraphs(part)
                raw = group.data.tobytes()
                for i in np.flatnonzero(passes(lines, group.ids.view(np.uint64))).tolist():
                    b = group.begin[i]
                    found.setdefault(int(group.ids[i]), raw[group.starts[b] : group.ends[b + group.count[i] - 1]])
                _, least, inside = group.least_windows(min_words)
                here = np.flatnonzero(inside & passes(places, least))
                if len(here):
                    row = np.searchsorted(group.first, here, "right") - 1
                    held.append((windows(group.h, min_words)[here], docs[at + row], here - group.first[row]))
                    size += len(here)
                if size > HELD:
                    yield packed(flush(), parts)
                    size = 0
            if found:
                ids = np.array(list(found), np.int64)
                bucket = (mix(ids.view(np.uint64)) % U(parts)).astype(np.int64).tolist()
                by: dict[int, list[int]] = {}
                for i, b in enumerate(bucket):
                    by.setdefault(b, []).append(i)
                own = list(found.values())
                yield packed([(b, TEXT, len(at).to_bytes(8, "little") + ids[at].tobytes() + b"\n".join(own[i] for i in at)) for b, at in by.items()], parts)
        if held:
            yield packed(flush(), parts)

    return shuffle_packed(texts.mapInArrow(lean(send), PACKED), lambda: AnswerFold(min_words), ANSWER, parts)


def merged_spans(row: np.ndarray, at: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, words) of what goes, from what repeats, sorted by row and place: what touches is one span."""
    if not len(row):
        return row, at, words
    far = np.int64(1) << 40  # beyond the places of any text
    end = np.maximum.accumulate(row * far + at + words)
    begins = np.concatenate([[True], row[1:] * far + at[1:] > end[:-1]])
    last = np.concatenate([np.flatnonzero(begins)[1:] - 1, [len(row) - 1]])
    return row[begins], at[begins], end[last] - row[begins] * far - at[begins]


def listed(row: np.ndarray, n: int, **fields: np.ndarray) -> pa.ListArray:
    """Lists of structs for ``n`` rows, from their fields sorted by row."""
    offsets = np.searchsorted(row, np.arange(n + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in fields.values()], names=list(fields)))


SPANS = "array<struct<at: bigint, words: bigint>>"
COPIES = "array<struct<at: bigint, words: bigint, of_doc: bigint, of_at: bigint>>"


def repeated_spans(docs: DataFrame, min_words: int = 20, num: int = 80, den: int = 100, least: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed (words), spans, copies of every row of ``docs(doc_id, text)``.

    ``spans`` lists (first word, number of words) of what repeats something earlier.
    ``copies`` lists the lines of five words or more, short ones too, that are near
    duplicates (or copies) of an earlier line, with the document and place of the first of
    their class: (first word, words, of_doc, of_at).
    """
    texts = docs.select("doc_id", "text")
    nulls = texts.where(F.col("doc_id").isNull()).select("doc_id", *(F.lit(0).cast("long").alias(c) for c in ("n_words", "n_removed")), F.array().cast(SPANS).alias("spans"), F.array().cast(COPIES).alias("copies"))
    if repeated_ids(texts):
        rows = _numbered(texts)
        names = rows.select("doc", "row.doc_id")
        out = _spans(rows.select("doc", "row.text"), min_words, num, den, least)
        lead = names.select(F.col("doc").alias("of"), F.col("doc_id").alias("of_doc"))
        copies = out.select("doc", F.explode("copies").alias("c")).select("doc", "c.at", "c.words", F.col("c.of_doc").alias("of"), "c.of_at").join(lead, "of")
        copies = copies.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("at", "words", "of_doc", "of_at"))).alias("copies"))
        out = out.drop("copies").join(copies, "doc", "left").join(names, "doc").withColumn("copies", F.coalesce("copies", F.array().cast(COPIES)))
    else:
        out = _spans(texts.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("doc"), "text"), min_words, num, den, least)
        out = out.withColumn("doc_id", F.col("doc"))
    return out.select("doc_id", "n_words", "n_removed", "spans", "copies").union(nulls)


def _numbered(docs: DataFrame) -> DataFrame:
    """doc, row: rows of which some share a doc_id, written with a number that follows (doc_id, hash of the text)."""
    ordered = docs.where(F.col("doc_id").isNotNull()).orderBy("doc_id", F.xxhash64("text"))
    return cut(ordered.select(F.monotonically_increasing_id().alias("doc"), whole_row(docs)), "numbered")


def whole_row(docs: DataFrame) -> F.Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")


def _spans(keyed: DataFrame, min_words: int, num: int, den: int, least: int) -> DataFrame:
    """doc, n_words, n_removed, spans, copies of ``keyed(doc, text)`` with distinct ``doc``."""
    found = cut(find(keyed, min_words), "repeats")
    of = lambda kind, *cols: found.where(F.col("kind") == kind).select(*(F.col(c).alias(n) for c, n in zip("abcd", cols, strict=False)))
    edges = of(EDGE, "a", "b")
    needed = cut(edges.select(F.col("a").alias("id")).union(edges.select("b")).distinct(), "ids")
    items = needed.select("id", F.lit(0).cast("long").alias("n"), F.col("id").alias("h"))
    asked = cut(ask(keyed, id_filter(needed), id_filter(of(SEEDED, "id")), min_words), "asked")
    lines = cut(asked.where(F.col("kind") == TEXT).select(F.col("a").alias("id"), "text").join(needed, "id", "left_semi"), "lines")
    clusters = cut(verified_components(edges, items, lines, WIDTH, num, den), "clusters")
    release(needed, lines)
    copy, line = of(COPY, "id", "doc", "at", "words"), of(LINE, "id", "doc", "at", "words")
    near = line.join(clusters, "id")
    heads = near.groupBy("component").agg(F.min(F.struct("doc", "at")).alias("head"))
    near = near.join(heads, "component")
    own = copy.select("id").distinct().join(line, "id").join(near.select("id", "head"), "id", "left").select("id", F.coalesce("head", F.struct("doc", "at")).alias("head"))
    copies = near.where(F.struct("doc", "at") != F.col("head")).select("doc", "at", "words", "head").union(copy.join(own, "id").select("doc", "at", "words", "head"))
    passages = asked.where(F.col("kind") == GONE).select(F.col("a").alias("doc"), F.col("b").alias("at"), F.col("c").alias("words"), F.lit(None).cast("struct<doc: bigint, at: bigint>").alias("head"))
    per_doc = copies.union(passages).groupBy("doc").agg(F.collect_list(F.struct("at", "words", F.col("head.doc").alias("of_doc"), F.col("head.at").alias("of_at"))).alias("places"))
    rows = of(ITEM, "doc", "n_words").join(per_doc, "doc", "left").select("doc", "n_words", "places")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            places = batch.column("places")
            size = pc.fill_null(pc.list_value_length(places), 0).to_numpy()
            row = np.repeat(np.arange(n), size)
            flat = places.flatten()
            at, words, of_at = (pc.fill_null(flat.field(c), -1).to_numpy() for c in ("at", "words", "of_at"))
            of_doc, copied = pc.fill_null(flat.field("of_doc"), 0).to_numpy(), pc.is_valid(flat.field("of_doc")).to_numpy(zero_copy_only=False)
            gone = np.flatnonzero(~copied | (words >= least))
            gone = gone[np.lexsort((at[gone], row[gone]))]
            of, begin, count = merged_spans(row[gone], at[gone], words[gone])
            kept = np.flatnonzero(copied)
            kept = kept[np.lexsort((of_at[kept], of_doc[kept], words[kept], at[kept], row[kept]))]
            cols = [
                pa.array(np.bincount(of, count, n).astype(np.int64)), listed(of, n, at=begin, words=count),
                listed(row[kept], n, at=at[kept], words=words[kept], of_doc=of_doc[kept], of_at=of_at[kept]),
            ]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("n_words"), *cols], names=["doc", "n_words", "n_removed", "spans", "copies"])

    return rows.mapInArrow(lean(merge), f"doc long, n_words long, n_removed long, spans {SPANS}, copies {COPIES}")


def remove_spans(docs: DataFrame, min_words: int = 20, num: int = 80, den: int = 100, least: int = 20) -> DataFrame:
    """``docs`` with what repeats taken out of ``text``; what stays keeps its white space.

    A document that repeats others as a whole keeps its row, with what white space is left.
    """
    schema, columns = docs.schema, docs.columns
    if twice := repeated_ids(docs):
        row = _numbered(docs)
    else:
        row = docs.select(F.col("doc_id").alias("doc"), whole_row(docs))
    found = _spans(row.where("doc IS NOT NULL").select("doc", "row.text"), min_words, num, den, least)
    joined = row.join(found.where("n_removed > 0").select("doc", "spans"), "doc", "left").select("row", "spans")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields = dict(zip(columns, batch.column("row").flatten(), strict=True))
            texts = fields["text"].to_pylist()
            for i, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    texts[i] = without(texts[i], [(s["at"], s["words"]) for s in spans])
            fields["text"] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(list(fields.values()), names=columns)

    out = joined.mapInArrow(strip, schema)
    return out.unionByName(docs.where(F.col("doc_id").isNull())) if twice else out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """A text without the words of ``spans``."""
    words = Words([text.encode()])
    raw, out, last = words.data.tobytes()[:-1], [], 0
    for at, n in spans:
        out.append(raw[last : words.starts[at]])
        last = int(words.ends[at + n - 1])
    return b"".join([*out, raw[last:]]).decode()
