"""Content-addressed store of token ids.

File format (all under one folder)::

    chunks/kind=chunk     hash (16 bytes), n, data: ids as little-endian unsigned ints
    chunks/kind=recipe    doc_id, row, n_tokens, hashes, sizes: as encoded, unordered
    recipes/kind=recipe   the same, in ascending doc_id order over files ``part``
                          = 0, 1, ..., with ``start_in_part`` and the Merkle root
    recipes/kind=manifest one row per part: documents, ids, Merkle root of its roots
    root/                 parts, documents, ids and the Merkle root over the parts' roots

A rolling hash over the last 16 ids cuts each document's id stream where its low
bits are zero, so equal stretches give equal chunks wherever they stand. A chunk's
address is a hash of its bytes; each address is stored once. A document is the list
of its chunks' addresses, and the Merkle root over them; a part's root is that of the tree
over its documents' roots in row order, and the store's root that over its parts'.

Reading back (:func:`digests`) reads the chunk files and recomputes every address, every
recipe's root, every part's tree, its documents and ids, and the root of all; it fails if
one differs, if a row, a part or a chunk is missing, or if chunks do not add up to the
ids of a document. The documents' CRCs come from the chunks' CRCs:
``crc(A || B) = shift(crc(A), len(B)) ^ crc(B)``, so nothing but (address, crc, size) is
shuffled. :func:`read_ids` gives the ids themselves.

Scale: chunk bytes cross the network once (by address, after removing a task's own
duplicates, so a chunk that all documents hold arrives once per task). Recipes are
ranged by doc_id and sorted there; trees are built in a stream, holding one hash a level.
A running total over parts, one row each, is the only thing the driver holds.

Defined results: null and empty texts give the end id alone. Rows with equal doc_id
are kept each, in an order fixed by their ids' hash; rows with a null doc_id come
first. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator
from functools import reduce
from operator import xor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracord.llm.bpe import kept
from veracord.llm.common import read_bytes, shared_dir
from veracord.llm.pretokens import Ids, text_groups

ROLL = 16
#: Rows whose texts a task holds as Python objects at a time; bytes of ids after which it gives its chunks on.
ROWS, SENT = 512, 1 << 20
STAGED = "kind string, key long, hash binary, n int, data binary, doc_id long, n_tokens long, hashes array<binary>, sizes array<int>"
_ROLL_POWERS = tuple(pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in (1, 2, 4, 8))


def rolling(ids: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Polynomial hash of the last ROLL ids at each place of a document, mod 2**64 (fewer ids
    at its start). ``ids`` may hold several documents, ``place`` counts within each."""
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    for k, power in zip((1, 2, 4, 8), _ROLL_POWERS, strict=True):
        moved = np.zeros_like(h)
        moved[k:] = h[:-k] * np.uint64(power)
        h = h + np.where(place >= k, moved, np.uint64(0))
    return h ^ (h >> np.uint64(29))


def cut_points(ids: np.ndarray, bounds: np.ndarray, mean: int, least: int, most: int) -> Iterator[list[int]]:
    """For each document (ids from bounds[i] to bounds[i + 1]) the ends of its chunks, counted in it:
    places whose rolling hash has zero low bits, at least ``least`` and at most ``most`` apart."""
    size = np.diff(bounds)
    place = np.arange(len(ids)) - np.repeat(bounds[:-1], size)
    found = np.flatnonzero((rolling(ids, place) & np.uint64(mean - 1)) == 0) + 1
    upto = np.searchsorted(found, bounds, "right").tolist()  # an end at a bound is the document's before it
    places = place[found - 1] + 1
    for i, n in enumerate(size.tolist()):
        ends, last = [], 0
        if n > least:
            for c in places[upto[i] : upto[i + 1]].tolist():
                while c - last > most:
                    last += most
                    ends.append(last)
                if c - last >= least and c < n:
                    ends.append(c)
                    last = c
        while n - last > most:
            last += most
            ends.append(last)
        yield [*ends, n]


class Tree:
    """Root of a binary hash tree over leaves that come in a stream; an odd node moves up as it is."""

    def __init__(self):
        self.stack: list[tuple[int, bytes]] = []

    def add(self, leaf: bytes) -> None:
        height, node = 0, hashlib.blake2b(b"\0" + leaf, digest_size=16).digest()
        while self.stack and self.stack[-1][0] == height:
            node, height = _joined(self.stack.pop()[1], node), height + 1
        self.stack.append((height, node))

    def root(self) -> bytes:
        out = b""
        for _, node in reversed(self.stack):
            out = _joined(node, out) if out else node
        return out or bytes(16)


def _joined(left: bytes, right: bytes) -> bytes:
    return hashlib.blake2b(b"\1" + left + right, digest_size=16).digest()


def merkle(leaves: Iterable[bytes]) -> bytes:
    tree = Tree()
    for x in leaves:
        tree.add(x)
    return tree.root()


def address(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0, mean: int = 256, least: int = 32, most: int = 4096) -> None:
    """Encode every whole text of ``docs(doc_id, text)`` and write the store to ``path``.

    Texts are split into pre-tokens, the tokenizers library encodes each distinct
    pre-token, and what it gave is put together; a text with added tokens in it, or any text
    of a tokenizer that splits in another way, goes to the library whole.
    """
    spark = docs.sparkSession
    raw = spark.sparkContext.broadcast(read_bytes(spark, tokenizer_path))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = kept(("store", hash(raw.value)), lambda: Ids(raw.value))
        kind = coder.kind
        seen: set[bytes] = set()
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            chunks, recipes, size, names = [], [], 0, iter(batch.column("doc_id").to_pylist())
            for texts in text_groups(batch.column("text").to_pylist()):
                ids, bounds = coder(texts)
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                data, width = ids.tobytes(), kind.itemsize
                for begin, ends in zip(bounds.tolist(), cut_points(ids, bounds, mean, least, most), strict=False):
                    hashes, sizes, at = [], [], 0
                    for to in ends:
                        piece = data[(begin + at) * width : (begin + to) * width]
                        h = address(piece)
                        hashes.append(h)
                        sizes.append(to - at)
                        if h not in seen:
                            chunks.append((h, to - at, piece))
                            seen.add(h)
                        at = to
                    recipes.append((next(names), ends[-1], hashes, sizes))
                size += len(data)
                if size > SENT:
                    yield _staged(chunks, recipes)
                    chunks, recipes, size = [], [], 0
            if len(seen) > 300_000:  # only saves shuffling; what comes again is dropped after it
                seen.clear()
            if recipes:
                yield _staged(chunks, recipes)

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All rows with one address are in this task, one behind the other: keep the first."""
        last = None
        for batch in batches:
            keep = []
            for h in batch.column("hash").to_pylist():
                keep.append(h is None or h != last)
                last = h
            yield batch.filter(pa.array(keep, pa.bool_()))

    staged = docs.select("doc_id", "text").mapInArrow(encode, STAGED)
    n = _partitions(spark)
    staged.repartition(n, "key").sortWithinPartitions("hash").mapInArrow(once, STAGED).drop("key").write.partitionBy("kind").option("compression", "lz4_raw").parquet(f"{path}/chunks")
    recipes = spark.read.schema("doc_id long, n_tokens long, hashes array<binary>, sizes array<int>, kind string").parquet(f"{path}/chunks").where("kind = 'recipe'").drop("kind")
    digest = F.sha2(F.concat_ws(",", F.transform("hashes", lambda h: F.hex(h))), 256)
    ranged = recipes.withColumn("tie", digest).repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, start, row, tree = TaskContext.get().partitionId(), 0, 0, Tree()
        names = [f.split()[0] for f in RECIPE.split(", ")]
        for batch in batches:
            counts = np.array(batch.column("n_tokens").to_pylist(), np.int64)
            starts = start + np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            roots = [merkle(h) for h in batch.column("hashes").to_pylist()]
            for r in roots:
                tree.add(r)
            k = batch.num_rows
            cols = [pa.array(["recipe"] * k, pa.string()), pa.array([part] * k, pa.int32()), pa.array(range(row, row + k), pa.int64()), batch.column("doc_id"), batch.column("n_tokens"), batch.column("hashes"), batch.column("sizes"), pa.array(starts[:-1], pa.int64()), pa.array(roots, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)
            start, row = int(starts[-1]), row + k
        if row:
            cols = [(["manifest"], pa.string()), ([part], pa.int32()), ([row], pa.int64()), ([None], pa.int64()), ([start], pa.int64()), ([None], pa.list_(pa.binary())), ([None], pa.list_(pa.int32())), ([None], pa.int64()), ([tree.root()], pa.binary())]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], names=names)

    ranged.mapInArrow(lay, RECIPE).write.partitionBy("kind").parquet(f"{path}/recipes")
    parts = _manifest_rows(spark, path)
    whole = (len(parts), sum(p.documents for p in parts), sum(p.ids for p in parts), merkle(p.root for p in parts))
    spark.createDataFrame([whole], "parts long, documents long, ids long, root binary").coalesce(1).write.parquet(f"{path}/root")


RECIPE = "kind string, part int, row long, doc_id long, n_tokens long, hashes array<binary>, sizes array<int>, start_in_part long, root binary"


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def _staged(chunks: list, recipes: list) -> pa.RecordBatch:
    c, r = len(chunks), len(recipes)
    keys = [int.from_bytes(h[:8], "little", signed=True) for h, _, _ in chunks] + [zlib.crc32(str(x[0]).encode()) for x in recipes]
    cols = (
        (["chunk"] * c + ["recipe"] * r, pa.string()), (keys, pa.int64()), ([x[0] for x in chunks] + [None] * r, pa.binary()), ([x[1] for x in chunks] + [None] * r, pa.int32()),
        ([x[2] for x in chunks] + [None] * r, pa.binary()), ([None] * c + [x[0] for x in recipes], pa.int64()), ([None] * c + [x[1] for x in recipes], pa.int64()),
        ([None] * c + [x[2] for x in recipes], pa.list_(pa.binary())), ([None] * c + [x[3] for x in recipes], pa.list_(pa.int32())),
    )
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in cols], names=["kind", "key", "hash", "n", "data", "doc_id", "n_tokens", "hashes", "sizes"])


def _laid(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(", ".join([*RECIPE.split(", ")[1:], "kind string"])).parquet(f"{path}/recipes").where(F.col("kind") == kind).drop("kind")


def _manifest_rows(spark: SparkSession, path: str) -> list:
    """(part, documents, ids, root) of every part, in order: as many rows as the store has parts."""
    return _laid(spark, path, "manifest").select("part", F.col("row").alias("documents"), F.col("n_tokens").alias("ids"), "root").orderBy("part").collect()


class Damaged(ValueError):
    """The store is not what was written."""


def verified_parts(spark: SparkSession, path: str) -> list:
    """The manifest's rows, held against the root of the store and against the recipes that are there."""
    parts = _manifest_rows(spark, path)
    top = spark.read.schema("parts long, documents long, ids long, root binary").parquet(f"{path}/root").collect()
    whole = (len(parts), sum(p.documents for p in parts), sum(p.ids for p in parts), merkle(p.root for p in parts))
    if len(top) != 1 or (*top[0][:3], bytes(top[0][3])) != whole:
        raise Damaged("the manifest does not match the root of the store")
    there = _laid(spark, path, "recipe").groupBy("part").agg(F.count("*").alias("k"), F.sum("n_tokens").alias("n")).collect()
    if {(r.part, r.k, r.n) for r in there} != {(p.part, p.documents, p.ids) for p in parts}:
        raise Damaged("recipes are missing or there are too many")
    return parts


def chunk_table(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("hash binary, n int, data binary, kind string").parquet(f"{path}/chunks").where("kind = 'chunk'").drop("kind")


def recipe_table(spark: SparkSession, path: str, parts: list | None = None) -> DataFrame:
    """Recipes with ``start``: ids of all documents before, from the manifest's totals (one row per part)."""
    before, rows = 0, []
    for p in parts or verified_parts(spark, path):
        rows.append((p.part, before))
        before += p.ids
    offsets = spark.createDataFrame(rows, "part int, before long")
    return _laid(spark, path, "recipe").join(F.broadcast(offsets), "part").withColumn("start", F.col("before") + F.col("start_in_part")).drop("before", "start_in_part")


def _zero_operators() -> np.ndarray:
    """[bit of the length, byte place, byte value] -> CRC register after 2**bit zero bytes."""
    rows = [1 << (i - 1) if i else 0xEDB88320 for i in range(32)]  # one zero bit

    def times(v: int) -> int:
        return reduce(xor, (rows[i] for i in range(32) if v >> i & 1), 0)

    values, out = np.arange(256), np.zeros((48, 4, 256), np.uint32)
    for bit in range(-3, 48):
        if bit >= 0:
            for i in range(32):
                out[bit, i // 8] ^= np.where(values >> (i % 8) & 1, np.uint32(rows[i]), np.uint32(0))
        rows = [times(r) for r in rows]
    return out


def shift_crcs(crcs: np.ndarray, zeros: np.ndarray, table: np.ndarray) -> np.ndarray:
    """CRC registers after so many zero bytes each."""
    c = crcs.astype(np.uint32).copy()
    for bit in range(48):
        on = (zeros >> bit) & 1 == 1
        if on.any():
            v = c[on]
            c[on] = table[bit, 0, v & 255] ^ table[bit, 1, v >> 8 & 255] ^ table[bit, 2, v >> 16 & 255] ^ table[bit, 3, v >> 24]
    return c


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files; fails on any damage."""

    def check_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crcs = []
            for h, n, data in zip(*(batch.column(c).to_pylist() for c in ("hash", "n", "data")), strict=True):
                if address(data) != h:
                    raise ValueError(f"chunk {h.hex()} does not match its address")
                crcs.append(zlib.crc32(data if len(data) == 4 * n else np.frombuffer(data, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), pa.array(crcs, pa.int64()), pa.array(batch.column("n"), pa.int32())], names=["hash", "crc", "n"])

    parts = verified_parts(spark, path)
    wanted = {p.part: bytes(p.root) for p in parts}

    def steps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each chunk of each document, with the bytes that follow it there. Rows come in (part, row) order."""
        now, tree, rows = None, Tree(), 0

        def close() -> None:
            if now is not None and tree.root() != wanted.get(now):
                raise Damaged(f"part {now} does not match its root")

        for batch in batches:
            doc, hashes, after, size = [], [], [], []
            cols = (batch.column(c).to_pylist() for c in ("part", "row", "n_tokens", "hashes", "sizes", "root"))
            for part, row, n, hs, ss, root in zip(*cols, strict=True):
                if part != now:
                    close()
                    now, tree, rows = part, Tree(), 0
                if merkle(hs) != root or row != rows or sum(ss) != n:
                    raise Damaged(f"recipe {row} of part {part} does not match its root or place")
                tree.add(root)
                rows += 1
                left = n
                for h, s in zip(hs, ss, strict=True):
                    left -= s
                    doc.append(part << 40 | row)
                    hashes.append(h)
                    after.append(4 * left)
                    size.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(hashes, pa.binary()), pa.array(after, pa.int64()), pa.array(size, pa.int32())], names=["at", "hash", "after", "size"])
        close()

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _zero_operators()
        for batch in batches:
            got = shift_crcs(batch.column("crc").to_numpy(), batch.column("after").to_numpy(), table)
            yield pa.RecordBatch.from_arrays([batch.column("at"), pa.array(got.astype(np.int64)), batch.column("size")], names=["at", "crc", "size"])

    if not parts:
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    recipes = recipe_table(spark, path, parts)
    chunks = chunk_table(spark, path).mapInArrow(check_chunks, "hash binary, crc long, n int")
    ordered = _laid(spark, path, "recipe").select("part", "row", "n_tokens", "hashes", "sizes", "root").repartitionById(max(p.part for p in parts) + 1, "part").sortWithinPartitions("part", "row")
    uses = ordered.mapInArrow(steps, "at long, hash binary, after long, size int")
    joined = uses.join(chunks, "hash", "left")
    whole = F.assert_true(F.col("crc").isNotNull() & (F.col("n") == F.col("size")), "a recipe names a chunk that is missing or of another size")
    shifted = joined.select("at", F.coalesce(whole.cast("long"), F.col("crc")).alias("crc"), "after", "size").mapInArrow(shift, "at long, crc long, size int")
    per_doc = shifted.groupBy("at").agg(F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("got"))
    docs = recipes.select("doc_id", "start", "n_tokens", F.shiftleft(F.col("part").cast("long"), 40).bitwiseOR(F.col("row")).alias("at"))
    same = F.assert_true(F.col("got") == F.col("n_tokens"), "the chunks of a document do not add up to its ids")
    return docs.join(per_doc, "at").select("doc_id", "start", "n_tokens", F.coalesce(same.cast("long"), F.col("ids_crc32")).alias("ids_crc32"))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start and the ids themselves, put together from the chunks, document by document."""
    recipes = recipe_table(spark, path)
    uses = recipes.select("part", "row", F.posexplode("hashes").alias("i", "hash"))
    rows = uses.join(chunk_table(spark, path), "hash").groupBy("part", "row").agg(F.sort_array(F.collect_list(F.struct("i", "n", "data"))).alias("chunks"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.concatenate([np.frombuffer(c["data"], "<u2" if len(c["data"]) == 2 * c["n"] else "<u4").astype(np.int64) for c in row]) for row in batch.column("chunks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return recipes.select("part", "row", "doc_id", "start").join(rows, ["part", "row"]).mapInArrow(put, "doc_id long, start long, ids array<long>")


def op7(spark: SparkSession, docs: DataFrame, tokenizer_path: str) -> DataFrame:
    path = shared_dir(spark, "token-store")
    write_store(docs, path, tokenizer_path)
    return digests(spark, path)
