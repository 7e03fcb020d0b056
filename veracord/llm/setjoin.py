"""Exact set-similarity self-join on word shingles, as components.

Method
------
1. *Thinning.* A document of which more than ``n - ceil(t n)`` shingles stand in no other has
   no link. One pass counts, exactly, which of a quarter of all shingles stand in one
   document only; most documents go here, and only their sizes are kept.
2. *Prefixes.* One pass over what is left counts shingles in ``2**BITS`` slots. Ordered by their slot's
   count, rare ones first, two sets with Jaccard >= t share a shingle among the first
   ``n - ceil(t n) + 1`` of each: what many documents share stands at the end of the
   order, so that documents which have only a common passage in common do not meet. The
   order need only be the same everywhere; counts that collide in a slot cost candidates,
   never links, and the table of counts has a fixed size.
3. *Neighbourhoods.* The documents of a prefix shingle are joined to one of them as a
   star: edges, never pairs. A task first does so for its own rows, so a shingle that a
   third of all documents share arrives once per task. The components of the stars hold
   every link.
   Neighbourhoods of more than a cell of documents are thinned by themselves, over half of
   all shingles. What is left there goes through steps 2 and 3 once more.
4. *T-occurrence search* within neighbourhoods, over classes of equal sets, in cells of
   bounded size: inverted lists of the cell's shingles; for each document the shortest
   lists are heap-merged, and the ``L`` longest are only probed by binary search for
   what occurs at least ``T - L`` times (DivideSkip), ``T`` being the overlap that the
   threshold asks for.
5. A neighbourhood of more documents than a cell takes falls into bands of size, each
   document in two of them, so that sizes that can be linked share a band. A band of
   several cells has its smallest document in each of them. What is then not in the
   band's largest component is searched for against all of its cells, so no link
   between different components is missed. Such a band without links is compared whole,
   cells by cells: its cost grows with the square of its size.
6. Components of the links.

Shingles move packed by task and bucket; rows are (id, size, hash), and the texts of
documents that have a neighbour. Nothing about all documents reaches the driver but
the table of counts. Tables that are read no more are removed.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracord.llm.common import cut, dealt_join, release
from veracord.llm.graph import components
from veracord.llm.vector import PACKED, SUB, U, Words, dealt, forest, grouped, lean, mix, packed, shingle_sets, shuffle_packed, unpacked

#: Documents and shingles of a cell, about, which bound a task's memory; prefix shingles that a task holds before it gives them on.
CELL, CELL_TOKENS, HELD = 512, 2_000_000, 800_000
#: Elements of short lists up to which they are merged by a heap, beyond by one stable merge sort.
HEAP = 2_000
#: Slots of the counts that order the shingles, and pieces in which they are summed.
BITS, PIECES = 24, 64


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingles of each text of a column."""
    for _, texts in grouped(column):
        yield from shingle_sets(Words(texts), width)


def set_hash(tokens: np.ndarray) -> int:
    """Signed 64-bit hash of a set; used together with its size."""
    return int(mix(np.array([np.add.reduce(mix(tokens + U(0x2545F4914F6CDD1D)), dtype=np.uint64) + U(len(tokens))], np.uint64)).view(np.int64)[0])


def levels(texts: DataFrame, width: int) -> np.ndarray:
    """A byte for each slot: eighths of the logarithm of how often its shingles stand in ``texts``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.uint32)
        for batch in batches:
            for _, group in grouped(batch.column("text")):
                slots = [x >> U(64 - BITS) for x in shingle_sets(Words(group), width)]
                np.add.at(total, np.concatenate(slots).astype(np.int64), np.uint32(1))
        for i, piece in enumerate(total.reshape(PIECES, -1)):
            if piece.any():
                planes = piece.view(np.uint8).reshape(-1, 4).T.tobytes()  # byte by byte: the upper ones are mostly zero
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(planes, "zstd", asbytes=True)], pa.binary())], names=["piece", "data"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << BITS) // PIECES
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, data in zip(batch.column("piece").to_pylist(), batch.column("data").to_pylist(), strict=True):
                planes = np.frombuffer(pa.decompress(data, 4 * size, "zstd", asbytes=True), np.uint8).reshape(4, -1)
                counts = np.ascontiguousarray(planes.T).view(np.uint32).ravel()
                total[i] = total.get(i, np.zeros(size, np.int64)) + counts
        for i, counts in total.items():
            level = np.minimum(255, np.log2(counts + 1.0) * 8).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([level], pa.binary())], names=["piece", "data"])

    ddl = "piece int, data binary"
    out = np.zeros((PIECES, (1 << BITS) // PIECES), np.uint8)
    pieces = cut(texts.select("text").mapInArrow(lean(count), ddl).repartition(PIECES, "piece").mapInArrow(lean(add), ddl), "levels")
    for i, data in pieces.toLocalIterator():  # of files: a partition of sums would be made only when its turn comes
        out[i] = np.frombuffer(data, np.uint8)
    release(pieces)
    return out.ravel()


def prefix(tokens: np.ndarray, level: np.ndarray, num: int, den: int) -> np.ndarray:
    """The first shingles of a set, by (level, hash), of which sets that can be linked share one."""
    n = len(tokens)
    if not n:
        return tokens
    keep = n - -(-num * n // den) + 1
    key = level[(tokens >> U(64 - BITS)).astype(np.int64)].astype(np.uint64) << U(56) | tokens >> U(8)
    return np.partition(key, keep - 1)[:keep] if keep < n else key


STAR = "kind int, a long, b long, c long"
SIG, EDGE, ITEM = range(3)


def star_batch(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    n, zero = len(cols[0]), np.zeros(len(cols[0]), np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *(pa.array(c, pa.int64()) for c in (*cols, zero, zero)[:3])], names=["kind", "a", "b", "c"])


def star_edges(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sorted signatures, a leader of each; nodes that have another leader, that leader)."""
    order = np.argsort(sig, kind="stable")
    s, a = sig[order], node[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    leader = a[first][np.cumsum(first) - 1]
    other = a != leader
    return s[first], a[first], a[other], leader[other]


class Sender:
    """Collects signatures of a task; gives (bucket, kind, data) rows of one row for each signature
    and of a forest of the task's own stars."""

    def __init__(self, parts: int):
        self.parts, self.sigs, self.nodes, self.held = parts, [], [], 0

    def add(self, sig: np.ndarray, nodes: np.ndarray) -> None:
        self.sigs.append(sig)
        self.nodes.append(nodes)
        self.held += len(sig)

    def flush(self) -> list[tuple[int, int, bytes]]:
        if not self.held:
            return []
        sig, leader, a, b = star_edges(np.concatenate(self.sigs), np.concatenate(self.nodes))
        self.sigs, self.nodes, self.held = [], [], 0
        return dealt(SIG, self.parts, sig, leader) + self.by_node(EDGE, *forest(a, b))

    def by_node(self, kind: int, a: np.ndarray, *cols: np.ndarray) -> list[tuple[int, int, bytes]]:
        key = mix(a.view(np.uint64))
        order = np.argsort(key)
        return dealt(kind, self.parts, key[order], a[order], *(c[order] for c in cols))


class StarFold:
    """Receives what Sender has sent: star edges, as a forest of what a task has; items."""

    def __init__(self):
        self.edges, self.held = [], 0

    def fold(self, kind: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == ITEM:
            yield star_batch(ITEM, *unpacked(data, 4)[1:])
            return
        if kind == EDGE:
            self.edges.append(tuple(unpacked(data, 3)[1:]))
        else:
            self.edges.append(star_edges(*unpacked(data, 2))[2:])
        self.held += len(self.edges[-1][0])
        if self.held > HELD:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield star_batch(EDGE, *forest(*(np.concatenate(x) for x in zip(*self.edges, strict=True))))
        self.edges, self.held = [], 0


def set_stars(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """STAR rows of ``texts(id, text)``: EDGE (a, b), ITEM (id, set size, set hash)."""
    parts = partitions(texts)
    level = texts.sparkSession.sparkContext.broadcast(levels(texts, width))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(parts)
        for batch in batches:
            ids, sizes, hashes = batch.column("id").to_numpy(), [], []
            for node, tokens in zip(ids, text_sets(batch.column("text"), width), strict=True):
                sig = prefix(tokens, level.value, num, den)
                sender.add(mix(sig), np.full(len(sig), node, np.int64))
                sizes.append(len(tokens))
                hashes.append(set_hash(tokens))
                if sender.held > HELD:
                    yield packed(sender.flush(), parts)
            if len(ids):
                yield packed(sender.by_node(ITEM, ids.astype(np.int64), np.array(sizes, np.int64), np.array(hashes, np.int64)), parts)
        if sender.held:
            yield packed(sender.flush(), parts)

    stars = cut(shuffle_packed(texts.select("id", "text").mapInArrow(lean(send), PACKED), StarFold, STAR, parts), "stars")
    level.destroy()
    return stars


def t_occurrence_links(sets: list[np.ndarray], num: int, den: int, query: list[bool] | None = None, mu: float = 0.01) -> list[tuple[int, int]]:
    """Links between ``sets`` (indexes) whose Jaccard is at least num / den, as a spanning forest.

    Only sets marked in ``query`` search; the others are only found. Links within what
    is already one component are not verified.
    """
    m = len(sets)
    order = sorted(range(m), key=lambda i: len(sets[i]))
    sizes = np.array([len(sets[i]) for i in order])
    if m < 2:
        return []
    tokens, inverse = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    owner = np.repeat(np.arange(m), sizes)
    lists = inverse.astype(np.int64) * m + owner  # sorted: list after list, each ascending
    place = np.split(inverse, np.cumsum(sizes)[:-1])
    lists.sort()
    begin = np.searchsorted(lists, np.arange(len(tokens) + 1) * m)
    length = np.diff(begin)
    parent = list(range(m))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for q in range(m):
        a = int(sizes[q])
        if not a or (query is not None and not query[order[q]]):
            continue
        low = -(-num * a // den)
        least = -(-num * (a + low) // (num + den))
        by_length = place[q][np.argsort(length[place[q]], kind="stable")]
        n_long = min(least - 1, int(least / (mu * np.log2(max(2, length[by_length[-1]])) + 1)))
        short, long = by_length[: a - n_long], by_length[a - n_long :]
        short = short[length[short] > 1]
        runs = [lists[begin[t] : begin[t + 1]] - t * m for t in short]
        if sum(map(len, runs)) <= HEAP:
            merged = [(r, sum(1 for _ in found)) for r, found in groupby(heapq.merge(*(x.tolist() for x in runs)))]
        else:
            ids, counts = np.unique(np.sort(np.concatenate(runs), kind="stable"), return_counts=True)
            enough = counts >= least - n_long
            merged = list(zip(ids[enough].tolist(), counts[enough].tolist(), strict=True))
        for r, seen in merged:
            b = int(sizes[r])
            if r == q or seen < least - n_long or b < low or b * num > a * den or root(r) == root(q):
                continue
            if r > q and (query is None or query[order[r]]):
                continue  # r will find q
            need = -(-num * (a + b) // (num + den))
            if seen + len(long) < need:
                continue
            probe = long * m + r
            at = np.minimum(np.searchsorted(lists, probe), len(lists) - 1)
            both = seen + int((lists[at] == probe).sum())
            if den * both >= num * (a + b - both):
                links.append((order[q], order[r]))
                parent[root(q)] = root(r)
    return links


def cell_search(width: int, num: int, den: int):
    """mapInArrow function over rows sorted by cell: the links of each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ids, sets, query = None, [], [], []

        def links() -> pa.RecordBatch:
            found = t_occurrence_links(sets, num, den, query)
            return pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in found], pa.int64()), pa.array([ids[j] for _, j in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("cell", "nb", "id", "query")), text_sets(batch.column("text"), width), strict=True)
            for cell, nb, node, asks, tokens in rows:
                if (cell, nb) != now:
                    if len(ids) > 1:
                        yield links()
                    now, ids, sets, query = (cell, nb), [], [], []
                if ids and ids[-1] == node:
                    query[-1] = query[-1] or asks
                else:
                    ids.append(node)
                    sets.append(tokens)
                    query.append(asks)
        if len(ids) > 1:
            yield links()

    return run


def _search(cells: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    key = F.xxhash64("nb", "band", "cell", "qcell").alias("cell")
    rows = dealt_join(texts, cells, "id").select(key, "nb", "id", "query", "text")
    return rows.repartition(partitions(cells), "cell").sortWithinPartitions("cell", "nb", "id").mapInArrow(lean(cell_search(width, num, den)), "a long, b long")


#: Values of the hash by which texts are passed over before a join. They are broadcast as bits, 64 to
#: a row: at most 131,072 rows, however many texts there are.
SLOTS = 1 << 23


def slots_of(ids: DataFrame) -> DataFrame:
    """word, marks: a bit for each hash of ``ids(id)``, 64 of them in a number."""
    slot = F.expr(f"pmod(xxhash64(id), {SLOTS}L)").alias("slot")
    return ids.select(slot).groupBy(F.expr("slot div 64").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 AS int)))").alias("marks"))


def texts_of(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """``texts`` of ``ids(id)``, written. Texts whose id has another hash than all of ``ids`` are left
    where they are; when the hashes fill, the join that follows has all texts to move, no more."""
    slot = f"pmod(xxhash64(id), {SLOTS}L)"
    marked = F.expr(f"{slot} div 64 = word AND getbit(marks, cast({slot} % 64 AS int)) = 1")
    near = texts.join(F.broadcast(slots_of(ids)), marked, "left_semi")
    return cut(dealt_join(near, ids, "id", "left_semi"), "texts")


COUNT = 3


def by_bucket(parts: int, node: np.ndarray, count: np.ndarray) -> list[tuple[int, int, bytes]]:
    """COUNT rows (bucket, kind, data) in the buckets in which Sender.by_node puts the nodes."""
    key = mix(node.view(np.uint64))
    order = np.argsort(key)
    n = parts * SUB
    bounds = [0, *np.searchsorted(key[order], np.array([(i << 64) // n for i in range(1, n)], np.uint64)).tolist(), len(key)]
    count, node = count.astype(np.uint32)[order], node[order]
    return [(i, COUNT, count[x:y].tobytes() + node[x:y].tobytes()) for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x]


def summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, sum) from arrays (count, node)."""
    count, node = (np.concatenate(x) for x in zip(*counts, strict=True))
    own, at = np.unique(node, return_inverse=True)
    return own, np.bincount(at, count, len(own)).astype(np.int64)


class ThinFold:
    """Counts, for each node, the shingles that others have sent too. Gives PACKED rows by node: what a
    task has counted, and the items as they came. Nodes that share nothing get no count."""

    def __init__(self, parts: int):
        self.parts, self.counts, self.held = parts, [], 0

    def fold(self, kind: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == ITEM:
            key, *cols = unpacked(data, 5)
            order = np.argsort(key.view(np.uint64))
            yield packed(dealt(ITEM, self.parts, key.view(np.uint64)[order], *(c[order] for c in cols)), self.parts)
            return
        first, node = (np.concatenate(x) for x in zip(*(halves(d) for d in data), strict=True))
        if kind == COUNT:
            self.counts.append((first, node))
        else:
            order = np.argsort(first)
            t = first[order]
            edge = np.concatenate([[True], t[1:] != t[:-1], [True]])
            shared = node[order][~(edge[:-1] & edge[1:])]
            own, count = np.unique(shared[shared != SEVERAL], return_counts=True)
            self.counts.append((count, own))
        self.held += len(self.counts[-1][0])
        if self.held > HELD:
            yield from self.end()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.held:
            yield packed(by_bucket(self.parts, *summed(self.counts)), self.parts)
        self.counts, self.held = [], 0


class CountFold:
    """Joins the items of a bucket of nodes with the counts of their shared shingles: one row for each item."""

    def __init__(self):
        self.items, self.counts = None, []

    def fold(self, kind: int, data: list[bytes]) -> Iterator[pa.RecordBatch]:
        if kind == ITEM:  # the first kind of a bucket
            yield from self.end()
            self.items = unpacked(data, 5)[1:]
        else:
            self.counts += [halves(d) for d in data]

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.items is not None:
            node, n, h, sampled = self.items
            shared = np.zeros(len(node), np.int64)
            if self.counts:
                own, count = summed(self.counts)
                at = np.minimum(np.searchsorted(own, node), len(own) - 1)
                shared = np.where(own[at] == node, count[at], 0)
            cols = (node, n, h, np.maximum(sampled - shared, 0))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["id", "n", "h", "alone"])
        self.items, self.counts = None, []


#: Stands for the nodes of a shingle that a task has met more than once.
SEVERAL = np.iinfo(np.int64).min


def halves(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(32 bits of each shingle, or a count; its node). Shingles of a bucket that agree in these bits
    count as shared, which spares a set, and loses none."""
    n = len(data) // 12
    return np.frombuffer(data, np.uint32, n), np.frombuffer(data, np.int64, n, 4 * n)


def unshared(texts: DataFrame, width: int, every: int) -> DataFrame:
    """id, n (set size), h (set hash), alone (how many of one in ``every`` shingles of the set stand in
    no other set) of each row of ``texts(id, text)``.

    Shingles are dealt to a quarter of the usual partitions, in as many buckets; a task holds
    one bucket at a time. What it has counted goes packed by node, at most one number for each
    shared shingle that was sent, however many partitions there are."""
    parts = max(1, partitions(texts) // 4)
    n_buckets = parts * SUB * 4

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, held, size = Sender(parts), [], 0

        def flush() -> list[tuple[int, int, bytes]]:
            token, node = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.argsort(token)
            token, node = token[order], node[order]
            first = np.concatenate([[True], token[1:] != token[:-1]])
            again = np.concatenate([~first[1:], [False]])
            held.clear()
            own, count = np.unique(node[again | ~first], return_counts=True)
            token, node = token[first], np.where(again, SEVERAL, node)[first]
            bounds = [0, *np.searchsorted(token, np.array([(i << 64) // n_buckets for i in range(1, n_buckets)], np.uint64)).tolist(), len(token)]
            low = token.astype(np.uint32)  # the lower bits; the upper ones choose the bucket
            return [(i, SIG, low[x:y].tobytes() + node[x:y].tobytes()) for i, (x, y) in enumerate(zip(bounds, bounds[1:], strict=False)) if y > x] + by_bucket(parts, own, count)

        for batch in batches:
            ids, sizes, hashes, sampled = batch.column("id").to_numpy().astype(np.int64), [], [], []
            for node, tokens in zip(ids, text_sets(batch.column("text"), width), strict=True):
                sizes.append(len(tokens))
                hashes.append(set_hash(tokens))
                some = mix(tokens[tokens % U(every) == 0])
                sampled.append(len(some))
                held.append((some, np.full(len(some), node)))
                size += len(some)
                if size > HELD:
                    yield packed(flush(), parts)
                    size = 0
            if len(ids):
                yield packed(sender.by_node(ITEM, ids, *(np.array(x, np.int64) for x in (sizes, hashes, sampled))), parts)
        if size:
            yield packed(flush(), parts)

    counts = shuffle_packed(texts.select("id", "text").mapInArrow(lean(send), PACKED), lambda: ThinFold(parts), PACKED, parts)
    return cut(shuffle_packed(counts, CountFold, "id long, n long, h long, alone long", parts), "unshared")


def may_link(rows: DataFrame, num: int, den: int) -> DataFrame:
    """id of the sets of ``unshared`` that can have a link: at most ``n - ceil(t n)`` shingles are not shared."""
    most = F.col("n") - F.ceil(F.col("n") * num / F.lit(den).cast("decimal(10,0)")).cast("long")
    return rows.where((F.col("n") > 0) & (F.col("alone") <= most)).select("id")


def thinned(texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """``texts(id, text)`` of distinct sets without those of which too much stands in no other set to have a link."""
    rows = unshared(texts, width, 2)
    stays = cut(may_link(rows, num, den), "stays")
    out = texts_of(texts, stays)
    release(rows, stays)
    return out


def verified_components(edges: DataFrame, items: DataFrame, texts: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """id, component of all items that have a link, from candidate ``edges(a, b)``.

    ``items(id, n, h)`` describe the sets; ``texts(id, text)`` hold the texts they came from,
    one for each id or several of one set.
    """
    hoods = components(edges).select(F.col("node").alias("id"), F.col("component").alias("nb"))
    members = cut(dealt_join(items.groupBy("id").agg(F.min(F.struct("n", "h")).alias("s")).select("id", "s.n", "s.h"), hoods, "id").select("id", "nb", "n", "h"), "members")
    classes = members.groupBy("nb", "n", "h").agg(F.min("id").alias("rep"), F.count("*").alias("k"))
    counts = classes.groupBy("nb").agg(F.count("*").alias("m")).where("m > 1")
    reps = cut(classes.join(counts, "nb").select("nb", F.col("rep").alias("id"), "n", "m"), "reps")
    texts = texts_of(texts, reps.select("id"))
    done = [reps, texts]
    if not (large := reps.where(F.col("m") > CELL)).isEmpty():
        own = texts_of(texts, large.select("id"))
        left = thinned(own, width, num, den)
        release(own)
        stars = set_stars(left, width, num, den)
        again = cut(components(stars.where(F.col("kind") == EDGE).select("a", "b")), "again")
        placed = again.select(F.col("node").alias("id"), F.col("component").alias("nb"))
        placed = dealt_join(placed, large.select("id", "n"), "id")
        counts = placed.groupBy("nb").agg(F.count("*").alias("m"))
        reps = cut(reps.where(F.col("m") <= CELL).union(placed.join(counts, "nb").select("nb", "id", "n", "m")), "reps")
        release(left, stars)
        done += [again, reps]
    # a large neighbourhood falls apart by size: linked sizes are in one band or in two next to each other
    band = F.floor(F.log(F.greatest("n", F.lit(1))) / (math.log(den / num) * (1 + 1e-9))).cast("long")  # a shade wider, against rounding
    own = reps.select("nb", F.when(F.col("m") > CELL, band).otherwise(-1).alias("band"), "id", "n", F.lit(True).alias("query"))
    above = own.where("band >= 0").withColumn("band", F.col("band") + 1).withColumn("query", F.lit(False))
    placed = own.union(above.join(own.select("nb", "band").distinct(), ["nb", "band"], "left_semi").select(own.columns))
    count = F.greatest(F.ceil(F.count("*") / CELL), F.ceil(F.sum("n") / CELL_TOKENS)).cast("long")
    sizes = placed.groupBy("nb", "band").agg(count.alias("cells"), F.min("id").alias("lead"))
    placed = cut(placed.join(sizes, ["nb", "band"]).withColumn("cell", F.pmod(F.xxhash64("id"), F.col("cells"))), "placed")
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    leads = placed.where("id = lead AND cells > 1").withColumn("cell", each("cells"))
    first = placed.select("nb", "band", "cell", "id", "query").union(leads.select("nb", "band", "cell", "id", F.lit(True)))
    links = cut(_search(first.withColumn("qcell", F.lit(0).cast("long")), texts, width, num, den), "links")
    done += [placed, links]
    large = placed.where("cells > 1")
    if not large.isEmpty():
        linked = components(links)
        large = cut(dealt_join(large, linked, large["id"] == linked["node"], "left").select("nb", "band", "cell", "cells", "id", F.coalesce("component", "id").alias("part")), "large")
        shares = large.groupBy("nb", "band", "part").agg(F.count("*").alias("k"))
        most = shares.groupBy("nb", "band").agg(F.max_by("part", F.struct("k", -F.col("part"))).alias("most"), F.sum("k").alias("all"), F.max("k").alias("k"))
        share = (F.col("all") - F.col("k")) / F.col("all")  # of the band that asks, in cells of the same size
        sizes = large.groupBy("nb", "band").agg(F.max("cells").alias("cells"))
        rest = most.where("all > k").join(sizes, ["nb", "band"]).select("nb", "band", "most", F.greatest(F.ceil(share * F.col("cells")), F.lit(1)).cast("long").alias("qcells"))
        both = large.join(rest, ["nb", "band"])
        asks = both.where("part != most").select("nb", "band", each("cells").alias("cell"), "id", F.lit(True).alias("query"), F.pmod(F.xxhash64("id", F.lit(1)), "qcells").alias("qcell"))
        found = both.select("nb", "band", "cell", "id", F.lit(False).alias("query"), each("qcells").alias("qcell"))
        more = cut(_search(asks.union(found), texts, width, num, den), "links")
        links, done = links.union(more), [*done, large, more]
    many = classes.where("k > 1").select("nb", "n", "h", "rep")
    same = members.join(many, ["nb", "n", "h"]).where("id != rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    out = components(links.union(same)).select(F.col("node").alias("id"), "component")
    release(members, *done)
    return out


def set_components(texts: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(id, n, h of every row; id, component of the linked) of ``texts(id, text)``, ids not null.

    Rows that share an id must have equal sets.
    """
    rows = unshared(texts, width, 4)
    items = rows.select("id", "n", "h")
    stays = cut(may_link(rows, num, den), "stays")
    left = texts_of(texts, stays)
    stars = set_stars(left, width, num, den)
    found = verified_components(stars.where(F.col("kind") == EDGE).select("a", "b"), dealt_join(items, stays, "id", "left_semi"), left, width, num, den)
    release(stars, left, stays)
    return items, found


def repeated_ids(docs: DataFrame) -> bool:
    """Whether rows share a doc_id; reads that column alone."""
    return not docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").isEmpty()


def row_key() -> F.Column:
    """A number for rows of the same doc_id and text."""
    return F.xxhash64("doc_id", "text", F.col("text").isNull())


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs(doc_id, text)``.

    Documents link when ``den * |A and B| >= num * |A or B|`` over their distinct shingles
    of ``width`` words (A-Z lower-cased; a text with fewer words is one shingle).
    component_id is the smallest doc_id reachable by links.

    Null and empty texts have no shingle and no link. Rows that share a doc_id are searched
    each; a doc_id is linked with what any of its rows is linked with. A null doc_id has no
    link and a null component. Extra columns are ignored; an empty table gives no rows.
    """
    texts = docs.select("doc_id", "text")
    keyed = texts.where(F.col("doc_id").isNotNull())
    if repeated_ids(texts):
        rows = keyed.select(row_key().alias("id"), "doc_id", "text")
        items, found = set_components(rows.select("id", "text"), width, num, den)
        names = rows.select("id", "doc_id").distinct()
        lead = names.select(F.col("id").alias("component"), F.col("doc_id").alias("b"))
        found = components(dealt_join(dealt_join(found, names, "id"), lead, "component").select(F.col("doc_id").alias("a"), "b"))
        items = dealt_join(items, names, "id").select(F.col("doc_id").alias("id"), "n")
        found = found.select(F.col("node").alias("id"), "component")
    else:
        items, found = set_components(keyed.select(F.col("doc_id").alias("id"), "text"), width, num, den)
    out = dealt_join(items, found, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"))
    return out.unionByName(texts.where(F.col("doc_id").isNull()).mapInArrow(_sizes(width), "doc_id long, n_shingles long, component_id long"))


def one_of_each(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of near duplicates: that of the smallest doc_id, of
    several such rows the one with the smallest hash. Rows that share a doc_id but have no
    link stay each. Rows without a doc_id stay; null and empty texts have no duplicates."""
    keyed = docs.where(F.col("doc_id").isNotNull())
    if not repeated_ids(docs):
        _, found = set_components(keyed.select(F.col("doc_id").alias("id"), "text"), width, num, den)
        gone = found.where("id != component").select(F.col("id").alias("doc_id"))
        return dealt_join(docs, gone, "doc_id", "left_anti").select(*docs.columns)
    rows = keyed.select(row_key().alias("id"), "doc_id", "text")
    _, found = set_components(rows.select("id", "text"), width, num, den)
    names = rows.select("id", "doc_id").distinct()
    placed = cut(dealt_join(names, found, "id"), "placed")
    stays = placed.groupBy("component").agg(F.min(F.struct("doc_id", "id")).alias("s")).select("s.id")
    gone = placed.select("id").exceptAll(stays)
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")
    kept = dealt_join(keyed.select(row_key().alias("key"), whole), gone.withColumnRenamed("id", "key"), "key", "left_anti")
    linked = placed.select(F.col("id").alias("key")).distinct()
    alone = dealt_join(kept, linked, "key", "left_anti").select("row.*")
    of_group = dealt_join(kept, linked, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64(F.to_json("row"))).alias("row")).select("row.*")
    return alone.unionByName(of_group).unionByName(docs.where(F.col("doc_id").isNull()))


def _sizes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = [len(x) for x in text_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64())], names=["doc_id", "n_shingles", "component_id"])

    return run


def oracle(width: int = 3, num: int = 90, den: int = 100) -> str:
    """The same in DuckDB SQL by brute force over pairs that share a shingle; for small tables."""
    return rf"""
    WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, w[i:i + {width - 1}] AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {width - 2}, 2))) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
    p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE {den} * k >= {num} * (x.n + y.n - k)),
    r AS (SELECT DISTINCT a AS d, a AS c FROM l UNION SELECT r.d, l.b FROM r JOIN l ON l.a = r.c)
    SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(c, w.doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT d, min(c) AS c FROM r GROUP BY 1) ON d = w.doc_id"""
