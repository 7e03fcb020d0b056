"""Batches of texts as arrays: words and their hashes, a hash table, forests, packed shuffles.

What the operators on words have in common. A group of texts is joined to one byte
array; its words are found, and hashed, by a few array operations, with no Python step
for a word. The hash of a stretch is a difference of prefix sums of
``value[byte] * P**place`` times ``P**-start``, modulo 2**64.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

U = np.uint64
_P = 0x9E3779B97F4A7C15
#: Bytes of texts that are handled at once, about; a longer text is a group of its own.
GROUP = 1 << 18
#: Rows of a batch that are Python objects at a time.
SOME = 128
#: Bytes of a batch beyond which it goes in pieces, and freed memory is given back.
LARGE = 1 << 22


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash."""
    h = (h ^ (h >> U(33))) * U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> U(33))) * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class _Powers:
    """Powers of P and of its inverse, as many as the longest group has needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, GROUP + GROUP // 4)
            self.up, self.down = (np.cumprod(np.concatenate([[U(1)], np.full(size, U(p))]), dtype=np.uint64) for p in (_P, pow(_P, -1, 1 << 64)))
        return self.up, self.down


_POWERS = _Powers()


def stretch_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each stretch of ``values`` (uint64) from starts to ends."""
    n = len(values)
    up, down = _POWERS.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def byte_values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte; A-Z as a-z if ``lower``."""
    v = mix(np.arange(1, 257, dtype=np.uint64) * U(_P))
    if lower:
        v[65:91] = v[97:123]
    return v


LOWERED = byte_values(True)
#: Space and the ASCII controls \t \n \v \f \r.
GAPS = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])


class Words:
    """The words of a group of texts: hashes ``h``, byte places ``starts`` and ``ends`` in
    ``data``, and ``first``, the number of the first word of each text (and one more)."""

    def __init__(self, texts: list[bytes], values: np.ndarray = LOWERED, edges: np.ndarray | None = None):
        """``edges``: marks bytes that are stripped from the ends of words which have others."""
        self.data = data = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        gap = GAPS[data]
        turn = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(gap) and not gap[0]:
            turn = np.concatenate([[0], turn])
        starts, ends = turn[::2], turn[1::2]
        self.first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
        if edges is not None:
            starts, ends = _stripped(data, starts, ends, edges)
        self.starts, self.ends = starts, ends
        self.h = stretch_hashes(values[data], starts, ends)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        r"""(first word, words) of each \n-split line that has a word; a line lies in one text."""
        n = len(self.starts)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        line = np.cumsum(self.data == 10)[self.starts]
        begin = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        return begin, np.diff(np.concatenate([begin, [n]]))


def _stripped(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, full = starts.copy(), ends.copy(), ends
    at = np.arange(len(starts))
    while len(at := at[(starts[at] < ends[at]) & edges[data[np.minimum(starts[at], len(data) - 1)]]]):
        starts[at] += 1
    at = np.arange(len(starts))
    while len(at := at[(starts[at] < ends[at]) & edges[data[ends[at] - 1]]]):
        ends[at] -= 1
    bare = np.flatnonzero(starts >= ends)  # nothing but edges: the word itself
    ends[bare] = full[bare]
    for i in bare.tolist():
        s = int(full[i])
        while s and not GAPS[data[s - 1]]:
            s -= 1
        starts[i] = s
    return starts, ends


def grouped(column: pa.Array, size: int = GROUP, change: Callable[[bytes], bytes] | None = None) -> Iterator[tuple[int, list[bytes]]]:
    """(number of the first text, texts as bytes) of groups of about ``size`` bytes; null is empty."""
    part, at, total = [], 0, 0
    for i in range(0, len(column), SOME):
        for text in column.slice(i, SOME).cast(pa.binary()).to_pylist():
            text = text or b""
            part.append(change(text) if change else text)
            total += len(text) + 1
            if total >= size:
                yield at, part
                part, at, total = [], at + len(part), 0
    if part:
        yield at, part


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each ``n`` adjacent word hashes, whatever texts they lie in."""
    m = len(h) - n + 1
    if m <= 0:
        return h[:0]
    out, done, part, size = np.full(m, n, np.uint64), 0, h, 1
    while size <= n:
        if n & size:
            out = out + part[done : done + m] * U(pow(_P, done + 1, 1 << 64))
            done += size
        if 2 * size <= n:
            part = part[:-size] + part[size:] * U(pow(_P, size, 1 << 64))
        size *= 2
    return mix(out)


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text of a group; of the whole
    sequence where it is shorter than ``width``, none without words."""
    own = windows(words.h, width)
    first = words.first.tolist()
    for a, b in zip(first, first[1:], strict=False):
        if b - a >= width:
            x = np.sort(own[a : b - width + 1])
            yield x[np.concatenate([[True], x[1:] != x[:-1]])]
        else:
            yield windows(words.h[a:b], b - a) if b > a else own[:0]


class Table:
    """64-bit hash -> number, open addressing with linear probes; arrays in, arrays out."""

    PROBES = 8

    def __init__(self, bits: int):
        self.bits, self.shift = bits, U(64 - bits)
        self.clear()

    def clear(self) -> None:
        size = (1 << self.bits) + self.PROBES
        self.keys, self.values, self.used = np.zeros(size, np.uint64), np.zeros(size, np.int64), 0

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(values, places that are missing)."""
        at = (h >> self.shift).astype(np.int64)
        out = self.values[at]
        rest = np.flatnonzero(self.keys[at] != h)
        for i in range(1, self.PROBES):
            if not len(rest):
                break
            to = at[rest] + i
            hit = self.keys[to] == h[rest]
            out[rest[hit]] = self.values[to[hit]]
            rest = rest[~hit]
        return out, rest

    def put(self, h: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there; where all probes are taken, the first is replaced."""
        at, rest = (h >> self.shift).astype(np.int64), np.arange(len(h))
        for i in range(self.PROBES):
            if not len(rest):
                return
            to = at[rest] + i
            free = np.flatnonzero(self.keys[to] == 0)
            _, one = np.unique(to[free], return_index=True)
            put = free[one]
            self.keys[to[put]], self.values[to[put]] = h[rest[put]], values[rest[put]]
            self.used += len(put)
            rest = np.delete(rest, put)
        self.keys[at[rest]], self.values[at[rest]] = h[rest], values[rest]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) of the edges' nodes, without the smallest ones."""
    if not len(a):
        return a, b
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(i):
        x, y = label[i], label[j]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(label, up := label[label]):
            label = up
        live = label[i] != label[j]
        i, j = i[live], j[live]
    root = nodes[label]
    keep = root != nodes
    return nodes[keep], root[keep]


#: glibc's way to give freed memory back; other libraries have none or need none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Give what this process has freed back to the system: its allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, so that a worker keeps nothing of it: not between its large batches,
    which go in pieces, and not after its end, when the process waits for other tasks."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in run(batches):
            if rows.nbytes <= LARGE:
                yield rows
                continue
            step = max(1, rows.num_rows * LARGE // rows.nbytes)
            for i in range(0, rows.num_rows, step):
                yield rows.slice(i, step)
            del rows
            give_back()
        give_back()

    return tidy


#: Rows of a packed shuffle: arrays of one kind for one bucket of keys.
PACKED = "part int, bucket int, kind int, data binary"
#: Buckets of a partition, each of which a task holds in memory at a time.
SUB = 4


def packed(rows: list[tuple[int, int, bytes]], parts: int) -> pa.RecordBatch:
    """A batch of PACKED rows from (bucket, kind, data)."""
    bucket, kind, data = zip(*rows, strict=True) if rows else ((), (), ())
    cols = (pa.array([b % parts for b in bucket], pa.int32()), pa.array(bucket, pa.int32()), pa.array(kind, pa.int32()), pa.array(data, pa.binary()))
    return pa.RecordBatch.from_arrays(list(cols), names=["part", "bucket", "kind", "data"])


def dealt(kind: int, parts: int, key: np.ndarray, *cols: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, data) rows of arrays sorted by ``key`` (uint64), cut at the buckets' bounds."""
    n = parts * SUB
    bounds = np.searchsorted(key, np.array([(i << 64) // n for i in range(1, n)], np.uint64)).tolist()
    whole = [key.view(np.int64), *(c.view(np.int64) if c.dtype == np.uint64 else c.astype(np.int64) for c in cols)]
    return [(i, kind, b"".join(c[s:e].tobytes() for c in whole)) for i, (s, e) in enumerate(zip([0, *bounds], [*bounds, len(key)], strict=True)) if e > s]


def unpacked(data: list[bytes], n: int) -> list[np.ndarray]:
    """``n`` int64 arrays from what ``dealt`` has packed, one behind the other."""
    each = [np.frombuffer(x, np.int64).reshape(n, -1) for x in data]
    return list(np.concatenate(each, axis=1)) if each else [np.zeros(0, np.int64)] * n


def shuffle_packed(rows: DataFrame, make: Callable, ddl: str, parts: int) -> DataFrame:
    """Deals PACKED rows to their partitions. Each task makes an object whose
    ``fold(kind, data)`` gets all rows of a kind and bucket at once and whose ``end()``
    closes the task; both yield batches of ``ddl``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, held = make(), None, []
        for batch in batches:
            for i in range(0, batch.num_rows, SOME):
                for bucket, kind, data in zip(*(batch.column(c).slice(i, SOME).to_pylist() for c in (1, 2, 3)), strict=True):
                    if (bucket, kind) != now:
                        if held:
                            yield from state.fold(now[1], held)
                        now, held = (bucket, kind), []
                    held.append(data)
        if held:
            yield from state.fold(now[1], held)
        yield from state.end()

    return rows.repartitionById(parts, F.col("part")).sortWithinPartitions("bucket", "kind").mapInArrow(lean(run), ddl)
