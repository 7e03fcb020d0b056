"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The model file is parsed here (its path is a parameter; it is never trained or
copied). Normal pieces and their log scores go into a double-array trie over UTF-8
bytes. A text gets the whitespace marker in front and for each space; the best
segmentation is the one of greatest total log score; a character that no piece
covers costs the least score minus 10 and is written as byte pieces. A model of the
BPE kind has ranks for scores: rank r then gets the log score of Zipf's law,
``-ln((r + 1) H)``, with H the harmonic sum, which makes it a Unigram model over the
same pieces.

No piece has the marker behind another character, so a text falls apart exactly
before each run of markers: the units are segmented once each, many at a time, by
numpy steps over the trie (:func:`viterbi`), and cached.

Scale: one pass, no shuffle. What is sent to workers is as large as the model.
Decoding joins the pieces' bytes, turns markers into spaces and drops the one in
front; a text comes back exactly unless it has the marker character itself (which
becomes a space), and ``round_trip`` says whether the ids gave back the text with
its markers read as spaces.

Defined results: null and empty texts have no ids and decode to ''. Repeated rows
are encoded each. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from veracord.llm.common import read_bytes, with_fields

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIT = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Units kept in a worker's cache; units longer than LONG bytes are segmented one by one.
CACHE_UNITS, LONG = 400_000, 96


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message; fixed32 values stay bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        out = shift = 0
        while True:
            b = data[i]
            i += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while i < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
            continue
        n = {1: 8, 5: 4}.get(kind) or varint()
        yield tag >> 3, data[i : i + n]
        i += n


class Model:
    """Pieces, their kinds and log scores, and the trie."""

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        scores, self.kinds = [], []
        self.prefix, unigram = True, True
        for number, value in fields(raw):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, v in fields(value):
                    if k == 1:
                        piece = v.decode()
                    elif k == 2:
                        score = struct.unpack("<f", v)[0]
                    elif k == 3:
                        kind = v
                self.pieces.append(piece)
                scores.append(score)
                self.kinds.append(kind)
            elif number == 2:
                unigram = dict(fields(value)).get(3, 1) == 1
            elif number == 3:
                spec = dict(fields(value))
                self.prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("only models without normalisation rules and whitespace removal are supported")
        if USER_DEFINED in self.kinds:
            raise ValueError("user-defined pieces, which are matched before all others, are not supported")
        own = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.scores = np.array(scores, np.float32)
        if not unigram:
            ranked = sorted(own, key=lambda i: (-scores[i], i))
            h = sum(1 / (r + 1) for r in range(len(ranked)))
            for r, i in enumerate(ranked):
                self.scores[i] = -math.log((r + 1) * h)
        self.trie = DoubleArray({self.pieces[i].encode(): i for i in own})
        self.unknown = np.float32(self.scores[own].min() - np.float32(10))
        if any(MARK in self.pieces[i].lstrip(MARK) for i in own):
            raise ValueError("a piece has the whitespace marker behind another character")
        self.bytes_at = np.full(256, -1, np.int64)
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.bytes_at[int(self.pieces[i][3:5], 16)] = i
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k in (CONTROL, UNKNOWN) else p.encode() for p, k in zip(self.pieces, self.kinds, strict=True)]

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


class DoubleArray:
    """Trie in two arrays: from state s, byte b leads to ``base[s] + b + 1`` if its ``check`` is s."""

    def __init__(self, keys: dict[bytes, int]):
        tree: dict = {}
        for key, value in keys.items():
            node = tree
            for b in key:
                node = node.setdefault(b, {})
            node[-1] = value
        size, room = 1 << 14, 2048
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        free, top, queue = 1, 1, [(0, tree)]  # first free place, end of the places in use
        for state, node in queue:
            value[state] = node.get(-1, -1)
            labels = np.array(sorted(b for b in node if b >= 0), np.int64) + 1
            if not len(labels):
                continue
            while max(free + room, top) + 520 >= size:
                base, check, value = (np.concatenate([x, np.full(size, fill, np.int64)]) for x, fill in ((base, 0), (check, -1), (value, -1)))
                size *= 2
            gaps = free + np.flatnonzero(check[free : free + room] < 0)
            starts = gaps[gaps > labels[0]] - labels[0]
            fits = starts[(check[starts[:, None] + labels] < 0).all(axis=1)]
            start = int(fits[0]) if len(fits) else max(top, free + room)
            top = max(top, start + int(labels[-1]) + 1)
            base[state] = start
            check[start + labels] = state
            gaps = gaps[check[gaps] < 0]
            if len(gaps) < room // 20:  # nearly full: leave the last holes
                free += room // 2
            else:
                free = int(gaps[0])
            queue += [(start + b, node[b - 1]) for b in labels.tolist()]
        n = int(np.flatnonzero(check >= 0)[-1]) + 259
        pad = lambda x, fill: np.concatenate([x, np.full(260, fill, np.int64)])[:n]
        self.base, self.check, self.value = pad(base, 0), pad(check, -1), pad(value, -1)

    def step(self, state: np.ndarray, byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(next states, whether there are any)."""
        to = self.base[state] + byte + 1
        ok = (self.base[state] > 0) & (self.check[to] == state)
        return to, ok


def viterbi(model: Model, units: list[bytes]) -> list[list[int]]:
    """Best segmentation of each unit, all units at a time; on a tie the earlier start wins.

    Position by position: units whose best path reaches it walk down the trie together,
    and each piece they pass is offered to the position where it ends.
    """
    w = len(units)
    lengths = np.array([len(u) for u in units])
    width = int(lengths.max())
    text = np.zeros((w, width + 1), np.int64)
    for i, u in enumerate(units):
        text[i, : len(u)] = np.frombuffer(u, np.uint8)
    best = np.full((w, width + 1), -np.inf, np.float32)
    best[:, 0] = 0
    came = np.zeros((w, width + 1), np.int64)
    piece = np.full((w, width + 1), -1, np.int64)
    lead = text[:, :width]
    char = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
    for s in range(width):
        rows = np.flatnonzero((lengths > s) & (best[:, s] > -np.inf))
        if not len(rows):
            continue
        single = np.zeros(w, bool)
        state, at = np.zeros(len(rows), np.int64), s
        live = rows
        while len(live) and at < width:
            state, ok = model.trie.step(state, text[live, at])
            ok &= lengths[live] > at
            live, state, at = live[ok], state[ok], at + 1
            ids = model.trie.value[state]
            hit = ids >= 0
            if hit.any():
                r, i = live[hit], ids[hit]
                single[r[char[r, s] == at - s]] = True
                score = best[r, s] + model.scores[i]
                up = score > best[r, at]
                best[r[up], at], came[r[up], at], piece[r[up], at] = score[up], s, i[up]
        r = rows[~single[rows]]
        if len(r):
            to = np.minimum(s + char[r, s], lengths[r])
            score = best[r, s] + model.unknown
            up = score > best[r, to]
            r, to = r[up], to[up]
            best[r, to], came[r, to], piece[r, to] = score[up], s, -1
    out = []
    for i, u in enumerate(units):
        ids, at, path, own = [], len(u), came[i].tolist(), piece[i].tolist()
        while at > 0:
            if own[at] >= 0:
                ids.append(own[at])
            else:
                ids += [int(model.bytes_at[b]) for b in reversed(u[path[at] : at])]
            at = path[at]
        out.append(ids[::-1])
    return out


def viterbi_long(model: Model, unit: bytes) -> list[int]:
    """The same for one long unit, with memory in proportion to its length."""
    n = len(unit)
    base, check, value = model.trie.base, model.trie.check, model.trie.value
    best, came, piece = np.full(n + 1, -np.inf, np.float32), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0
    for s in range(n):
        if best[s] == -np.inf:
            continue
        lead = unit[s]
        char = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
        state, at, single = 0, s, False
        while at < n and base[state] > 0:
            to = base[state] + unit[at] + 1
            if check[to] != state:
                break
            state, at = to, at + 1
            if (i := value[state]) >= 0:
                single |= at - s == char
                if (score := best[s] + model.scores[i]) > best[at]:
                    best[at], came[at], piece[at] = score, s, int(i)
        if not single and (score := best[s] + model.unknown) > best[to := min(s + char, n)]:
            best[to], came[to], piece[to] = score, s, -1
    ids, at = [], n
    while at > 0:
        ids += [piece[at]] if piece[at] >= 0 else [int(model.bytes_at[b]) for b in reversed(unit[came[at] : at])]
        at = came[at]
    return ids[::-1]


class Encoder:
    """Texts -> ids as packed little-endian unsigned 32-bit integers, with a cache of units."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        mark = MARK if self.model.prefix else ""
        if len(self.known) > CACHE_UNITS:
            self.known.clear()
        known = self.known
        out = []
        for at in range(0, len(texts), 256):
            split = [UNIT.findall(mark + t.replace(" ", MARK)) if t else [] for t in texts[at : at + 256]]
            new = sorted((u.encode() for u in set().union(*split).difference(known)), key=len)
            for i in range(0, len(new), 8192):
                part = new[i : i + 8192]
                short = [u for u in part if len(u) <= LONG]
                for u, ids in zip(short, viterbi(self.model, short) if short else [], strict=True):
                    known[u.decode()] = np.array(ids, "<u4").tobytes()
                for u in part[len(short) :]:
                    known[u.decode()] = np.array(viterbi_long(self.model, u), "<u4").tobytes()
            out += [b"".join(map(known.__getitem__, s)) for s in split]
        return out


def encode_texts(docs: DataFrame, model_path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``keep`` columns, ids, n_bytes (byte-fallback ids), round_trip of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(read_bytes(docs.sparkSession, model_path)))
    schema = with_fields(docs.select("doc_id", *keep), "ids array<int>, n_fallback bigint, round_trip boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, texts, model in _encoded(batches, shared.value):
            flat = np.frombuffer(b"".join(ids), "<u4").astype(np.int32)
            offsets = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype(np.int32)
            arrays = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
            checks = [_check(model, x, t) for x, t in zip(ids, texts, strict=True)]
            cols = [batch.column(c) for c in ("doc_id", *keep)]
            yield pa.RecordBatch.from_arrays([*cols, arrays, pa.array([n for n, _ in checks], pa.int64()), pa.array([ok for _, ok in checks], pa.bool_())], names=["doc_id", *keep, "ids", "n_fallback", "round_trip"])

    return docs.select("doc_id", *keep, *(["text"] if "text" not in keep else [])).mapInArrow(run, schema)


def _encoded(batches: Iterator[pa.RecordBatch], model: Model):
    encoder = model.__dict__.setdefault("encoder", Encoder(model))  # a worker's next task finds the units of its last
    for batch in batches:
        texts = batch.column("text").to_pylist()
        yield batch, encoder(texts), texts, model


def _check(model: Model, packed: bytes, text: str | None) -> tuple[int, bool]:
    """(byte-fallback ids, whether decoding gives the text back)."""
    ids = np.frombuffer(packed, "<u4")
    first, last = int(model.bytes_at.min()), int(model.bytes_at.max())
    return int(((ids >= first) & (ids <= last)).sum()), model.decode(ids.tolist()) == (text or "").replace(MARK, " ")


def op9(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_pieces, n_fallback, ids_crc32, round_trip: digests of the ids of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(Model(read_bytes(docs.sparkSession, model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, ids, texts, model in _encoded(batches, shared.value):
            checks = [_check(model, x, t) for x, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array([n for n, _ in checks], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array([ok for _, ok in checks], pa.bool_())],
                names=["doc_id", "n_pieces", "n_fallback", "ids_crc32", "round_trip"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, n_fallback long, ids_crc32 long, round_trip boolean")
