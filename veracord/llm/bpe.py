"""Byte-level BPE: whole-token shortcut, exact merges for the rest, fast encoding.

Used by the token counter and by the token store. The tokenizer file is only
read (its path is a parameter), never trained or copied.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from veracord.llm.common import read_bytes

#: Entries of the younger generation of a worker's cache of pre-tokens.
CACHE_ENTRIES = 400_000


def byte_alphabet() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    table = {b: chr(b) for b in shown}
    for b in range(256):
        if b not in table:
            table[b] = chr(256 + len(table) - len(shown))
    return table


def numerals() -> str:
    """All characters of the categories No and Nl, escaped for a character class."""
    return "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) in ("No", "Nl"))


def split_pattern(odd: str = "") -> re.Pattern[str]:
    """The published pre-token pattern in Python's own engine.

    Python's ``\\w`` also holds the numerals that are not decimal digits: in a text that
    has any, they (``odd``) are taken out of the letters and put to the numbers, so the
    classes are Unicode's L and N. Without them the pattern runs many times faster.
    """
    letter, number = rf"[^\W\d_{odd}]", rf"[\d{odd}]"
    return re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?{letter}+| ?{number}+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


class Merges:
    """Exact BPE of one pre-token by a heap over a linked list: O(n log n) for n bytes."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]]):
        self.vocab = vocab
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.alphabet = byte_alphabet()

    def symbols(self, text: str) -> list[str]:
        return [self.alphabet[b] for b in text.encode("utf-8", "surrogatepass")]

    def parts(self, symbols: list[str]) -> list[str]:
        rank = self.rank
        if len(symbols) <= 24:
            sym = symbols
            while len(sym) > 1:
                best = min(zip(sym, sym[1:], strict=False), key=lambda p: rank.get(p, 1 << 60))
                if best not in rank:
                    break
                out, i, joined, last = [], 0, best[0] + best[1], len(sym) - 1
                while i <= last:
                    if i < last and sym[i] == best[0] and sym[i + 1] == best[1]:
                        out.append(joined)
                        i += 2
                    else:
                        out.append(sym[i])
                        i += 1
                sym = out
            return sym
        sym = list(symbols)
        after, before = list(range(1, len(sym) + 1)), list(range(-1, len(sym) - 1))
        heap = [(rank[p], i, *p) for i, p in enumerate(zip(sym, sym[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if sym[i] == a else len(sym)
            if j >= len(sym) or sym[j] != b:
                continue  # one of the two has been merged since
            sym[i], sym[j], after[i] = a + b, "", after[j]
            if after[j] < len(sym):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(sym) and (p := (sym[k], sym[after[k]])) in rank:
                    heapq.heappush(heap, (rank[p], k, *p))
        return [s for s in sym if s]

    def count(self, text: str) -> int:
        return len(self.parts(self.symbols(text)))


def proved_whole_tokens(merges: Merges) -> list[str]:
    """Vocabulary strings that encode alone as exactly one token, as plain text.

    Proved by running the merges over each string; strings that are no valid UTF-8, or
    that the merges leave in several parts, are not in the list.
    """
    back = {c: b for b, c in merges.alphabet.items()}
    out = []
    for token in merges.vocab:
        if all(c in back for c in token) and merges.parts(list(token)) == [token]:
            try:
                out.append(bytes(back[c] for c in token).decode())
            except UnicodeDecodeError:
                continue
    return out


def load_model(raw: bytes) -> tuple[Merges, list[str]]:
    """(merges, strings of added tokens) of a tokenizer file."""
    spec = json.loads(raw)
    pairs = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"])
    return Merges(spec["model"]["vocab"], pairs), [t["content"] for t in spec.get("added_tokens", [])]


def is_plain(raw: bytes) -> bool:
    """Whether a tokenizer file splits by the published pattern and changes nothing before or after."""
    spec = json.loads(raw)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    settings = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec.get("normalizer")
    return bool(settings and model.get("type", "BPE") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))


class Cache(dict):
    """Pre-token -> value, filled by ``make``. When full, the entries become the older
    generation, of which those that are met again come back; the rest goes."""

    def __init__(self, base: dict, make, entries: int = CACHE_ENTRIES):
        super().__init__(base)
        self.base, self.make, self.entries, self.older = base, make, entries, {}

    def __missing__(self, key: str):
        if len(self) >= self.entries + len(self.base):
            self.older = dict(self)
            self.clear()
            self.update(self.base)
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value


class Splitter:
    """Pre-tokens of a text, or None where only the library splits it rightly.

    That is: a text with one of the added tokens in it, with one of the four separator
    controls that Python alone takes for white space, or with a lone surrogate.
    """

    def __init__(self, added: list[str]):
        odd = numerals()
        self.plain, self.full = split_pattern().findall, split_pattern(odd).findall
        # classes within the BMP are looked up in a table; one that goes beyond would be tried range by range
        bmp = "".join(chr(c) for c in range(0x10000) if unicodedata.category(chr(c)) in ("No", "Nl"))
        self.rare, self.astral = re.compile(f"[\x1c-\x1f{bmp}]").search, re.compile("[\ud800-\udfff\U00010000-\U0010ffff]").search
        self.foreign, self.added = re.compile("[\x1c-\x1f\ud800-\udfff]").search, added

    def __call__(self, text: str) -> list[str] | None:
        if any(a in text for a in self.added):
            return None
        if not self.rare(text) and (text.isascii() or not self.astral(text)):
            return self.plain(text)
        if self.foreign(text):
            return None
        return self.full(text)


#: What a worker process keeps for its next task, by use and tokenizer.
_KEPT: dict = {}


def kept(key: tuple, make):
    """``make()``, once per worker process and key."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def counter(raw: bytes, whole: list[str]) -> tuple[Splitter, Cache]:
    merges, added = load_model(raw)
    return Splitter(added), Cache(dict.fromkeys(whole, 1), merges.count)


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """Tokens of every whole text: doc_id, n_bytes, n_tokens, over_limit.

    A null text counts as empty; an empty text has 0 tokens. Rows with a null or
    repeated doc_id are counted like any other. Nothing is shuffled: one pass over
    (doc_id, text), Arrow batches in, three numbers out. The model that is sent to the
    workers is as large as the tokenizer file, which the data do not change. Where that file
    asks for another way of splitting or normalising, the library counts the whole texts.
    """
    spark = docs.sparkSession
    raw = read_bytes(spark, tokenizer_path)
    merges, _ = load_model(raw)
    ours = is_plain(raw)
    model = spark.sparkContext.broadcast((raw, proved_whole_tokens(merges)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        raw, whole = model.value
        split, known = kept(("count", hash(raw)), lambda: counter(raw, whole))
        library = None
        for batch in batches:
            texts = batch.column("text").to_pylist()
            counts = []
            for t in texts:
                parts = (split(t) if ours else None) if t else []
                if parts is None:
                    library = library or Tokenizer.from_str(raw.decode())
                    counts.append(len(library.encode(t, add_special_tokens=False).ids))
                else:
                    counts.append(sum(map(known.__getitem__, parts)))
            sizes = [len(t.encode()) if t else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64()), pa.array([c > limit for c in counts], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer file on the driver."""
    import public_tokenizers

    return public_tokenizers.path(name)
