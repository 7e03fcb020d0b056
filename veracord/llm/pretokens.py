"""Pre-tokens of byte-level vocabularies, found by arrays; their ids from a table.

The published pattern takes contractions first, then runs of letters, of numbers and of
other signs, each with one space before it, and white space. All of it can be said by the
runs of equal character classes and their neighbours, so a group of texts is split by a
few array operations.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np

from veracord.llm.bpe import byte_alphabet, is_plain
from veracord.llm.vector import Table, mix, stretch_hashes

OTHER, LETTER, NUMBER, SPACE, END = range(5)
#: Stands between texts: a lone surrogate, which no text from Arrow holds.
BREAK = "\ud800"
#: Unicode's White_Space, a fixed value.
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def classes() -> np.ndarray:
    """The class of each code point."""
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE] = SPACE
    out[ord(BREAK)] = END
    return out


class PreTokens:
    """The pre-tokens of a list of texts: hashes ``h``, places ``starts`` to ``ends`` in
    ``joined``, and ``first``, the number of the first one of each text (and one more)."""

    CLASS: np.ndarray | None = None
    VALUE: np.ndarray | None = None

    def __init__(self, texts: list[str]):
        if PreTokens.CLASS is None:
            PreTokens.CLASS, PreTokens.VALUE = classes(), mix(np.arange(1, 0x110001, dtype=np.uint64))
        self.joined = BREAK.join([*texts, ""])
        point = np.frombuffer(self.joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        kind = PreTokens.CLASS[point]
        if not len(point):
            self.starts = self.ends = np.zeros(0, np.int64)
        else:
            self.starts, self.ends = self._split(point, kind)
        self.h = stretch_hashes(PreTokens.VALUE[point], self.starts, self.ends)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))

    @staticmethod
    def _split(point: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        turn = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        s, e = np.concatenate([[0], turn]), np.concatenate([turn, [len(point)]])
        k = kind[s]
        keep = k != END
        gap = np.flatnonzero(k[:-1] == SPACE)  # the last run is END
        gap = gap[k[gap + 1] != END]
        blank = point[e[gap] - 1] == 32
        led = np.zeros(len(s), bool)  # runs that have taken the space before them
        led[gap[blank] + 1] = True
        quote = np.flatnonzero((k[:-1] == OTHER) & (k[1:] == LETTER) & (e[:-1] - s[:-1] == 1) & (point[s[:-1]] == 39) & ~led[:-1])
        if len(quote):
            a = point[s[quote + 1]]
            b = np.where(e[quote + 1] - s[quote + 1] > 1, point[np.minimum(s[quote + 1] + 1, len(point) - 1)], 0)
            two = np.isin(a * 256 + np.minimum(b, 255), [ord(x) * 256 + ord(y) for x, y in ("re", "ve", "ll")])
            take = np.where(np.isin(a, [ord(x) for x in "stmd"]), 1, np.where(two, 2, 0))
            e[quote] += take
            s[quote + 1] += take
        e[gap[blank]] -= 1
        s[gap[blank] + 1] -= 1
        keep &= e > s
        torn = gap[~blank]
        torn = torn[e[torn] - s[torn] > 1]
        if not len(torn):
            return s[keep], e[keep]
        e[torn] -= 1
        s, e = np.concatenate([s[keep], e[torn]]), np.concatenate([e[keep], e[torn] + 1])
        order = np.argsort(s, kind="stable")
        return s[order], e[order]


class Ids:
    """Texts -> ids. The library's model encodes each pre-token that the table does not have."""

    def __init__(self, raw: bytes, bits: int = 21, pool: int = 1 << 24):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(raw.decode())
        self.model = self.library.model
        self.kind = np.dtype("<u2" if self.library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.added = [t["content"] for t in json.loads(raw).get("added_tokens", [])]
        self.plain = is_plain(raw)
        self.alphabet = [c for _, c in sorted(byte_alphabet().items())]
        self.table, self.most = Table(bits), pool
        self.reset()

    def reset(self) -> None:
        self.table.clear()
        self.pool, self.filled = np.zeros(1 << 20, self.kind), 0
        self.offset, self.length, self.known = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, None, False, False).ids, self.kind)

    def part(self, text: str) -> list[int]:
        """Ids of one pre-token."""
        if text.isascii() and text.isprintable():
            mapped = text.replace(" ", self.alphabet[32])
        else:
            mapped = "".join([self.alphabet[b] for b in text.encode()])
        return [t.id for t in self.model.tokenize(mapped)]

    def learn(self, h: np.ndarray, texts: list[str]) -> np.ndarray:
        """Numbers of new pre-tokens."""
        ids, sizes = [], []
        for t in texts:
            got = self.part(t)
            ids += got
            sizes.append(len(got))
        while self.filled + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.known + len(texts) > len(self.offset):
            self.offset, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.offset, self.length))
        self.pool[self.filled : self.filled + len(ids)] = ids
        number = np.arange(self.known, self.known + len(texts))
        self.length[number] = sizes
        self.offset[number] = self.filled + np.cumsum(sizes) - sizes
        self.filled, self.known = self.filled + len(ids), self.known + len(texts)
        self.table.put(h, number)
        return number

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, bounds of each text's)."""
        odd = [i for i, t in enumerate(texts) if not self.plain or any(a in t for a in self.added)]
        if odd:
            got = self(["" if i in set(odd) else t for i, t in enumerate(texts)]) if self.plain else (np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64))
            each = [got[0][a:b] for a, b in zip(got[1][:-1], got[1][1:], strict=True)]
            for i in odd:
                each[i] = self.whole(texts[i])
            return np.concatenate([np.zeros(0, self.kind), *each]), np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
        if self.filled > self.most or self.table.used > (3 << self.table.bits) // 4:
            self.reset()
        pre = PreTokens(texts)
        number, missing = self.table.find(pre.h)
        if len(missing):
            new, at, back = np.unique(pre.h[missing], return_index=True, return_inverse=True)
            places = missing[at]
            spans = zip(pre.starts[places].tolist(), pre.ends[places].tolist(), strict=True)
            number[missing] = self.learn(new, [pre.joined[s:e] for s, e in spans])[back]
        length = self.length[number]
        ends = np.cumsum(length)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(self.offset[number] - (ends - length), length) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[pre.first]


def text_groups(texts: list[str | None], size: int = 1 << 17):
    """Lists of texts of about ``size`` characters together; a longer one is alone."""
    part, total = [], 0
    for t in texts:
        if part and total + len(t or "") > size:
            yield part
            part, total = [], 0
        part.append(t or "")
        total += len(t or "")
    if part:
        yield part
