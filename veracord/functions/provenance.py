"""Provenance polynomials: positive Boolean expressions over tokens, in disjunctive form.

A token says that a predicate holds (or fails) on one row. Queries carry polynomials
factorised, as JSON text in companion columns; :func:`parse` expands them on the
driver, for the rows that are looked at. Disjunctive form applies absorption: a
monomial that contains another is dropped.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Monomials that an expansion may have.
MAX_MONOMIALS = 20_000


@dataclass(frozen=True)
class Token:
    row_id: tuple
    predicate: str
    sign: bool

    def __repr__(self) -> str:
        return f"{'' if self.sign else '!'}{self.predicate}@{','.join(map(str, self.row_id))}"


class Prov:
    """An element of the semiring: a set of monomials, each a set of tokens."""

    __slots__ = ("monomials",)

    def __init__(self, monomials=()):
        self.monomials = absorb(frozenset(m) for m in monomials)

    @staticmethod
    def token(row_id: tuple, predicate: object, sign: bool = True) -> Prov:
        return Prov([{Token(tuple(row_id), str(predicate), sign)}])

    def __add__(self, other: Prov) -> Prov:
        return Prov([*self.monomials, *other.monomials])

    def __mul__(self, other: Prov) -> Prov:
        if len(self.monomials) * len(other.monomials) > MAX_MONOMIALS:
            raise ValueError("the explanation has too many alternatives; use minimal provenance")
        return Prov(a | b for a in self.monomials for b in other.monomials)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Prov) and self.monomials == other.monomials

    def __hash__(self) -> int:
        return hash(self.monomials)

    def __repr__(self) -> str:
        return " + ".join(sorted(" * ".join(sorted(map(repr, m))) or "1" for m in self.monomials)) or "0"

    @property
    def tokens(self) -> set[Token]:
        return set().union(*self.monomials)


def absorb(monomials) -> frozenset:
    """Drop every monomial that contains another one."""
    kept: list[frozenset] = []
    holders: dict[Token, list[frozenset]] = {}
    for m in sorted(set(monomials), key=len):
        if not m:
            return frozenset([m])
        if not any(k <= m for t in m for k in holders.get(t, ())):
            kept.append(m)
            holders.setdefault(next(iter(m)), []).append(m)
    return frozenset(kept)


ZERO, ONE = Prov(), Prov([()])


def total(parts: list[Prov]) -> Prov:
    return Prov(m for p in parts for m in p.monomials)


def product(parts: list[Prov]) -> Prov:
    if all(len(p.monomials) == 1 for p in parts):
        return Prov([frozenset().union(*(next(iter(p.monomials)) for p in parts))])
    out = ONE
    for p in parts:
        out = out * p
    return out


def threshold(op: str, holds: bool, bound: float, pos: list[Prov], neg: list[Prov], minimal: bool) -> Prov:
    """Why a count of true arguments compares as it does with ``bound``."""
    op = op if holds else {"<": ">=", ">": "<=", "<=": ">", ">=": "<", "==": "!=", "!=": "=="}[op]
    if op not in (">", ">="):
        return product([*pos, *neg])
    need = max(0, math.ceil(bound - 1e-9) if op == ">=" else math.floor(bound + 1e-9) + 1)
    if minimal:
        return product(pos[:need]) if need <= len(pos) else ZERO
    if math.comb(len(pos), need) > MAX_MONOMIALS:
        raise ValueError("the explanation has too many alternatives; use minimal provenance")
    return total([product(list(c)) for c in combinations(pos, need)])


class Explanations(dict):
    """Column -> polynomial, expanded from its factorised text when it is looked at."""

    def __init__(self, texts: dict[str, str], minimal: bool):
        super().__init__(texts)
        self.minimal = minimal

    def __getitem__(self, column: str) -> Prov:
        return parse(super().__getitem__(column), self.minimal)


def parse(text: str, minimal: bool = False) -> Prov:
    """Polynomial of the factorised JSON form."""
    return _expand(json.loads(text), minimal)


def _expand(x: dict, minimal: bool) -> Prov:
    ((kind, v),) = x.items()
    if kind == "t":
        return Prov.token(tuple(v[0]), v[1], v[2])
    if kind == "+":
        return total([_expand(p, minimal) for p in (v[:1] if minimal else v)])
    if kind == "*":
        return product([_expand(p, minimal) for p in v])
    if kind == "1":
        return ONE
    pos, neg = ([_expand(p, minimal) for p in v[k]] for k in ("pos", "neg"))
    scale = (len(pos) + len(neg)) if v["share"] else 1
    if v["share"] and not scale:
        return ONE
    return threshold(v["op"], v["holds"], v["bound"] * scale, pos, neg, minimal)


def ids_json(key: list[Column]) -> Column:
    """Key values as a JSON array."""
    quoted = [F.when(k.isNull(), F.lit("null")).otherwise(F.regexp_extract(F.to_json(F.struct(k.alias("k"))), r'^\{"k":(.*)\}$', 1)) for k in key]
    return F.concat(F.lit("["), F.concat_ws(",", *quoted), F.lit("]"))


def token(key: list[Column], predicate: str, sign: Column) -> Column:
    said = json.dumps(predicate)
    return F.concat(F.lit('{"t":['), ids_json(key), F.lit(f",{said},"), sign.cast("string"), F.lit("]}"))


def joined(op: str, parts: Column) -> Column:
    """Sum (+) or product (*) of an array of factorised forms."""
    return F.concat(F.lit(f'{{"{op}":['), F.array_join(parts, ","), F.lit("]}"))


def compared(op: str, holds: Column, bound: Column, share: bool, pos: Column, neg: Column) -> Column:
    return F.concat(
        F.lit(f'{{"k":{{"op":"{op}","share":{str(share).lower()},"holds":'), holds.cast("string"), F.lit(',"bound":'), bound.cast("double").cast("string"),
        F.lit(',"pos":['), F.array_join(pos, ","), F.lit('],"neg":['), F.array_join(neg, ","), F.lit("]}}"),
    )


def at_least(op: str, holds: Column) -> Column:
    """Whether the comparison says that a count is large enough, which its first true arguments show."""
    return holds if op in (">", ">=") else ~holds if op in ("<", "<=") else F.lit(False)


def witnessed(op: str, holds: Column, bound: Column, share: bool, pos: Column, neg: Column) -> Column:
    """What :func:`compared` says to a minimal explanation, with no more than that reads: where the
    first true arguments suffice, these alone."""
    scale = F.size(pos) + F.size(neg) if share else F.lit(1)
    least = bound.cast("double") * scale
    need = F.floor(least + 1e-9) + 1 if op in (">", "<=") else F.ceil(least - 1e-9)
    need = F.greatest(need.cast("int"), F.lit(0))
    first = F.when(need <= F.size(pos), joined("*", F.slice(pos, F.lit(1), need))).otherwise(F.lit('{"+":[]}'))
    if share:
        first = F.when(scale == 0, F.lit('{"1":0}')).otherwise(first)
    return F.when(at_least(op, holds), first).otherwise(compared(op, holds, bound, share, pos, neg))
