"""Expressions: columns, literals, comparisons, logic, prompts and quantifying aggregates.

An expression prints as it is written; that text is the default name of its column.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from enum import Enum

FIELD = re.compile(r"\{(\w+)\}")
FLIP = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "==": "==", "!=": "!="}
NEGATE = {"<": ">=", ">": "<=", "<=": ">", ">=": "<", "==": "!=", "!=": "=="}


def lift(x: object) -> Expr:
    return x if isinstance(x, Expr) else Lit(x)


class Expr:
    """Base. ``==`` compares expressions as objects; use ``.eq`` and ``.ne`` to build comparisons."""

    def children(self) -> tuple[Expr, ...]:
        return ()

    def walk(self) -> Iterator[Expr]:
        yield self
        for c in self.children():
            yield from c.walk()

    def alias(self, name: str) -> Alias:
        return Alias(self, name)

    def eq(self, other: object) -> Binary:
        return Binary("==", self, lift(other))

    def ne(self, other: object) -> Binary:
        return Binary("!=", self, lift(other))

    def __lt__(self, other: object) -> Binary:
        return Binary("<", self, lift(other))

    def __le__(self, other: object) -> Binary:
        return Binary("<=", self, lift(other))

    def __gt__(self, other: object) -> Binary:
        return Binary(">", self, lift(other))

    def __ge__(self, other: object) -> Binary:
        return Binary(">=", self, lift(other))

    def __and__(self, other: object) -> Binary:
        return Binary("&", self, lift(other))

    def __or__(self, other: object) -> Binary:
        return Binary("|", self, lift(other))

    def __rand__(self, other: object) -> Binary:
        return Binary("&", lift(other), self)

    def __ror__(self, other: object) -> Binary:
        return Binary("|", lift(other), self)

    def __invert__(self) -> Not:
        return Not(self)

    def __bool__(self) -> bool:
        raise TypeError("an expression has no truth value; combine with &, | and ~")


@dataclass(frozen=True, eq=True)
class Col(Expr):
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, eq=True)
class Lit(Expr):
    value: object

    def __str__(self) -> str:
        return repr(self.value)

    @property
    def plain(self) -> object:
        return self.value.value if isinstance(self.value, Enum) else self.value


@dataclass(frozen=True, eq=True)
class Alias(Expr):
    expr: Expr
    name: str

    def children(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, eq=True)
class Binary(Expr):
    op: str
    left: Expr
    right: Expr

    def children(self) -> tuple[Expr, ...]:
        return (self.left, self.right)

    def __str__(self) -> str:
        return f"{self.left} {self.op} {self.right}"


@dataclass(frozen=True, eq=True)
class Not(Expr):
    expr: Expr

    def children(self) -> tuple[Expr, ...]:
        return (self.expr,)

    def __str__(self) -> str:
        return f"~{self.expr}"


@dataclass(frozen=True, eq=True)
class MaxDot(Expr):
    """Greatest dot product of the vectors in a list column with one query vector; -1 for an empty list."""

    vectors: Expr
    query: tuple[float, ...] = field(repr=False)

    def children(self) -> tuple[Expr, ...]:
        return (self.vectors,)

    def __str__(self) -> str:
        return f"max_dot({self.vectors})"


@dataclass(frozen=True, eq=True)
class Native(Expr):
    """Any pyspark Column as an expression (without provenance)."""

    column: object = field(compare=False)
    name: str

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True, eq=True)
class Prompt(Expr):
    """A question to the language model about the ``{fields}`` it names."""

    text: str
    dtype: object = bool

    @property
    def fields(self) -> list[str]:
        return list(dict.fromkeys(FIELD.findall(self.text)))

    def children(self) -> tuple[Expr, ...]:
        return tuple(Col(f) for f in self.fields)

    def __str__(self) -> str:
        return f"prompt({self.text!r})"


@dataclass(frozen=True, eq=True)
class Agg(Expr):
    """Quantifying aggregate over a boolean expression: count_if, proportion, bool_and, bool_or."""

    kind: str
    arg: Expr

    def children(self) -> tuple[Expr, ...]:
        return (self.arg,)

    def __str__(self) -> str:
        return f"{self.kind}({self.arg})"

    @property
    def dtype(self) -> type:
        return {"count_if": int, "proportion": float}.get(self.kind, bool)


def unalias(e: Expr) -> Expr:
    return unalias(e.expr) if isinstance(e, Alias) else e


def has_prompt(e: Expr) -> bool:
    return any(isinstance(x, Prompt) for x in e.walk())


def columns_of(e: Expr) -> set[str]:
    return {x.name for x in e.walk() if isinstance(x, Col)}


def dtype_of(e: Expr, schema) -> object:
    e = unalias(e)
    if isinstance(e, Col):
        return schema.field(e.name).dtype
    if isinstance(e, Lit):
        return type(e.value)
    if isinstance(e, (Prompt, Agg)):
        return e.dtype
    return float if isinstance(e, MaxDot) else bool


def comparisons(e: Expr) -> Iterator[tuple[str, str, object]]:
    """(column, operator, literal) of each ``col op literal`` within AND and OR, flipped if need be."""
    if isinstance(e, Alias):
        yield from comparisons(e.expr)
    elif isinstance(e, Binary) and e.op in "&|":
        yield from comparisons(e.left)
        yield from comparisons(e.right)
    elif isinstance(e, Binary) and isinstance(e.left, Col) and isinstance(e.right, Lit):
        yield e.left.name, e.op, e.right.plain
    elif isinstance(e, Binary) and isinstance(e.left, Lit) and isinstance(e.right, Col):
        yield e.right.name, FLIP[e.op], e.left.plain


def col(name: str) -> Col:
    return Col(name)


def lit(value: object) -> Lit:
    return Lit(value)


def prompt(text: str, dtype: object = bool) -> Prompt:
    return Prompt(text, dtype)


def native(column: object, name: str) -> Native:
    return Native(column, name)


def count_if(arg: object) -> Agg:
    return Agg("count_if", lift(arg))


def proportion(arg: object) -> Agg:
    return Agg("proportion", lift(arg))


def bool_and(arg: object) -> Agg:
    return Agg("bool_and", lift(arg))


def bool_or(arg: object) -> Agg:
    return Agg("bool_or", lift(arg))
