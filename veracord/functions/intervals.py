"""Interval-valued results of estimated aggregates.

A comparison with an interval is True only when it is certain; ``==`` holds when the
interval lies in the band ``c +- |c| * relative_error`` and ``!=`` when it is disjoint from
it, so both can be False: undecided.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    lower: float
    upper: float
    confidence_level: float = 1.0
    relative_error: float = 0.0

    def __add__(self, x: float) -> Interval:
        return self._with(self.lower + x, self.upper + x)

    def __sub__(self, x: float) -> Interval:
        return self._with(self.lower - x, self.upper - x)

    def __mul__(self, x: float) -> Interval:
        if x < 0:
            raise ValueError("an interval is scaled by numbers of 0 or more")
        return self._with(self.lower * x, self.upper * x)

    __rmul__ = __mul__

    def __round__(self, n: int = 0) -> Interval:
        return self._with(round(self.lower, n), round(self.upper, n))

    def __floor__(self) -> Interval:
        return self._with(math.floor(self.lower), math.floor(self.upper))

    def __ceil__(self) -> Interval:
        return self._with(math.ceil(self.lower), math.ceil(self.upper))

    def _with(self, lower: float, upper: float) -> Interval:
        return type(self)(lower, upper, self.confidence_level, self.relative_error)

    def __contains__(self, x: float) -> bool:
        return self.lower <= x <= self.upper

    def intersects(self, other: Interval) -> bool:
        return self.lower <= other.upper and other.lower <= self.upper

    def band(self, c: float) -> Interval:
        return Interval(c - abs(c) * self.relative_error, c + abs(c) * self.relative_error)

    def satisfies(self, op: str, c: float) -> bool:
        """Whether ``interval op c`` is certain."""
        if op in (">", ">=", "<", "<="):
            return {">": self.lower > c, ">=": self.lower >= c, "<": self.upper < c, "<=": self.upper <= c}[op]
        band = self.band(c)
        return self.lower >= band.lower and self.upper <= band.upper if op == "==" else not self.intersects(band)

    def decides(self, op: str, c: float) -> bool:
        """Whether the comparison is certain either way."""
        return self.satisfies(op, c) or self.satisfies({"<": ">=", ">": "<=", "<=": ">", ">=": "<", "==": "!=", "!=": "=="}[op], c)


class CountInterval(Interval):
    pass


class ProportionInterval(Interval):
    pass


def satisfies(op: str, lower: Column, upper: Column, c: float, relative_error: float) -> Column:
    """The same comparison on columns."""
    low, high = c - abs(c) * relative_error, c + abs(c) * relative_error
    return {
        ">": lower > c, ">=": lower >= c, "<": upper < c, "<=": upper <= c,
        "==": (lower >= low) & (upper <= high), "!=": (upper < low) | (lower > high),
    }[op]


def logical_bounds(positives: Column, seen: Column, total: Column) -> tuple[Column, Column]:
    """What a proportion can still be when ``seen`` of ``total`` rows are known."""
    return positives / total, 1 - (seen - positives) / total


def wilson(successes: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Wilson score interval of a proportion."""
    p = successes / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))
