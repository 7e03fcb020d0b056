"""Vector columns: dot product, greatest dot product of a list, in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def max_dot(vectors: Column, query: Column) -> Column:
    """Greatest dot product with ``query`` of the vectors in a list; -1 for none."""
    return F.coalesce(F.array_max(F.transform(vectors, lambda v: dot(v, query))), F.lit(-1.0))
