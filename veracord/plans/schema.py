"""Data model: fields, schemas with a mandatory key, rows."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

AGG_KEY = "_id"
AGG_ROW = "_agg"
_SPARK = {int: T.LongType(), float: T.DoubleType(), str: T.StringType(), bool: T.BooleanType()}


def ref(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def refs(names) -> list[Column]:
    return [ref(n) for n in names]


def spark_type(dtype: object) -> T.DataType:
    """Spark type of a Python class, an Enum (its values are strings) or a Spark type itself."""
    if isinstance(dtype, T.DataType):
        return dtype
    if isinstance(dtype, type) and issubclass(dtype, Enum):
        return T.StringType()
    if dtype in _SPARK:
        return _SPARK[dtype]
    if dtype is list or str(dtype) in ("list[float]", "typing.List[float]"):
        return T.ArrayType(T.DoubleType())
    if str(dtype) == "list[list[float]]":
        return T.ArrayType(T.ArrayType(T.DoubleType()))
    raise TypeError(f"no Spark type for {dtype!r}")


def python_type(dtype: T.DataType) -> object:
    for py, kind in ((bool, T.BooleanType), (int, T.IntegralType), (float, T.FractionalType), (str, T.StringType)):
        if isinstance(dtype, kind):
            return py
    return dtype


@dataclass(frozen=True)
class Field:
    name: str
    dtype: object
    description: str | None = None


@dataclass(frozen=True)
class Schema:
    """Ordered fields and the names of those that identify a row."""

    fields: tuple[Field, ...]
    key: tuple[str, ...]

    def __post_init__(self):
        missing = [k for k in self.key if k not in self.names]
        if missing:
            raise KeyError(f"key fields {missing} are not in the schema")

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def field(self, name: str) -> Field:
        for f in self.fields:
            if f.name == name:
                return f
        raise KeyError(name)

    def with_fields(self, *more: Field) -> Schema:
        old = {f.name for f in more}
        return Schema((*(f for f in self.fields if f.name not in old), *more), self.key)

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, spark_type(f.dtype), True, {"comment": f.description} if f.description else {}) for f in self.fields])

    @staticmethod
    def of(struct: T.StructType, key: tuple[str, ...]) -> Schema:
        return Schema(tuple(Field(f.name, python_type(f.dataType), (f.metadata or {}).get("comment")) for f in struct.fields), key)


class Row:
    """Values in schema order; provenance, where asked for, by column name. Equality ignores provenance."""

    __slots__ = ("provenance", "values")

    def __init__(self, values: tuple, provenance: dict | None = None):
        self.values, self.provenance = tuple(values), provenance or {}

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Row) and self.values == other.values

    def __hash__(self) -> int:
        return hash(self.values)

    def __getitem__(self, i: int) -> object:
        return self.values[i]

    def __repr__(self) -> str:
        return f"Row({self.values!r})"
