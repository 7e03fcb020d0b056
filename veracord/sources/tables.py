"""Readers and writers: JSON lines with the first line's columns, Parquet, logs with their key."""

from __future__ import annotations

import json
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracord.plans.schema import Schema

_JSON = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


def _json_type(v: object) -> T.DataType:
    if type(v) in _JSON:
        return _JSON[type(v)]
    if isinstance(v, list):
        return T.ArrayType(_json_type(v[0]) if v else T.StringType())
    if isinstance(v, dict):
        return T.StructType([T.StructField(k, _json_type(x)) for k, x in v.items()])
    return T.StringType()


def read_jsonl(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Columns and types as on the first line, in its order; further keys are dropped.

    A later line without a key has null there; with ``strict``, a line that does not fit
    the types fails the query instead of giving nulls.
    """
    first = spark.read.text(path).limit(1).collect()
    if not first:
        raise ValueError(f"{path} is empty")
    row = json.loads(first[0][0])
    schema = T.StructType([T.StructField(k, _json_type(v)) for k, v in row.items()])
    return spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path).select(*row)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.schema(schema) if schema else reader).csv(path)


def write_log(df: DataFrame, schema: Schema, path: str) -> None:
    """Rows as Parquet and, once they are complete, the schema beside them."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    side = df.sparkSession.createDataFrame([(json.dumps({"key": list(schema.key), "columns": schema.names}),)], "schema string")
    side.coalesce(1).write.mode("overwrite").parquet(f"{path}/schema")


def read_log(spark: SparkSession, path: str) -> tuple[DataFrame, Schema]:
    said = json.loads(spark.read.parquet(f"{path}/schema").head()[0])
    df = spark.read.parquet(f"{path}/rows").select(*said["columns"])
    return df, Schema.of(df.schema, tuple(said["key"]))


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the cluster's shared folder, ``spark.checkpoint.dir``. Where that is unset, a
    local master gets a temporary folder; any other master is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "base") -> DataFrame:
    """Write to the cluster's shared folder and read again; survives lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, by: list[Column], groups: list[str], name: str) -> DataFrame:
    """``df``, written, with ``name``: the place of each row, from 1, in its group in the order ``by``.

    Rows are ranged over tasks by group and order, so that neither the whole table nor a
    hot group meets in one task; each range's rows are numbered where they lie, and the
    counts of the ranges before it in the group are added. That table has a row for each
    range and group that meet; without groups it is broadcast, so that no row moves again.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(f"`{g}`") for g in groups]
    ranged = df.repartitionByRange(parts, *keys, *by).sortWithinPartitions(*keys, *by)
    written = materialise(ranged.withColumn("__at", F.monotonically_increasing_id()), "numbered")
    placed = written.withColumn("__part", F.shiftright("__at", 33))
    ranges = placed.groupBy("__part", *keys).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranges.select(F.col("__part").alias("__p"), *(k.alias(f"__g{i}") for i, k in enumerate(keys)), "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & k.eqNullSafe(F.col(f"__g{i}"))
    place = (F.col("__before") + F.col("__at") - F.col("__first") + 1).cast("long")
    return placed.join(starts if groups else F.broadcast(starts), same).select(*(F.col(f"`{c}`") for c in df.columns), place.alias(name))
