"""Helpers that the training-data operators share.

Nothing outside this subpackage imports it.
"""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Word separators of all contracts: space and the ASCII controls \t \n \v \f \r.
WORD_SEP = r"[\x20\x09-\x0D]+"
WORD_SEP_CHARS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: str.translate table for the same lower-casing in Python code.
ASCII_LOWER = {ord(u): low for u, low in zip(UPPER, LOWER, strict=True)}


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the driver's tables, whole, through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else, so that Python, DuckDB and Spark agree."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    """Words of a text as an array; null and empty texts give an empty array."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), WORD_SEP, -1), lambda w: w != "")


def with_fields(df: DataFrame, ddl: str) -> StructType:
    """Schema of ``df`` with further fields."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder that the driver and all executors see.

    It lies under ``spark.checkpoint.dir``. Where that is unset, a local master (tests on
    one machine) gets a temporary folder for the whole session; any other is an error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{os.path.join(tempfile.gettempdir(), 'checkpoints')}"
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    Cuts the lineage with files that survive lost executors, like a reliable
    checkpoint, but keeps the table columnar so later reads prune columns.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    collect_garbage(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver drop what it no longer refers to, so that Spark's cleaner removes the shuffle
    files of jobs that have ended; it would do so only when its heap fills, while the disks of
    the executors fill first. Each plan also leaves memory outside the heap that its code and its
    files took and C's allocator keeps; that goes back to the system too."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    give_back_native(spark)


def give_back_native(spark: SparkSession) -> str | None:
    """Let the driver's JVM return what its allocator holds unused; None from a JVM that has no such command."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    try:
        server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
        name = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        args = gateway.new_array(jvm.java.lang.Object, 4)  # by reflection: the server's own class is not open to callers
        args[0], args[1] = name, "systemTrimNativeHeap"
        return invoke.invoke(server, args)
    except Py4JJavaError:
        return None


def dealt_join(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join of tables that both grow with the input. A small file of a table (ids take few bytes there)
    would else be gathered and hashed on the driver to be broadcast, at many times its size."""
    return left.join(right.hint("merge"), on, how)


def release(*tables: DataFrame) -> None:
    """Remove tables that :func:`cut` has written and nothing reads any more."""
    for t in tables:
        drop_path(t.sparkSession, t.cut_path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove an intermediate folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """Content of one small file.

    A path that exists on the driver is opened there; anything else goes
    through Spark's binary reader, so tokenizers may lie in any store.
    """
    if os.path.exists(path):
        with open(path, "rb") as f:
            return f.read()
    return bytes(spark.read.format("binaryFile").load(path).select("content").head()[0])
