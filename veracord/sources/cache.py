"""Response cache: answers of the model by key, as a Parquet table.

Answers are looked up by a join before the model is asked, each distinct request is
asked once, and new answers are appended after they are complete; a lost or repeated
task cannot write a half answer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "key string, answer string"


class ResponseCache:
    def __init__(self, path: str):
        self.path = path

    def _exists(self, spark: SparkSession) -> bool:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(SCHEMA).parquet(self.path) if self._exists(spark) else spark.createDataFrame([], SCHEMA)

    def append(self, answers: DataFrame) -> None:
        answers.select("key", "answer").write.mode("append").parquet(self.path)

    def count(self, spark: SparkSession) -> int:
        return self.read(spark).count()

    def clear(self, spark: SparkSession) -> None:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
