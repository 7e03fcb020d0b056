"""Dialogs: replies put together into conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veracord.sources.tables import materialise


def concat_turns(df: DataFrame, dialog: str, turn: str, role: str, text: str, least: int = 1, most: int = 1000) -> DataFrame:
    """One row per dialog of ``least`` to ``most`` turns: its lines in order, a blank line between them."""
    line = F.concat(F.col(role), F.lit(": "), F.coalesce(F.col(text), F.lit("")))
    lines = F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), line.alias("l"))))
    return df.groupBy(dialog).agg(F.count("*").alias("turns"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n\n").alias("dialog")).where(F.col("turns").between(least, most))


def thread_roots(messages: DataFrame, message: str, parent: str) -> DataFrame:
    """message, root, depth of every message; a root's parent is unknown (null, or not in the table).

    Pointer doubling: each round joins the table with itself once and doubles the reach,
    until no message's root has a parent; a round is written before the next one begins.
    Messages that answer each other in a circle are an error. Message ids are distinct.
    """
    known = messages.select(F.col(message).alias("__k"))
    links = messages.select(F.col(message).alias("m"), F.col(parent).alias("p")).join(known, F.col("p") == F.col("__k"), "left")
    at = materialise(links.select("m", F.coalesce("__k", "m").alias("root"), F.when(F.col("__k").isNull(), 0).otherwise(1).alias("depth")), "threads")
    reach, most = 1, at.count()
    while True:
        up = at.select(F.col("m").alias("__m"), F.col("root").alias("r2"), F.col("depth").alias("d2"))
        further = at.join(up, F.col("root") == F.col("__m"))
        if further.where("d2 > 0").isEmpty():
            return at.withColumnRenamed("m", message)
        if reach > most:
            raise ValueError("messages answer each other in a circle")
        at = materialise(further.select("m", F.col("r2").alias("root"), (F.col("depth") + F.col("d2")).alias("depth")), "threads")
        reach *= 2
