"""Standing claims over a stream: quantifiers per event-time window, with late data bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracord.plans.lower import exact


def windowed_verdict(events: DataFrame, ts: str, arg: Column, kind: str, verdict, width: str = "1 day", slide: str | None = None, late: str = "1 hour", by: tuple[str, ...] = ()) -> DataFrame:
    """window_start, ``by``, rows, value, verdict for each window; works on a stream and on a table.

    ``verdict`` turns the value column into a boolean column. On a stream a window is final
    when the watermark has passed its end.
    """
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    window = F.window(F.col(ts), width, slide) if slide else F.window(F.col(ts), width)
    out = rows.select(ts, *by, arg.alias("__v")).groupBy(window.alias("w"), *by).agg(F.count("*").alias("rows"), exact(kind, F.col("__v")).alias("value"))
    return out.select(F.col("w.start").alias("window_start"), *by, "rows", "value", verdict(F.col("value")).alias("verdict"))


def session_verdict(events: DataFrame, ts: str, key: str, arg: Column, kind: str, verdict, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """The same over sessions of a key: events less than ``gap`` apart."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    out = rows.select(ts, key, arg.alias("__v")).groupBy(F.session_window(F.col(ts), gap).alias("w"), key).agg(F.count("*").alias("rows"), exact(kind, F.col("__v")).alias("value"))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), key, "rows", "value", verdict(F.col("value")).alias("verdict"))


def run_to_memory(stream: DataFrame, name: str) -> DataFrame:
    """Process what is there now and give the result as a table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
