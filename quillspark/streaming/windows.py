"""Windowed counts of events, the same for a table and for a stream.

The reference has no streaming; these are extras. On a stream, late events are dropped behind the watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events (ts, event_type, value) per window and type."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if late else rows
    out = rows.groupBy(F.window("at", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return out.select(F.unix_seconds("w.start").alias("start_s"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Sessions of a user: runs of events closer than ``gap``."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("at", late) if late else rows
    out = rows.groupBy("user_id", F.session_window("at", gap).alias("s")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_micros("s.start").alias("start_us"), "n")
