"""Structured Streaming extra: events to usage per user and window, late data up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_usage(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """``events`` (ts, user_id, event_type, value), batch or stream, to counts and sums per user and window."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = stamped.withWatermark("ts", late).groupBy(F.window("ts", width), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), "user_id", "n", "value")
