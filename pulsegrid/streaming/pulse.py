"""Windowed pulses over event streams; the same function serves batch and streaming frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Mean value and count of each user and window; late rows beyond the watermark are dropped when streaming."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    if events.isStreaming:
        rows = rows.withWatermark("ts", late)
    made = rows.groupBy("user_id", F.window("ts", window)).agg(F.count("*").alias("n"), F.avg("value").alias("v"))
    return made.select("user_id", F.col("window.start").alias("start"), "n", "v")
