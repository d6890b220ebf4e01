"""Cubes that grow with a stream: an extension beyond batch questions, on event rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_cube(events: DataFrame, delay: str = "1 day", width: str = "1 hour") -> DataFrame:
    """Sums and counts of values by event type and window of event time. Rows later than `delay` behind the latest are
    dropped by the watermark, which also bounds the state. The same plan runs on a batch."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))  # watermarks aren't for times without a zone
    rows = rows.withWatermark("ts", delay) if rows.isStreaming else rows
    out = rows.groupBy(F.window("ts", width).alias("w"), F.col("event_type").alias("EventType")).agg(
        F.round(F.sum("value"), 2).alias("Value_1"), F.count(F.lit(1)).alias("Events_2")
    )
    return out.select(F.col("w.start").alias("start"), "EventType", "Value_1", "Events_2")
