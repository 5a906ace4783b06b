"""Streaming forms of the event feeds. Event time is ts; what comes later than the watermark is dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LATE = "10 minutes"


def live_sessions(events: DataFrame, key: str = "user_id", idle: str = "1 hour", late: str = LATE) -> DataFrame:
    """Sessions by idle time with their event counts; the same plan in batch and as a stream."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = rows.groupBy(key, F.session_window("ts", idle).alias("w")).agg(F.count("*").alias("events"), F.max("ts").alias("ended"))
    return grouped.select(key, F.col("w.start").alias("began"), "ended", "events")


def change_batches(changes: DataFrame, key: str = "repo", quiet: str = "200 milliseconds", late: str = LATE) -> DataFrame:
    """Paths that changed without a quiet gap between them, as one batch per key."""
    rows = changes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    grouped = rows.groupBy(key, F.session_window("ts", quiet).alias("w")).agg(F.sort_array(F.collect_set("path")).alias("paths"))
    return grouped.select(key, F.col("w.start").alias("began"), "paths")


def cost_totals(events: DataFrame, key: str = "tool", late: str = LATE) -> DataFrame:
    """Running calls and tokens per tool, for update mode."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return rows.groupBy(key).agg(F.count("*").alias("calls"), F.sum("tokens").alias("tokens"))
