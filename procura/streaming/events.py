"""Streams of events and purchases: extensions, as the batch model has none."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    """A stream with its watermark, on a time zone aware column; a table as it is."""
    if not events.isStreaming:
        return events
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events, users and value per type and window.

    ``n_users`` is exact, on a table; a stream can't count distinct users exactly and has
    ``n_users_approx`` instead.
    """
    marked = _marked(events, late)
    users = F.approx_count_distinct("user_id").alias("n_users_approx") if events.isStreaming else F.countDistinct("user_id").alias("n_users")
    counted = marked.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n_events"), users, F.sum("value").alias("sum_value"))
    return counted.withColumn("window_start", F.col("w.start")).drop("w")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """A user's events closer than ``gap`` as one session; works on a stream and on a table."""
    marked = _marked(events, late)
    return marked.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"), F.sum("value").alias("sum_value")).select(
        "user_id", F.col("s.start").alias("session_start"), "n_events", "sum_value"
    )

