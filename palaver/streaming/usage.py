"""The usage log as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events and bytes of each window and kind; on a stream, windows close once events are so late."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width).alias("w"), "kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).select(F.col("w.start").alias("start"), "kind", "n", F.round("bytes", 4).alias("bytes"))


def first_seen(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages without those imported before, by session, time, role and text."""
    keys = ["session_id", "ts", "role", "text"]
    return messages.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys) if messages.isStreaming else messages.dropDuplicates(keys)
