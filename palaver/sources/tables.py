"""Typed tables of the archive, read from the columnar store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """session_id, seq, role, text, ts: a day a session, a minute a turn."""
    base = F.lit("2024-01-01").cast("timestamp")
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("session_id"),
        F.col("turn").alias("seq"),
        "role",
        "text",
        F.timestamp_add("MINUTE", F.col("turn"), F.timestamp_add("DAY", F.col("conv_id"), base)).alias("ts"),
    )


def usage(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, session_id, kind, bytes, ts, signature of the usage log."""
    return table(spark, folder, "events").select("event_id", F.col("user_id").alias("session_id"), F.col("event_type").alias("kind"), F.col("value").alias("bytes"), "ts", F.get_json_object("props", "$.k").cast("long").alias("signature"))


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """key, seq, ts, state: an append-only log in which the latest state of a key counts."""
    return table(spark, folder, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"), F.col("o_orderstatus").alias("state"))
