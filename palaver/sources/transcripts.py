"""Transcripts in JSON lines of several shapes, as one schema: session_id, seq, role, text, ts.

Malformed lines are skipped and counted. Each shape is a projection over a VARIANT column, so reading stays in the JVM and
runs alike on a batch of files and on a stream of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get("v", path, kind)


def _blocks(path: str) -> Column:
    """The text of polymorphic content: a string, or an array of blocks whose texts are joined by line feeds."""
    blocks = F.try_variant_get("v", path, "array<struct<type string, text string>>")
    return F.coalesce(F.array_join(F.transform(F.filter(blocks, lambda b: b["text"].isNotNull()), lambda b: b["text"]), "\n"), _get(path))


def lenient_time(raw: Column) -> Column:
    """ISO text or an epoch in seconds or, above 1e12, in milliseconds."""
    number = raw.try_cast("double") if hasattr(raw, "try_cast") else raw.cast("double")
    return F.when(number > 1e12, F.timestamp_micros((number * 1000).cast("long"))).when(number.isNotNull(), F.timestamp_micros((number * 1_000_000).cast("long"))).otherwise(F.try_to_timestamp(raw))


#: By shape: session, role, text and time of a line.
SHAPES: dict[str, tuple] = {
    "message_blocks": (lambda: _get("$.sessionId"), lambda: _get("$.type"), lambda: _blocks("$.message.content"), lambda: _get("$.timestamp")),
    "payload": (lambda: _get("$.payload.session_id"), lambda: _get("$.payload.role"), lambda: _blocks("$.payload.content"), lambda: _get("$.timestamp")),
    "parts": (lambda: _get("$.sessionId"), lambda: _get("$.message.role"), lambda: _blocks("$.message.parts"), lambda: _get("$.timestamp")),
    "history": (lambda: _get("$.session_id"), lambda: F.lit("user"), lambda: _get("$.text"), lambda: _get("$.ts")),
    "sync": (lambda: _get("$.session_id"), lambda: _get("$.role"), lambda: _get("$.text"), lambda: _get("$.time")),
}


def parsed(lines: DataFrame, shape: str) -> DataFrame:
    """value (a line), path and n (its place) to session_id, seq, role, text, ts; malformed lines give malformed = true and nulls."""
    session, role, text, ts = SHAPES[shape]
    v = lines.withColumn("v", F.try_parse_json("value"))
    return v.select(F.coalesce(session(), F.col("path")).alias("session_id"), F.col("n").alias("seq"), role().alias("role"), text().alias("text"), lenient_time(ts()).alias("ts"), F.col("v").isNull().alias("malformed"))


def read_lines(spark: SparkSession, path: str, shape: str) -> DataFrame:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.monotonically_increasing_id().alias("n"))
    return parsed(lines, shape)
