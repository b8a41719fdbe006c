"""Statistics, joins in time and mined tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.language import friction, stripped


def overview(messages: DataFrame) -> DataFrame:
    """Sessions, messages and the archive's first and last time."""
    return messages.agg(F.countDistinct("session_id").alias("sessions"), F.count("*").alias("messages"), F.min("ts").alias("oldest"), F.max("ts").alias("newest"))


def session_stats(messages: DataFrame) -> DataFrame:
    """Messages, words and minutes of each session."""
    return messages.groupBy("session_id").agg(F.count("*").alias("messages"), F.sum(F.size(F.expr("filter(split(text, '[ \\n\\t]+'), w -> w != '')"))).cast("long").alias("words"), ((F.max("ts").cast("long") - F.min("ts").cast("long")) / 60).cast("long").alias("minutes"))


def monthly(rows: DataFrame, ts: str, first: str, months: int) -> DataFrame:
    """Rows of each of so many months from the first one, none left out."""
    spine = rows.sparkSession.range(months).select(F.add_months(F.lit(first).cast("date"), F.col("id").cast("int")).alias("month"))
    counts = rows.groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("month")).agg(F.count("*").alias("n"))
    return spine.join(counts, "month", "left").select(F.date_format("month", "yyyy-MM").alias("month"), F.coalesce("n", F.lit(0)).alias("n"))


def heatmap(rows: DataFrame, ts: str, first_sunday: str) -> DataFrame:
    """Rows by week from a Sunday on and by weekday (Sunday is 0)."""
    day = F.datediff(F.col(ts).cast("date"), F.lit(first_sunday).cast("date"))
    return rows.where(day >= 0).groupBy(F.floor(day / 7).alias("week"), F.pmod(day, F.lit(7)).cast("long").alias("weekday")).agg(F.count("*").alias("n"))


def busiest_day(rows: DataFrame, ts: str) -> DataFrame:
    """The day of most rows, the earliest of equal ones."""
    return rows.groupBy(F.date_format(ts, "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "day").limit(1)


def recurring(walls: DataFrame, least: int = 3) -> DataFrame:
    """A10: signatures met in so many sessions or more, with their last time."""
    return walls.groupBy("signature").agg(F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last")).where(F.col("sessions") >= least)


def fixes(events: DataFrame, wall: str = "error", command: str = "click", ahead: int = 10, quiet: int = 6) -> DataFrame:
    """The first command among so many events after each wall, unless the wall is back within so many events after that command."""
    by = Window.partitionBy("session_id").orderBy("ts", "event_id")
    rows = events.withColumn("i", F.row_number().over(by))
    near = rows.select("*", F.min(F.when(F.col("kind") == command, F.struct("i", "event_id"))).over(by.rowsBetween(1, ahead)).alias("fix"), F.collect_list(F.when(F.col("kind") == wall, F.struct("i", "signature"))).over(by.rowsBetween(1, ahead + quiet)).alias("walls"))
    back = F.exists("walls", lambda w: (w["signature"] == F.col("signature")) & (w["i"] > F.col("fix.i")) & (w["i"] <= F.col("fix.i") + quiet))
    return near.where((F.col("kind") == wall) & F.col("fix").isNotNull() & ~back).select("session_id", "event_id", "signature", F.col("fix.event_id").alias("fix_id"))


#: Words of errors and commands that tell nothing of what they are about.
COMMON_TERMS = "bash sudo true false null file http https test main head tail grep echo error command found cannot unable failed usage fatal invalid unknown expected missing".split()


def _telling_terms(text: Column) -> Column:
    trimmed = F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_./-]{4,}"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[/.]+|[/.]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda t: (F.char_length(t) >= 4) & ~t.isin(COMMON_TERMS)))


def mined_fixes(records: DataFrame, ahead: int = 10, quiet: int = 6, longest: int = 200) -> DataFrame:
    """Pairs of an error line and the command that ended it, newest of each; those that share no term and happened once are candidates.

    records: session_id, seq, role, text, ts. What installs something may hold the term within a longer name.
    """
    by = Window.partitionBy("session_id").orderBy("seq")
    lines = F.when(F.col("role").isin("tool-output", "assistant"), F.filter(F.transform(F.split("text", "\n"), friction), lambda x: x.isNotNull()))
    command = F.when(F.col("role") == "command", stripped(F.substring_index("text", "\n", 1)))
    rows = records.select("session_id", "seq", "ts", lines.alias("lines"), F.when((command != "") & (F.octet_length(command) <= longest), command).alias("command")).withColumn("i", F.row_number().over(by))
    near = rows.select("*", F.min(F.when(F.col("command").isNotNull(), F.struct("i", "command", "ts"))).over(by.rowsBetween(1, ahead)).alias("fix"), F.collect_list(F.when(F.size("lines") > 0, F.struct("i", "lines"))).over(by.rowsBetween(1, ahead + quiet)).alias("walls"))
    error = F.get("lines", F.lit(0))
    back = F.exists("walls", lambda w: F.array_contains(w["lines"], error) & (w["i"] > F.col("fix.i")) & (w["i"] <= F.col("fix.i") + quiet))
    pairs = near.where(error.isNotNull() & F.col("fix").isNotNull() & ~back).select(error.alias("error"), F.col("fix.command").alias("command"), F.col("fix.ts").alias("ts"))
    known, used = _telling_terms(F.col("error")), F.filter(F.transform(F.regexp_extract_all(F.lower("command"), F.lit(r"[a-z0-9_./-]{4,}"), F.lit(0)), lambda t: F.regexp_replace(t, r"^[/.]+|[/.]+$", "")), lambda t: F.char_length(t) >= 4)
    shares = F.arrays_overlap(known, used) | (F.lower("command").rlike(r"\binstall\b") & F.exists(used, lambda u: F.exists(known, lambda k: F.contains(u, k))))
    own = pairs.withColumn("shares", F.coalesce(shares, F.lit(False))).groupBy("error", F.lower("command").alias("key"))
    return own.agg(F.max_by("command", "ts").alias("command"), F.max("ts").alias("ts"), (~F.bool_or("shares") & (F.count("*") < 2)).alias("candidate")).drop("key")


def fixes_for(pairs: DataFrame, pasted: str, most: int = 3) -> DataFrame:
    """What ended any of the errors that a pasted text holds; pasted is one short text, candidates don't count."""
    spark = pairs.sparkSession
    lines = spark.createDataFrame([(x,) for x in pasted.split("\n")], "line string").select(friction(F.col("line")).alias("error")).where("error is not null").distinct()
    return pairs.where("not candidate").join(F.broadcast(lines), "error").orderBy(F.desc("ts"), "command").limit(most)


def near_in_time(left: DataFrame, right: DataFrame, minutes: int = 20) -> DataFrame:
    """Pairs of the same session less than so many minutes apart, by buckets of that width and an exact test."""
    width = minutes * 60
    bucket = F.floor(F.unix_timestamp("ts") / width)
    a = left.select("session_id", F.col("event_id").alias("left_id"), F.col("ts").alias("lt"), F.explode(F.array(bucket - 1, bucket, bucket + 1)).alias("bucket"))
    b = right.select("session_id", F.col("event_id").alias("right_id"), F.col("ts").alias("rt"), bucket.alias("bucket"))
    apart = F.abs(F.unix_micros(F.col("lt").cast("timestamp")) - F.unix_micros(F.col("rt").cast("timestamp")))
    return a.join(b, ["session_id", "bucket"]).where(apart < width * 1_000_000).select("session_id", "left_id", "right_id")


def latest_state(notes: DataFrame) -> DataFrame:
    """The latest state of each key."""
    return notes.groupBy("key").agg(F.max_by("state", F.struct("ts", "seq")).alias("state"), F.count("*").alias("n"))


def deduplicated(messages: DataFrame) -> DataFrame:
    """One row of each session, role, time and text, the earliest; the same words at another time are another turn."""
    return messages.groupBy("session_id", "role", "ts", "text").agg(F.min("seq").alias("seq"))


def without(rows: DataFrame, forgotten: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no tombstone."""
    return rows.join(forgotten, key, "left_anti")


def answers(messages: DataFrame, within: int = 3) -> DataFrame:
    """Of each user turn the first assistant turn among the next ones, unless another user turn comes first."""
    by = Window.partitionBy("session_id").orderBy("seq").rowsBetween(1, within)
    first = lambda role: F.min(F.when(F.col("role") == role, F.col("seq"))).over(by)
    rows = messages.select("session_id", "seq", "role", first("assistant").alias("answer"), first("user").alias("other"))
    return rows.where((F.col("role") == "user") & F.col("answer").isNotNull() & (F.col("other").isNull() | (F.col("answer") < F.col("other")))).select("session_id", "seq", "answer")


def usage_totals(events: DataFrame, as_of: str) -> DataFrame:
    """Events, bytes and sessions by kind: all, of the last 7 days and of the last day; later ones don't count."""
    now = F.lit(as_of).cast("timestamp")
    rows = events.where(F.col("ts") <= now)
    since = lambda days: F.col("ts") > F.timestamp_add("DAY", F.lit(-days), now)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum("bytes"), 4).alias("bytes"), F.countDistinct("session_id").alias("sessions"), F.count_if(since(7)).alias("week"), F.count_if(since(1)).alias("day"))


def worn(events: DataFrame, least: int = 2) -> DataFrame:
    """How often each session was recalled, if so many times or more."""
    return events.where("kind = 'view'").groupBy("session_id").agg(F.count("*").alias("recalls")).where(F.col("recalls") >= least)


def export_since(events: DataFrame, mark: str, seen: list[int]) -> DataFrame:
    """Rows after the watermark, those at it that weren't delivered, and those without a time."""
    at = F.lit(mark).cast("timestamp")
    return events.where(F.col("ts").isNull() | (F.col("ts") > at) | ((F.col("ts") == at) & ~F.col("event_id").isin(seen or [-1])))
