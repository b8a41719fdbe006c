"""Counts over an archive, and what runs along a session: budgets, carried flags, new suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import words
from .history import bigrams


def inventory(rows: DataFrame, source: str, text: str = "text") -> DataFrame:
    """Rows, bytes and empty rows of each source."""
    return rows.groupBy(source).agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("bytes"), F.count_if(F.coalesce(F.length(text), F.lit(0)) == 0).alias("empty"))


def credits(events: DataFrame, kind: str, as_of: str) -> DataFrame:
    """Events of a kind by session, all and those of the last 7 days."""
    week = F.col("ts") > F.timestamp_add("DAY", F.lit(-7), F.lit(as_of).cast("timestamp"))
    return events.where(F.col("kind") == kind).groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(week).alias("week"))


def windows(events: DataFrame, as_of: str, days: tuple[int, ...] = (7, 14, 60, 90)) -> DataFrame:
    """Events by kind within so many days before a time, a column a span."""
    now = F.lit(as_of).cast("timestamp")
    return events.where(F.col("ts") <= now).groupBy("kind").agg(*(F.count_if(F.col("ts") > F.timestamp_add("DAY", F.lit(-d), now)).alias(f"days_{d}") for d in days))


def most_reused(recalls: DataFrame, sessions: DataFrame, as_of: str) -> DataFrame:
    """The session recalled most among those settled for a day."""
    settled = sessions.where(F.col("updated") < F.timestamp_add("DAY", F.lit(-1), F.lit(as_of).cast("timestamp")))
    return recalls.join(settled, "session_id").orderBy(F.desc("recalls"), "session_id").limit(1).select("session_id", "recalls")


def suggested(messages: DataFrame) -> DataFrame:
    """The pair of words in a row, each in two messages or more, whose words are rarest together."""
    own = messages.where("role = 'user'").select("text")
    df = own.select(F.explode(F.array_distinct(words(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df")).where("df >= 2")
    n = F.broadcast(own.agg(F.count("*").alias("total")))
    a, b = (df.select(F.col("token").alias(c), F.col("df").alias(f"df_{c}")) for c in ("word", "next"))
    score = F.round(F.log(F.col("total") / F.col("df_word")) + F.log(F.col("total") / F.col("df_next")), 9)
    return bigrams(own).join(a, "word").join(b, "next").crossJoin(n).select("word", "next", score.alias("score")).where("score >= 1").orderBy(F.desc("score"), "word", "next").limit(1)


def last_other(rows: DataFrame, path: str) -> DataFrame:
    """For each session and path, the other session that touched the path last. A path keeps two candidates, whatever its use."""
    own = rows.groupBy("session_id", path).agg(F.max("ts").alias("last"))
    order = Window.partitionBy(path).orderBy(F.desc("last"), "session_id")
    top = own.withColumn("place", F.row_number().over(order)).where("place <= 2")
    first = top.groupBy(path).agg(F.min_by("session_id", "place").alias("one"), F.max_by("session_id", "place").alias("two"))
    other = F.when(F.col("session_id") != F.col("one"), F.col("one")).when(F.col("two") != F.col("session_id"), F.col("two"))
    return own.join(first, path).select("session_id", path, other.alias("other")).where("other is not null")


def first_distinct(rows: DataFrame, session: str, value: str, n: int = 8) -> DataFrame:
    """The first distinct values of each session in the order of their time."""
    first = rows.where(F.col(value).isNotNull()).groupBy(session, value).agg(F.min("ts").alias("first"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(session).orderBy("first", value))).where(F.col("place") <= n)


def carried(messages: DataFrame, keep: Column, role: str = "assistant") -> DataFrame:
    """Kept rows; one of the role is kept if the last row of another role before it is."""
    other = F.when(F.col("role") != role, keep)
    flag = F.last(other, ignorenulls=True).over(Window.partitionBy("session_id").orderBy("seq"))
    return messages.withColumn("kept", F.coalesce(flag, F.lit(False))).where("kept").drop("kept")


def new_suffix(messages: DataFrame, counted: DataFrame) -> DataFrame:
    """The messages after the last one that was counted; all of a session without it. counted: session_id, mark (the SHA-256 of a text)."""
    marked = messages.join(counted, "session_id", "left").withColumn("at", F.when(F.sha2("text", 256) == F.col("mark"), F.col("seq")))
    last = F.max("at").over(Window.partitionBy("session_id"))
    return marked.withColumn("last", last).where("last is null or seq > last").select("session_id", "seq")


def budgeted(rows: DataFrame, session: str, order: str, text: str, most: int) -> DataFrame:
    """Rows in order until so many bytes are reached, and how many bytes each may take; the last one is cut."""
    size = F.coalesce(F.octet_length(text), F.lit(0))
    before = F.coalesce(F.sum(size).over(Window.partitionBy(session).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.select(session, order, size.alias("size"), before.alias("before")).where(F.col("before") < most).select(session, order, F.least(F.col("size"), most - F.col("before")).cast("long").alias("bytes"))


def longest_tokens(tokens: Column, n: int = 8) -> Column:
    """The longest tokens by bytes, ties by their bytes, joined by spaces."""
    return F.array_join(F.slice(F.transform(F.array_sort(F.transform(tokens, lambda t: F.struct((-F.octet_length(t)).alias("n"), t.alias("t")))), lambda s: s["t"]), 1, n), " ")
