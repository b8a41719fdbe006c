"""Listings, lookups and filters over sessions and their messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(rows: DataFrame, role: str | None = None, work: tuple[str, ...] = ("files", "command", "edit")) -> DataFrame:
    """Rows of one role; without one, all but records of work."""
    return rows.where(F.col("role") == role) if role else rows.where(F.col("role").isNull() | ~F.col("role").isin(*work))


def allowed(origin: Column, rules: dict[str, bool]) -> Column:
    """The most specific rule for an origin: its own, that of all imported ones, that of all; true without any."""
    of = lambda key: F.lit(rules[key]) if key in rules else F.lit(None).cast("boolean")
    own = F.lit(None).cast("boolean")
    for key, verdict in rules.items():
        own = F.when(origin == key, F.lit(verdict)).otherwise(own)
    return F.coalesce(own, F.when(origin.startswith("imported:"), of("imported")), of("*"), F.lit(True))


def policy_counts(rows: DataFrame, origin: str, rules: dict[str, bool]) -> DataFrame:
    """Served and withheld rows of each origin."""
    ok = rows.select(origin, allowed(F.col(origin), rules).alias("ok"))
    return ok.groupBy(origin).agg(F.count_if("ok").alias("served"), F.count_if(~F.col("ok")).alias("withheld"))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The sessions of latest activity, newest first."""
    return messages.groupBy("session_id").agg(F.max("ts").alias("updated")).orderBy(F.desc("updated"), "session_id").limit(n)


def recent_by(rows: DataFrame, group: str, order: str, key: str, n: int) -> DataFrame:
    """The newest rows of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order), key))
    return rows.select(group, order, key, rank.alias("place")).where(F.col("place") <= n)


def by_prefix(messages: DataFrame, prefix: str) -> DataFrame:
    """Sessions whose id begins so, and how many there are."""
    ids = messages.select("session_id").where(F.col("session_id").cast("string").startswith(prefix)).distinct()
    return ids.crossJoin(F.broadcast(ids.agg(F.count("*").alias("matches"))))


def neighbourhood(messages: DataFrame, hit: Column, around: int = 2) -> DataFrame:
    """Hits with so many turns before and after each."""
    by = Window.partitionBy("session_id").orderBy("seq")
    rows = messages.select("session_id", "seq", hit.alias("hit")).withColumn("near", F.max("hit").over(by.rowsBetween(-around, around)))
    return rows.where("near").select("session_id", "seq", "hit")


def titles(messages: DataFrame, words: int = 4, most: int = 60) -> DataFrame:
    """A session's first user turn of so many words, else its first assistant turn, else its first turn, cut to so many characters."""
    ample = F.size(F.regexp_extract_all("text", F.lit(r"[^ \n\t]+"), F.lit(0))) >= words
    kind = F.when((F.col("role") == "user") & ample, 0).when(F.col("role") == "assistant", 1).otherwise(2)
    first = messages.groupBy("session_id").agg(F.min(F.struct(kind.alias("kind"), "seq", "text")).alias("t"))
    return first.select("session_id", F.substring("t.text", 1, most).alias("title"), (F.col("t.kind") == 1).alias("by_assistant"))


def pushed_to(sessions: DataFrame, marks: DataFrame) -> DataFrame:
    """The peers whose watermark for a session's source isn't before its start; (peer, source) pairs are few per source."""
    reached = sessions.join(marks, "source").where(F.col("mark") >= F.col("started"))
    return reached.groupBy("session_id").agg(F.array_join(F.array_sort(F.collect_set("peer")), ",").alias("peers"))


def last_distinct(rows: DataFrame, session: str, value: str, n: int = 8) -> DataFrame:
    """The last distinct values of each session."""
    last = rows.groupBy(session, value).agg(F.max("ts").alias("last"))
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("last"), value))
    return last.withColumn("place", rank).where(F.col("place") <= n)
