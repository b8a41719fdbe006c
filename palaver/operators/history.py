"""What recurs in an archive: questions, commands, files, earlier attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import overlap, tokens, words


def repeated_questions(messages: DataFrame, least: int = 4) -> DataFrame:
    """User turns of so many words, as their words alone, that several sessions hold."""
    asked = messages.where("role = 'user'").select("session_id", words(F.col("text")).alias("w")).where(F.size("w") >= least)
    stems = asked.select("session_id", F.array_join("w", " ").alias("stem")).distinct()
    return stems.groupBy("stem").agg(F.count("*").alias("sessions")).where("sessions > 1")


def asked_twice(rows: DataFrame, what: str, hours: int = 48) -> DataFrame:
    """What several sessions asked over so many hours or more: the longest span, then the most sessions."""
    spans = rows.groupBy(what).agg(F.countDistinct("session_id").alias("sessions"), (F.unix_micros(F.max("ts").cast("timestamp")) - F.unix_micros(F.min("ts").cast("timestamp"))).alias("span"))
    return spans.where((F.col("sessions") >= 2) & (F.col("span") >= hours * 3_600_000_000)).orderBy(F.desc("span"), F.desc("sessions"), what).limit(1)


def commands(runs: DataFrame, least: int = 2, most: int = 4000) -> DataFrame:
    """Runs, sessions and last time of each command that several sessions ran, the most frequent ones."""
    table = runs.groupBy("command").agg(F.count("*").alias("runs"), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last"))
    return table.where(F.col("sessions") >= least).orderBy(F.desc("sessions"), "command").limit(most)


def command_projects(runs: DataFrame, least: int = 2, most: int = 24) -> DataFrame:
    """Command, runs, sessions, last and projects: of each command that several sessions ran, its use in the projects of most sessions, ties by name.

    Use is counted by command, project and session, then by command and project: both are partial sums, so a command that
    everyone runs is never one task's rows but the few of its projects.
    """
    own = runs.groupBy("command", "project", "session_id").agg(F.count("*").alias("runs"), F.max("ts").alias("last"))
    each = own.groupBy("command", "project").agg(F.count("*").alias("sessions"), F.sum("runs").alias("runs"), F.max("last").alias("last"))
    total = own.groupBy("command").agg(F.countDistinct("session_id").alias("sessions"), F.sum("runs").alias("runs"), F.max("last").alias("last")).where(F.col("sessions") >= least)
    place = F.row_number().over(Window.partitionBy("command").orderBy(F.desc("sessions"), "project"))
    first = each.withColumn("place", place).where(F.col("place") <= most).groupBy("command").agg(F.array_sort(F.collect_list(F.struct("place", "project", "sessions", "last"))).alias("projects"))
    return total.join(first, "command").select("command", "runs", "sessions", "last", "projects")


def how(runs: DataFrame, terms: list[str], longest: int = 200) -> DataFrame:
    """Commands that hold every term, whatever their case, with their use."""
    low = F.lower("command")
    rows = runs.where(F.length("command") <= longest)
    for t in terms:
        rows = rows.where(F.contains(low, F.lit(t.lower())))
    return rows.groupBy(low.alias("command")).agg(F.count("*").alias("runs"), F.countDistinct("session_id").alias("sessions"), F.max("ts").alias("last"))


def touched(rows: DataFrame, session: str, path: str, most: int = 6) -> DataFrame:
    """The paths that each session touched most often, ties to the first by name."""
    counts = rows.groupBy(session, path).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(session).orderBy(F.desc("n"), path))
    return counts.withColumn("place", rank).where(F.col("place") <= most)


def topic_paths(rows: DataFrame, near: DataFrame, path: str, key: str) -> DataFrame:
    """Paths by how much of their use lies near a topic; near holds the keys of the rows near it, once or more."""
    marked = rows.join(near.select(key).distinct().withColumn("near", F.lit(1)), key, "left")
    scanned = rows.agg(F.countDistinct("session_id").alias("scanned"))
    by = marked.groupBy(path).agg(F.count("*").alias("total"), F.count("near").alias("near"), F.countDistinct("session_id").alias("sessions"), F.countDistinct(F.when(F.col("near") == 1, F.col("session_id"))).alias("near_sessions"))
    score = F.col("near_sessions") * (F.col("near") / F.col("total")) * F.log(1 + F.col("near")) * F.log(1 + F.col("scanned") / F.col("sessions"))
    return by.where("near > 0").crossJoin(F.broadcast(scanned)).select(path, "total", "near", F.round(score, 9).alias("score"))


def superseded(ranked: DataFrame, messages: DataFrame, project: str, share: float = 0.6, hours: int = 24, most: int = 50) -> DataFrame:
    """Of the first so many hits, those of which a hit of the same project, newer by so many hours, holds so much of the smaller word set.

    ranked: session_id, place. The join is among the first hits alone, so their number bounds it, not the archive's size.
    """
    first = F.broadcast(ranked.where(F.col("place") <= most))
    own = messages.join(first, "session_id").groupBy("session_id", "place", project).agg(F.max("ts").alias("updated"), F.array_distinct(F.flatten(F.collect_list(tokens(F.col("text"))))).alias("w"))
    newer = own.select(project, *(F.col(c).alias(f"new_{c}") for c in ("session_id", "place", "updated", "w")))
    later = F.unix_micros(F.col("new_updated").cast("timestamp")) - F.unix_micros(F.col("updated").cast("timestamp")) > hours * 3_600_000_000
    pairs = own.join(newer, project).where(later & (overlap(F.col("w"), F.col("new_w")) >= share))
    return pairs.groupBy("session_id").agg(F.min_by("new_session_id", "new_place").alias("newer"))


def bigrams(texts: DataFrame, text: str = "text", least: int = 2) -> DataFrame:
    """Pairs of words that follow one another, with their number."""
    w = texts.select(words(F.col(text)).alias("w")).where("size(w) > 1")
    pairs = w.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("a"), F.expr("slice(w, 2, size(w) - 1)").alias("b"))).alias("p"))
    return pairs.groupBy(F.col("p.a").alias("word"), F.col("p.b").alias("next")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
