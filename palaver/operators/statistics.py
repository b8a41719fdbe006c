"""The statistics report: who was used how much, the last year by month, and by week and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Levels of a month beside the empty one.
LEVELS = 7


def report(rows: DataFrame, projects: int = 5) -> DataFrame:
    """Section, name, sessions, messages: the total, each harness, the projects of most sessions and the longest session.

    A session is known by its id, harness and project; rows without a project count under '-', those without a harness under
    null. Of equal projects the first by name stays, of equally long sessions the one of smallest id. An empty table has a
    total of zeros and nothing else.
    """
    project = F.coalesce(F.col("project").cast("string"), F.lit("-")).alias("project")
    sessions = rows.groupBy("session_id", "harness", project).agg(F.count("*").alias("n"))
    sizes = F.count("*").alias("sessions"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("messages")

    def section(name: str, df: DataFrame, key) -> DataFrame:
        return df.select(F.lit(name).alias("section"), key.cast("string").alias("name"), "sessions", "messages")

    top = sessions.groupBy("project").agg(*sizes).orderBy(F.desc("sessions"), "project").limit(projects)
    longest = sessions.orderBy(F.desc("n"), "session_id", "harness", "project").limit(1).select("session_id", F.lit(1).cast("long").alias("sessions"), F.col("n").alias("messages"))
    return (
        section("total", sessions.agg(*sizes), F.lit(None))
        .unionByName(section("harness", sessions.groupBy("harness").agg(*sizes), F.col("harness")))
        .unionByName(section("project", top, F.col("project")))
        .unionByName(section("longest", longest, F.col("session_id")))
    )


def months(rows: DataFrame, ts: str, today: str) -> DataFrame:
    """Month, n, level of the twelve months that end with today's, none left out.

    The level of a month with rows is 1 to ``LEVELS`` by its share of the fullest one, 0 of an empty month. Rows without a time
    count nowhere.
    """
    last = F.trunc(F.lit(today).cast("date"), "month")
    spine = rows.sparkSession.range(12).select(F.add_months(last, F.col("id").cast("int") - 11).alias("month"))
    own = F.trunc(F.col(ts).cast("date"), "month")
    counts = rows.where(own.between(F.add_months(last, -11), last)).groupBy(own.alias("month")).agg(F.count("*").alias("n"))
    filled = spine.join(F.broadcast(counts), "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))  # twelve rows at most
    most = F.max("n").over(Window.partitionBy(F.lit(0)))
    return filled.select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.when(F.col("n") == 0, 0).otherwise(F.floor((F.col("n") - 1) * LEVELS / most) + 1).cast("long").alias("level"))


def year_grid(rows: DataFrame, ts: str, today: str) -> DataFrame:
    """Week, weekday (Sunday is 0), n of the weeks from the Sunday on or before the 370th day back up to today's.

    A day without rows has 0, a day of this week after today -1.
    """
    end = F.lit(today).cast("date")
    back = F.date_sub(end, 370)
    start = F.date_sub(back, F.dayofweek(back) - 1)
    day = F.date_add(start, F.col("id").cast("int"))
    spine = rows.sparkSession.range(54 * 7).where(F.col("id") <= F.datediff(F.date_add(end, 7 - F.dayofweek(end)), start)).select("id", day.alias("day"))
    own = F.col(ts).cast("date")
    counts = rows.where(own.between(start, end)).groupBy(own.alias("day")).agg(F.count("*").alias("n"))
    cells = spine.join(F.broadcast(counts), "day", "left")  # 377 rows at most
    return cells.select(F.floor(F.col("id") / 7).alias("week"), (F.col("id") % 7).alias("weekday"), F.when(F.col("day") > end, -1).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))
