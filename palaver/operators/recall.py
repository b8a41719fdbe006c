"""What comes back from a long session, and from plans: the densest turns, and walls that a plan's steps have met before."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.query import relevance_terms
from .planner import INFORMATIVE, Store

#: A wall was met in so many sessions; the floor of a name's rarity, which lies below that of other words.
MET, NAMED = 3, 1.0
NAME = r"[_./0-9-]"


def densest(messages: DataFrame, terms: list[str], most: int = 300, around: int = 2) -> DataFrame:
    """A session of more than so many turns as its hits and the turns around them; if these are too many, the turns that hold most of the terms.

    Ties go to the earlier turn; short sessions stay whole, long ones without a hit go.
    """
    hits: Column = reduce(lambda a, b: a + b, (F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lit(t.lower())).cast("int") for t in dict.fromkeys(terms)), F.lit(0))
    by = Window.partitionBy("session_id")
    rows = messages.withColumn("hits", hits).withColumn("n", F.count("*").over(by)).withColumn("near", F.max(F.col("hits") > 0).over(by.orderBy("seq").rowsBetween(-around, around)))
    rows = rows.withColumn("kept", F.count_if("near").over(by)).withColumn("place", F.row_number().over(by.orderBy(F.desc("hits"), "seq")))
    dense = (F.col("hits") > 0) & (F.col("place") <= most)
    return rows.where((F.col("n") <= most) | F.when(F.col("kept") > most, dense).otherwise(F.col("near"))).select("session_id", "seq", "hits")


def step_terms(steps: DataFrame) -> DataFrame:
    """step_id, need, term of steps (step_id, text): one term is enough if the step names something, else two."""

    def run(batches):
        import re

        import pyarrow as pa

        for b in batches:
            rows = [(i, 1 if any(re.search(NAME, t.strip(".")) for t in own) else 2, t.strip(".")) for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for own in [relevance_terms(text or "")] for t in own]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["step_id", "need", "term"])

    return steps.select(F.col("step_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "step_id long, need int, term string").distinct()


def plan_walls(steps: DataFrame, store: Store, walls: DataFrame, met: int = MET, most: int = 3) -> DataFrame:
    """step_id, line, sessions, carriers: walls that name a term of a plan's step and were met in a session that holds enough of its terms.

    walls: session_id, line. A wall counts that so many sessions met; a term that is rare, or that few sessions hold. Terms meet
    sessions by their postings, carriers meet walls by session, and only then are lines searched; the walls of most sessions
    come first, so many a step.
    """
    terms = step_terms(steps)
    held = store.posted(terms.select(F.col("term").alias("token"))).select(F.col("token").alias("term"), "session_id").distinct()
    known = store.catalog.select(F.col("token").alias("term"), F.log((store.sessions + 1) / (F.col("sessions") + 1)).alias("idf"), "sessions")
    told = terms.join(known, "term").where((F.col("idf") >= F.when(F.col("term").rlike(NAME), NAMED).otherwise(INFORMATIVE)) | (F.col("sessions") <= 2)).select("step_id", "need", "term")
    carriers = told.join(held, "term").groupBy("step_id", "need", "session_id").agg(F.count("*").alias("n")).where("n >= need").select("step_id", "session_id")
    once = walls.select("session_id", "line").distinct()
    clusters = once.groupBy("line").agg(F.count("*").alias("sessions")).where(F.col("sessions") >= met)
    pairs = carriers.join(once, "session_id").groupBy("step_id", "line").agg(F.count("*").alias("carriers")).join(clusters, "line")
    named = F.exists("terms", lambda t: F.array_contains(F.split(F.lower("line"), r"[^\p{L}\p{Nd}_./-]+"), t))
    found = pairs.join(told.groupBy("step_id").agg(F.collect_set("term").alias("terms")), "step_id").where(named)
    place = F.row_number().over(Window.partitionBy("step_id").orderBy(F.desc("sessions"), F.desc("carriers"), "line"))
    return found.withColumn("place", place).where(F.col("place") <= most).select("step_id", "line", "sessions", "carriers")
