"""An archive on disk and what can be asked of it: messages, sessions and postings as Parquet tables, read by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.language import friction, is_plumbing, unwrapped
from .functions.query import path_forms, query_parts
from .functions.redact import redacted, safe
from .functions.scalars import snippet, trimmed
from .operators import history, ladder, mining, search, served
from .sources.agents import archive as parsed


class Archive:
    """Tables under one folder: messages (session_id, seq, role, text, ts), sessions, postings."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def build(cls, spark: SparkSession, lines: DataFrame, path: str) -> Archive:
        """Transcripts (path, n, value) parsed, freed of injected blocks and secrets, each message once, and indexed."""
        own = cls(spark, path)
        rows = parsed(lines).withColumn("text", unwrapped(F.col("text"))).where("text != ''")
        rows = redacted(rows).withColumn("found", F.aggregate(F.map_values("__kinds"), F.lit(0), lambda a, b: a + b)).drop("__kinds")
        once = rows.groupBy("harness", "session_id", "role", "ts", "text").agg(F.min("seq").alias("seq"), F.max("project").alias("project"), F.max("title").alias("title"), F.max("found").alias("found"))
        once = once.withColumn("session_id", F.concat_ws(":", "harness", "session_id"))
        once.write.mode("errorifexists").parquet(f"{path}/messages")
        own.messages().groupBy("session_id", "harness", "project").agg(F.min("ts").alias("started"), F.max("ts").alias("updated"), F.count("*").alias("messages"), F.sum("found").alias("redacted"), F.coalesce(F.max("title"), F.min_by(trimmed(F.regexp_replace("text", r"\s+", " "), 60), F.when((F.col("role") == "user") & ~is_plumbing(F.col("text")), F.col("seq")))).alias("title")).write.parquet(f"{path}/sessions")
        ladder.write_postings(own.messages(), f"{path}/postings")
        return own

    def messages(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/messages")

    def sessions(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/sessions")

    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings").select("token", "session_id", "seq")

    def search(self, query: str, limit: int = 15, offset: int = 0, **which) -> DataFrame:
        """A page of the first tier that finds anything, by BM25, with a snippet of each session."""
        found = ladder.ladder(self.postings(), query).join(served.matching_sessions(self.sessions(), **which).select("session_id"), "session_id", "left_semi")
        terms = query_parts(query)[0]
        texts = self.messages().join(found.select("session_id"), "session_id", "left_semi").where(~F.col("role").isin(*served.WORK))
        scores = search.bm25(texts, terms, "session_id", is_user=F.col("role") == "user")
        ranked = found.join(scores, "session_id", "left").select("session_id", "tier", F.coalesce("score", F.lit(0.0)).alias("score"))
        head = served.page(ranked, "session_id", limit, offset)
        first = texts.join(F.broadcast(head.select("session_id")), "session_id").groupBy("session_id").agg(F.max_by("text", F.struct(sum(((F.instr(F.lower("text"), t) > 0).cast("int") for t in terms), F.lit(0)), -F.col("seq"))).alias("text"))
        return head.join(first, "session_id", "left").withColumn("snippet", snippet(F.col("text"), query)).drop("text")

    def last(self, n: int = 10) -> DataFrame:
        """The sessions updated last."""
        return self.sessions().orderBy(F.desc("updated"), "session_id").limit(n)

    def show(self, session: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """Turns of a session, made safe to display; at most 200."""
        rows = self.messages().where(F.col("session_id") == session).orderBy("seq").offset(offset).limit(min(limit, 200))
        return rows.select("seq", "role", safe(F.col("text")).alias("text"), "ts")

    def how(self, *terms: str) -> DataFrame:
        """The commands that hold all terms."""
        runs = self.messages().where("role = 'command'").select("session_id", "ts", F.col("text").alias("command"))
        return history.how(runs, list(terms))

    def blame(self, path: str) -> DataFrame:
        """The sessions that speak of a file."""
        return served.blame(self.messages(), self.sessions().select("session_id", "project", "updated"), path, path_forms(path), F.current_timestamp())

    def fix(self, pasted: str) -> DataFrame:
        """What ended an error."""
        return mining.fixes_for(mining.mined_fixes(self.messages()), pasted)

    def error_hits(self, pasted: str, most: int = 10) -> DataFrame:
        """The sessions that met any of the errors that a pasted text holds, newest first, with their first lines that do."""
        lines = self.spark.createDataFrame([(x,) for x in pasted.split("\n")], "line string").select(friction(F.col("line")).alias("line")).where("line is not null").distinct()
        met = self.messages().where("role in ('tool-output', 'assistant')").select("session_id", "seq", "ts", F.explode(F.split("text", "\n")).alias("raw")).withColumn("line", friction(F.col("raw")))
        hits = met.join(F.broadcast(lines), "line").groupBy("session_id").agg(F.max("ts").alias("updated"), F.min_by("line", "seq").alias("line"))
        return hits.orderBy(F.desc("updated"), "session_id").limit(most)

    def overview(self) -> DataFrame:
        """Sessions, messages, redactions and last time of each harness."""
        return self.sessions().groupBy("harness").agg(F.count("*").alias("sessions"), F.sum("messages").alias("messages"), F.sum("redacted").alias("redacted"), F.max("updated").alias("newest"))

    def share(self, session: str, budget: int = 8000) -> DataFrame:
        """A session as one document: what was asked and concluded, within a budget of bytes."""
        rows = self.messages().where(F.col("session_id") == session).where("role in ('user', 'assistant')")
        parts = F.array_sort(F.collect_list(F.struct("seq", F.concat(F.lit("## "), "role", F.lit("\n\n"), safe(F.col("text"))).alias("part"))))
        return rows.groupBy("session_id").agg(F.left(F.array_join(F.transform(parts, lambda p: p["part"]), "\n\n"), F.lit(budget)).alias("document"))

    def forget(self, selectors: DataFrame, path: str) -> Archive:
        """The archive without the sessions that selectors (kind, value) name, in another folder; the old one stays until it is dropped."""
        gone = served.forgotten(self.sessions(), selectors)
        for name in ("messages", "sessions", "postings"):
            rows = self.spark.read.parquet(f"{self.path}/{name}").join(gone, "session_id", "left_anti")
            (rows.write.partitionBy("bucket") if name == "postings" else rows.write).parquet(f"{path}/{name}")
        return Archive(self.spark, path)
