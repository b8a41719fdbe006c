"""Postings that grow with the files they come from: only the buckets that a change touches are written again.

Postings carry the path of their file and lie in generations: a folder a generation, in it one a bucket. A table of the
generations that are live in each bucket is written last, under the generation's number: with it an update counts, without it
nothing has changed. Rows of grown files are added to their buckets as another generation; buckets that hold rows of changed
or removed files are written anew without them, with what the files now hold; all others are left alone. A bucket with
``MOST`` generations is written anew as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ladder import BUCKETS, SLICES, _bucket, indexed

MOST = 8


class Postings:
    """token, path, session_id, seq of an archive's messages, kept up to date under a folder."""

    def __init__(self, spark: SparkSession, folder: str, session_type: str = "bigint"):
        self.spark, self.folder = spark, folder
        self.schema = f"token string, path string, session_id {session_type}, seq bigint"

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def live(self, generation: int) -> dict[int, list[int]]:
        """The live generations of each bucket as of an update, a few a bucket; none before the first one."""
        if generation < 0:
            return {}
        rows = self.spark.read.schema("bucket int, generations array<int>").parquet(f"{self.folder}/live/{generation}").collect()
        return {r["bucket"]: list(r["generations"]) for r in rows}

    def newest(self) -> int:
        """The last update that counts, -1 if there is none."""
        n = -1
        while self._exists(f"{self.folder}/live/{n + 1}/_SUCCESS"):
            n += 1
        return n

    def _of(self, live: dict[int, list[int]], buckets: list[int]) -> DataFrame:
        paths = [f"{self.folder}/rows/{g}/bucket={b}" for b in buckets for g in live.get(b, ())]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def read(self, tokens: list[str] | None = None) -> DataFrame:
        """All postings, or those of some tokens, from their buckets alone."""
        live = self.live(self.newest())
        if tokens is None:
            return self._of(live, sorted(live))
        wanted = [r[0] for r in self.spark.createDataFrame([(t,) for t in tokens], "t string").select(_bucket(F.col("t")).cast("int")).distinct().collect()]
        return self._of(live, sorted(wanted)).where(F.col("token").isin(tokens))

    def update(self, fresh: DataFrame, changes: DataFrame) -> tuple[list[int], list[int]]:
        """Takes in fresh messages (path, session_id, seq, text, ts), after changes (path, what: new, grown, changed or gone).

        Fresh holds the new messages of grown files and all of new and changed ones. Gives the buckets written anew and added to.
        """
        number = self.newest() + 1
        live = self.live(number - 1)
        rows = indexed(fresh.withColumn("session_id", F.struct("path", "session_id"))).select("token", "session_id.path", "session_id.session_id", "seq", _bucket(F.col("token")).cast("int").alias("bucket"))
        rows.write.parquet(f"{self.folder}/fresh/{number}")
        new = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/fresh/{number}")
        added = {r[0] for r in new.select("bucket").distinct().collect()}  # one a bucket at most
        old = changes.where("what IN ('changed', 'gone')").select("path").distinct()
        held = self._of(live, sorted(live))
        touched = {r[0] for r in held.join(old, "path", "left_semi").select(_bucket(F.col("token")).cast("int").alias("b")).distinct().collect()}
        touched |= {b for b in added if len(live.get(b, ())) >= MOST}
        kept = self._of(live, sorted(touched)).join(old, "path", "left_anti")
        # rows move once: dealt by slices of the buckets, equal ones meet where they are; a task writes few buckets
        slices = kept.unionByName(new.drop("bucket")).withColumn("slice", F.pmod(F.xxhash64("token"), F.lit(BUCKETS * SLICES)).cast("int"))
        out = slices.repartition("slice").distinct().withColumn("bucket", F.col("slice") % BUCKETS).drop("slice").sortWithinPartitions("bucket", "token", "path", "session_id", "seq")
        out.write.partitionBy("bucket").mode("overwrite").parquet(f"{self.folder}/rows/{number}")
        written = {r[0] for r in self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.folder}/rows/{number}").select("bucket").distinct().collect()}
        now = {b: [*([] if b in touched else g), *([number] if b in written else [])] for b, g in {**{b: [] for b in written}, **live}.items()}
        table = self.spark.createDataFrame([(b, g) for b, g in sorted(now.items()) if g], "bucket int, generations array<int>")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/live/{number}")
        return sorted(touched), sorted(added - touched)


def rebuilt(messages: DataFrame) -> DataFrame:
    """The postings of all messages, as one update of an empty folder gives them."""
    rows = indexed(messages.withColumn("session_id", F.struct("path", "session_id")))
    return rows.select("token", "session_id.path", "session_id.session_id", "seq").distinct()
