"""Delivery of records to peers as a stream, with a mark a peer and source that moves only after delivery."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

RECORD = "source string, ts timestamp, record bigint, project string"
MARKS = "peer string, source string, mark timestamp"
EDGE = "peer string, source string, record bigint"
SENT = "peer string, source string, ts timestamp, record bigint, batch bigint"


class Outbox:
    """What was sent to each peer, its marks, and what is held back; one folder an update.

    A record before its source's mark is settled; one at the mark is, if it was sent (those are kept, all of them, as the
    mark's edge). Records of projects held back aren't sent, wait for later batches, and pin the mark: it doesn't pass the oldest.
    Records without a time are always sent. A batch is delivered first, then its marks are written; a batch whose
    marks stand is not sent again, and one that stopped in between is delivered anew under the same number.
    """

    def __init__(self, spark: SparkSession, peers: list[str], folder: str | None = None):
        self.spark, self.peers, self.folder = spark, peers, folder or shared_dir(spark)
        self.held: Callable[[Column], Column] = lambda project: F.lit(False)

    def _read(self, what: str, batch: int, schema: str) -> DataFrame:
        if batch < 0:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{what}/{batch}")

    def _committed(self, batch: int) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/marks/{batch}/_SUCCESS")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    def push(self, records: DataFrame, batch: int) -> None:
        """Delivers a batch (and what waits), then writes its marks: the function of a stream's batches."""
        if self._committed(batch):
            return
        marks, edge = self._read("marks", batch - 1, MARKS), self._read("edge", batch - 1, EDGE)
        waiting = self._read("waiting", batch - 1, RECORD)
        columns = [F.col(c.split()[0]) for c in RECORD.split(", ")]
        rows = records.select(*columns).unionByName(waiting).distinct().withColumn("held", F.coalesce(self.held(F.col("project")), F.lit(False)))
        each = rows.select(F.explode(F.array(*map(F.lit, self.peers))).alias("peer"), "*").join(marks, ["peer", "source"], "left")
        due = each.where("NOT held AND (mark IS NULL OR ts IS NULL OR ts >= mark)")
        due = due.join(edge.withColumn("at", F.lit(True)), ["peer", "source", "record"], "left").where("at IS NULL OR ts IS NULL OR ts > mark")
        due.select("peer", "source", "ts", "record", F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{self.folder}/sent/{batch}")
        sent = self._read("sent", batch, SENT)
        rows.where("held").select(*columns).write.mode("overwrite").parquet(f"{self.folder}/waiting/{batch}")
        oldest = self._read("waiting", batch, RECORD).groupBy("source").agg(F.min("ts").alias("oldest"))
        reached = marks.unionByName(sent.select("peer", "source", F.col("ts").alias("mark"))).groupBy("peer", "source").agg(F.max("mark").alias("mark")).where("mark IS NOT NULL")
        moved = reached.join(oldest, "source", "left").select("peer", "source", F.least("mark", "oldest").alias("mark"))
        at = sent.join(moved, ["peer", "source"]).where("ts = mark").select("peer", "source", "record")
        same = edge.join(marks.join(moved, ["peer", "source", "mark"]).select("peer", "source"), ["peer", "source"], "left_semi")
        at.unionByName(same).distinct().write.mode("overwrite").parquet(f"{self.folder}/edge/{batch}")
        moved.write.mode("overwrite").parquet(f"{self.folder}/marks/{batch}")

    def deliver(self, stream: DataFrame) -> None:
        """Runs a stream of records through the outbox, up to what has arrived."""
        query = stream.writeStream.foreachBatch(self.push).option("checkpointLocation", f"{self.folder}/stream").trigger(availableNow=True).start()
        query.awaitTermination()

    def delivered(self) -> DataFrame:
        """Everything that was sent."""
        return self.spark.read.schema(SENT).option("recursiveFileLookup", "true").parquet(f"{self.folder}/sent")

    def marks(self, batch: int) -> DataFrame:
        return self._read("marks", batch, MARKS)
