"""Hard negatives by bit-sliced integer products, the most significant planes first.

Components become integers, and each block of rows is taken apart into the bit planes of its two's complements. A score is
the sum over planes of the plane's weight times the anchor's product with it; what the planes not yet seen can add lies
between (2**b - 1) times the sums of the anchor's negative and positive components. With each plane the interval of a
score narrows, and a candidate is dropped as soon as its interval meets none of the anchor's windows: a window reaches from
what is asked for, or the worst of the first k found so far, to the most that is asked for. While many candidates are left,
a plane is multiplied with all of them at once, later only with those that are left. What is left after the last plane has
its exact score.

Anchors go in blocks of ``ANCHOR_BLOCK`` at most, each block against all rows: a first pass finds each anchor's positives,
which give the windows of a second one for the negatives. A block is what is broadcast, so its size is bounded; every task
keeps the first k of its own rows for each window, and only these are shuffled.

Defined results: rows with a null label or vector, an empty vector, a null or a value that isn't finite take no part; nor
do those of another dimension than most have, or with a component of 2**26 or more after scaling, whose products don't fit
64 bits; zero vectors do. Rows that repeat an id, or all of a row, are rows of their own: each is an anchor with its own
positives and a candidate for the others. A null id belongs to a candidate that comes after others of its score, never to an
anchor. An anchor without other rows of its label gives no rows; ties go to the smaller id; other columns aren't read; an
empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir
from .common import frugal, stored

#: Anchors that meet the rows at once; rows of a block; anchors of a block; rows of a task, about.
ANCHOR_BLOCK, ROWS, ANCHORS, TASK_ROWS = 4096, 2048, 256, 8192
SCALE, POSITIVES, NEGATIVES, LOW_PERCENT, HIGH_PERCENT = 256, 5, 10, 30, 90
#: Scaled components lie below this size.
MOST = 1 << 26
_NO_ID = (1 << 63) - 1
_FOUND = "anchor int, window int, id long, row long, score long"


def whole(vector: list) -> np.ndarray | None:
    """The scaled integers of a vector that takes part, else nothing."""
    if not vector or None in vector:
        return None
    x = np.array(vector, np.float64)
    if not np.isfinite(x).all():
        return None
    x = np.floor(SCALE * x)
    return x.astype(np.int64) if (np.abs(x) < MOST).all() else None


def _prepared(vectors: DataFrame, vec_id: str, vector: str, label: Column) -> DataFrame:
    """row, id, label, v (little-endian 32-bit integers) of the rows that take part."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            own = [whole(v) for v in b.column(1).to_pylist()]
            at = pa.array([i for i, v in enumerate(own) if v is not None], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array([v.astype("<i4").tobytes() for v in own if v is not None], pa.binary())], names=["id", "label", "v"])

    columns = F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v"), label.cast("long").alias("label")
    rows = vectors.select(*columns).where("label IS NOT NULL AND v IS NOT NULL").mapInArrow(frugal(run), "id long, label long, v binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()))
    size = rows.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    return rows.where(F.length("v") == (size[0]["size"] if size else 0))


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), "<i4").reshape(len(values), -1).astype(np.int64)


class Anchors:
    """A block of anchors with their windows, and the first k found for each window."""

    def __init__(self, v: np.ndarray, row: np.ndarray, label: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool):
        self.v, self.row, self.label, self.high, self.k, self.same = v, row, label, high, k, same
        self.least = np.where(low <= high, low, np.iinfo(np.int64).max)  # what still qualifies: grows as better ones are found
        self.first = [np.zeros(0, np.int64) for _ in range(5)]  # anchor, window, score, id, row

    def left(self, v: np.ndarray, part: slice, may: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Anchors, rows and exact scores of the candidates that some window of theirs still takes."""
        a = self.v[part]
        top = max(1, int(np.abs(v).max(initial=0)).bit_length())
        exact = np.float64 if a.shape[1] * int(np.abs(a).max(initial=1)) << top + 1 < 1 << 53 else np.int64
        below, above = np.minimum(a, 0).sum(axis=1), np.maximum(a, 0).sum(axis=1)
        least, most = self.least[part], self.high[part]
        feasible = least <= most
        lowest = np.where(feasible, least, np.iinfo(np.int64).max).min(axis=1)
        highest = np.where(feasible, most, np.iinfo(np.int64).min).max(axis=1)
        may &= feasible.any(axis=1)[:, None]
        a, score = a.astype(exact), np.zeros(may.shape, exact)
        plane = top
        while plane >= 0 and 8 * np.count_nonzero(may) > may.size:
            bit = ((v >> plane) & 1).astype(exact)
            score += (a @ bit.T) * exact(-(1 << plane) if plane == top else 1 << plane)
            rest = (1 << plane) - 1
            may &= (score + exact(rest) * above[:, None].astype(exact) >= lowest[:, None]) & (score + exact(rest) * below[:, None].astype(exact) <= highest[:, None])
            plane -= 1
        i, r = np.nonzero(may)
        s = score[i, r].astype(np.int64)
        a = self.v[part]
        while plane >= 0 and len(i):
            bit = (v >> plane) & 1
            s += np.einsum("ij,ij->i", a[i], bit[r]) * (-(1 << plane) if plane == top else 1 << plane)
            rest = (1 << plane) - 1
            low, high = s + rest * below[i], s + rest * above[i]
            keep = ((high[:, None] >= least[i]) & (low[:, None] <= most[i])).any(axis=1)
            i, r, s = i[keep], r[keep], s[keep]
            plane -= 1
        return i, r, s

    def take(self, v: np.ndarray, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray) -> None:
        """Holds a block of rows against all anchors."""
        for at in range(0, len(self.v), ANCHORS):
            part = slice(at, at + ANCHORS)
            alike = self.label[part, None] == labels[None, :]
            i, r, s = self.left(v, part, (alike if self.same else ~alike) & (self.row[part, None] != rows[None, :]))
            pair, window = np.nonzero((s[:, None] >= self.least[part][i]) & (s[:, None] <= self.high[part][i]))
            if not len(pair):
                continue
            i, r, s = i[pair], r[pair], s[pair]
            own = self.first[0] // ANCHORS == at // ANCHORS
            new = [np.concatenate([f[own], n]) for f, n in zip(self.first, (i + at, window, s, ids[r], rows[r]), strict=True)]
            order = np.lexsort((new[4], new[3], -new[2], new[1], new[0]))
            new = [n[order] for n in new]
            group = new[0] * self.high.shape[1] + new[1]
            place = np.arange(len(group)) - np.searchsorted(group, group, "left")
            last = place == self.k - 1
            self.least[new[0][last], new[1][last]] = new[2][last]
            self.first = [np.concatenate([f[~own], n[place < self.k]]) for f, n in zip(self.first, new, strict=True)]


def _first(rows: DataFrame, block: list, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """anchor (its place in the block), window, id, row, score of the first k rows for each window of the block's anchors."""
    held = rows.sparkSession.sparkContext.broadcast((_matrix([r["v"] for r in block]), *(np.array([r[c] for r in block], np.int64) for c in ("row", "label")), low, high))

    def run(batches):
        import pyarrow as pa

        anchors = Anchors(*held.value, k, same)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                ids, own, labels = (part.column(c).to_numpy() for c in (0, 1, 2))
                anchors.take(_matrix(part.column(3).to_pylist()), ids, own, labels)
        anchor, window, score, ids, own = anchors.first
        yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int32()), pa.array(window, pa.int32()), pa.array(ids), pa.array(own), pa.array(score)], names=["anchor", "window", "id", "row", "score"])

    found = rows.select(F.coalesce("id", F.lit(_NO_ID)).alias("id"), "row", "label", "v").mapInArrow(frugal(run), _FOUND)
    rank = F.row_number().over(Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(vectors: DataFrame, is_anchor, label: Column | None = None, positives: int = POSITIVES, k: int = NEGATIVES, low: int = LOW_PERCENT, high: int = HIGH_PERCENT, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of the rows whose id meets is_anchor (a function of a column).

    Positives are the first rows of the anchor's label, negatives the first of other labels whose scores lie between low and
    high percent of the positive's.
    """
    spark, ids = vectors.sparkSession, F.when(F.col("id") != _NO_ID, F.col("id"))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = _prepared(vectors, vec_id, vector, F.col("label") if label is None else label)
    anchors = stored(rows.where(is_anchor(F.col("id"))))
    n, n_anchors, path = rows.count(), anchors.count(), shared_dir(spark)
    tasks = min(n // TASK_ROWS, 4 * spark.sparkContext.defaultParallelism)
    spread = rows.repartition(tasks, "row") if tasks > 1 else rows
    blocks = -(-n_anchors // ANCHOR_BLOCK)
    spark.createDataFrame([], schema).write.parquet(path)
    for b in range(blocks):
        block = anchors.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b).orderBy("row").collect()  # about an equal part each
        if not block:
            continue
        none = np.full((len(block), 1), np.iinfo(np.int64).min), np.full((len(block), 1), np.iinfo(np.int64).max)
        found = _first(spread, block, *none, positives, True).collect()  # at most ANCHOR_BLOCK * positives, about
        lows, highs = np.ones((len(block), positives), np.int64), np.zeros((len(block), positives), np.int64)
        pairs = []
        for r in found:
            a, w, s = r["anchor"], r["rank"] - 1, r["score"]
            lows[a, w], highs[a, w] = -(-low * s // 100), high * s // 100
            pairs.append((a, w, block[a]["id"], None if r["id"] == _NO_ID else r["id"], s))
        of = spark.createDataFrame(pairs, "anchor int, window int, anchor_id long, positive_id long, positive_score long")
        negatives = _first(spread, block, lows, highs, k, False).join(F.broadcast(of), ["anchor", "window"])
        out = negatives.select("anchor_id", "positive_id", F.col("rank").cast("int"), ids.alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        out.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)
