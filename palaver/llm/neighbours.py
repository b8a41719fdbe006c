"""Nearest neighbours by inner product: a forest of random-projection trees, one shared priority queue, exact reranking.

Vectors get one more component, sqrt(M * M - |x| * |x|) with M the largest length, and queries a zero there; the largest
inner product is then the smallest angle. Trees are fitted on a bounded sample: each node splits its part of the sample at
the median along the line between two of its members. Every vector is put into one leaf of each tree. For a query one heap
holds nodes of all trees by their least margin on the way from the root: the first node is taken out, its margin is computed
and its children are put in, until so many leaves have come out; queries meet leaves in a co-grouped join, and the exact
inner products decide. How many leaves, and at which depth trees are cut into leaves, is settled by ``TRY_QUERIES`` sampled
queries, held against every vector in blocks: the deepest level at which ``MOST_VISITS`` leaves hold the share ``FOUND`` of
their nearest. Vectors in clusters take small leaves; for vectors without any structure no index helps, leaves are large and
most vectors are scored, since the results must be found all the same.

Of equal vectors only the 21 smallest ids can be among anyone's 20 nearest, so the others are left out before the search. A
leaf that more than ``MEET_ROWS`` vectors or queries reach is dealt into parts of both, and each pair of parts meets in a
group of its own.

Defined results: vectors that are null, empty, zero or hold a null or a value that isn't finite take no part; nor do those
of another dimension than most have; a query with fewer than ``k`` candidates gets all of them; ties, by the very score that
is returned, go to the smaller id; rows that repeat id and vector are one, rows that repeat an id with other vectors are
candidates and queries each under that id, and the best score of a pair of ids counts; other columns aren't read; an empty
table gives an empty one.
"""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, stored

#: Vectors of the sample that trees are fitted on, at most; trees; vectors of a leaf, at least; leaves opened for a query, at least.
FIT_ROWS, TREES, LEAF_ROWS, VISITS, SEED = 65_536, 8, 64, 16, 23
#: Queries on which depth and number of opened leaves are settled, the share of their nearest that these must find, and the leaves that a query opens at most.
TRY_QUERIES, FOUND, MOST_VISITS = 128, 0.95, 64
#: Vectors, and queries, of a leaf that one group may hold.
MEET_ROWS = 16_384


class Forest:
    """Complete binary trees of equal depth, by heap position."""

    def __init__(self, sample: np.ndarray, leaves: int, trees: int = TREES, seed: int = SEED):
        self.depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
        self.full = self.depth
        inner, dim = (1 << self.depth) - 1, sample.shape[1]
        self.normal = np.zeros((trees, inner, dim))
        self.cut = np.zeros((trees, inner))
        rng = np.random.default_rng(seed)
        for t in range(trees):
            parts = {0: np.arange(len(sample))}
            for node in range(inner):
                own = parts.pop(node, np.zeros(0, np.int64))
                if len(own) >= 2:
                    a, b = sample[rng.choice(own, 2, replace=False)]
                    normal = a - b if (a != b).any() else rng.standard_normal(dim)
                else:
                    normal = rng.standard_normal(dim)
                normal = normal / np.linalg.norm(normal)
                along = sample[own] @ normal
                self.normal[t, node], self.cut[t, node] = normal, np.median(along) if len(own) else 0.0
                parts[2 * node + 1], parts[2 * node + 2] = own[along < self.cut[t, node]], own[along >= self.cut[t, node]]

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered across trees."""
        out = np.zeros((len(vectors), len(self.normal)), np.int64)
        for t in range(len(self.normal)):
            node = np.zeros(len(vectors), np.int64)
            for _ in range(self.depth):
                margin = np.einsum("ij,ij->i", vectors, self.normal[t][node]) - self.cut[t][node]
                node = 2 * node + 1 + (margin >= 0)
            out[:, t] = (t << self.depth) + node - ((1 << self.depth) - 1)
        return out

    def cut_at(self, depth: int) -> Forest:
        """The same trees, with the nodes at this depth as leaves."""
        self.depth = depth
        return self

    def waits(self, queries: np.ndarray) -> np.ndarray:
        """The place of each leaf in the one queue of each query, the higher, the sooner; for a few queries."""
        all_ = []
        for t in range(len(self.normal)):
            own = slice(0, (1 << self.depth) - 1)
            margins = queries @ self.normal[t, own].T - self.cut[t, own]
            wait = np.full((len(queries), 1), np.inf)
            for level in range(self.depth):
                own = margins[:, (1 << level) - 1 : (2 << level) - 1]
                wait = np.stack([np.minimum(wait, -own), np.minimum(wait, own)], axis=2).reshape(len(queries), -1)
            all_.append(wait)
        return np.concatenate(all_, axis=1)

    def nearest_leaves(self, query: np.ndarray, visits: int) -> list[int]:
        """The first leaves that come out of one heap over the nodes of all trees."""
        heap, out, inner = [(-np.inf, t, 0) for t in range(len(self.normal))], [], (1 << self.depth) - 1
        while heap and len(out) < visits:
            wait, t, node = heappop(heap)
            if node >= inner:
                out.append((t << self.depth) + node - inner)
                continue
            margin = float(self.normal[t, node] @ query) - float(self.cut[t, node])
            heappush(heap, (max(wait, margin), t, 2 * node + 1))
            heappush(heap, (max(wait, -margin), t, 2 * node + 2))
        return out


def _prepared(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """id, v (little-endian doubles), length of the vectors that take part."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, values, lengths = [], [], []
            for key, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if key is None or not v or None in v:
                    continue
                x = np.array(v, np.float64)
                if np.isfinite(x).all() and x.any():
                    keys.append(key)
                    values.append(x.astype("<f8").tobytes())
                    lengths.append(float(np.sqrt((x * x).sum())))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.binary()), pa.array(lengths, pa.float64())], names=["id", "v", "length"])

    return vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).alias("v")).mapInArrow(run, "id long, v binary, length double")


def _matrix(values) -> np.ndarray:
    values = list(values)
    return np.frombuffer(b"".join(values), "<f8").reshape(len(values), -1) if values else np.zeros((0, 1))


def _wider(x: np.ndarray, most: float | None) -> np.ndarray:
    extra = np.zeros(len(x)) if most is None else np.sqrt(np.maximum(most * most - (x * x).sum(axis=1), 0.0))
    return np.column_stack([x, extra])


def _exact(index: DataFrame, ids: list[int], values: list[bytes], k: int) -> DataFrame:
    """query_id, v: the k nearest vectors of a few queries, from all vectors in blocks."""

    def run(batches):
        import pyarrow as pa

        own, q = np.array(ids, np.int64), _matrix(values)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                score = q @ _matrix(part.column(1).to_pylist()).T
                score[own[:, None] == part.column(0).to_numpy()[None, :]] = -np.inf
                best = np.argsort(-score, axis=1)[:, :k]
                r, c = np.repeat(np.arange(len(own)), best.shape[1]), best.ravel()
                r, c = r[np.isfinite(score[r, c])], c[np.isfinite(score[r, c])]
                yield pa.RecordBatch.from_arrays([pa.array(own[r]), part.column(1).take(pa.array(c)), pa.array(score[r, c])], names=["query_id", "v", "score"])

    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score")))
    return index.select("id", "v").mapInArrow(run, "query_id long, v binary, score double").withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "v")


def settled(forest: Forest, most: float, index: DataFrame, asking: DataFrame, k: int, least: int) -> int:
    """Cuts the trees at the deepest level at which ``MOST_VISITS`` leaves are enough for the sampled queries; gives how many are.

    So the leaves opened for a query, and what they give back, don't grow with the table; how large they are follows from how
    much structure the vectors have. At most TRY_QUERIES * k vectors are collected.
    """
    tried = asking.orderBy(F.xxhash64("id"), "id").limit(TRY_QUERIES).collect()
    near = _exact(index, [r["id"] for r in tried], [r["v"] for r in tried], k).collect() if tried else []
    if not near:
        return least
    row = {r["id"]: i for i, r in enumerate(tried)}
    of = np.array([row[r["query_id"]] for r in near])
    queries, found = _wider(_matrix(r["v"] for r in tried), None), _wider(_matrix(r["v"] for r in near), most)
    for depth in range(forest.full, -1, -1):
        visits = needed(forest.cut_at(depth), queries, found, of, least)
        if visits <= MOST_VISITS:
            break
    return visits


def needed(forest: Forest, queries: np.ndarray, found: np.ndarray, of: np.ndarray, least: int) -> int:
    """How many leaves, so many at least, let the queries find the share FOUND of vectors found for them (of: for which)."""
    order = np.argsort(-forest.waits(queries), axis=1, kind="stable")
    turn = np.empty_like(order)
    np.put_along_axis(turn, order, np.arange(1, order.shape[1] + 1)[None, :], axis=1)
    first = turn[of[:, None], forest.leaves_of(found)].min(axis=1)
    return min(order.shape[1], max(least, int(np.quantile(first, FOUND, method="higher"))))


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", visits: int = VISITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: of each vector whose id meets is_query (a function of a column) its k nearest found."""
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = stored(_prepared(vectors, vec_id, vector).distinct())
    size = rows.groupBy(F.length("v").alias("size")).count().orderBy(F.desc("count"), "size").limit(1).collect()
    if not size:
        return spark.createDataFrame([], schema)
    rows = rows.where(F.length("v") == size[0]["size"])
    # of equal vectors the k + 1 smallest ids; the limit is applied before the shuffle as well
    same = Window.partitionBy("v").orderBy("id")
    index = stored(rows.withColumn("__n", F.row_number().over(same)).where(F.col("__n") <= k + 1).select("id", "v", "length"))
    n, most = index.agg(F.count("*"), F.max("length")).first()
    sample = _matrix(r.v for r in index.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").collect())
    asking, index = rows.where(is_query(F.col("id"))).select("id", "v"), index.select("id", "v")
    trees = Forest(_wider(sample, most), min(-(-n // leaf_rows), FIT_ROWS // 8))  # at most FIT_ROWS / 8 nodes a tree
    visits = settled(trees, most, index, asking, k, visits)
    forest = spark.sparkContext.broadcast(trees)

    def to_leaves(queries: bool, parts=None):
        def run(batches):
            import pyarrow as pa

            for b in batches:
                for at in range(0, b.num_rows, 512):
                    part = b.slice(at, 512)
                    x = _matrix(part.column(1).to_pylist())
                    leaves = np.array([forest.value.nearest_leaves(q, visits) for q in _wider(x, None)]) if queries else forest.value.leaves_of(_wider(x, most))
                    width = leaves.shape[1]
                    leaf, which = leaves.ravel(), np.repeat(np.arange(part.num_rows), width)
                    if parts is None:
                        yield pa.RecordBatch.from_arrays([pa.array(leaf)], names=["leaf"])
                        continue
                    mine, other = parts.value if queries else parts.value[::-1]
                    own = (mix64(part.column(0).to_numpy().view(np.uint64))[which] % mine[leaf].astype(np.uint64)).astype(np.int64)
                    row = np.repeat(np.arange(len(leaf)), other[leaf])
                    each = np.arange(len(row)) - np.repeat(np.cumsum(other[leaf]) - other[leaf], other[leaf])
                    leaf, which, own = leaf[row], pa.array(which[row]), own[row]
                    pair = own * other[leaf] + each if queries else each * mine[leaf] + own
                    yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array(pair), part.column(0).take(which), part.column(1).take(which)], names=["leaf", "pair", "id", "v"])

        return run

    def rerank(queries, members):
        import pandas as pd

        members = members.sort_values("id")
        ids, x, own = members["id"].to_numpy(), _matrix(members["v"]), queries["id"].to_numpy()
        if not len(ids) or not len(own):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        out, q = [], _matrix(queries["v"])
        most_ = np.sqrt((x * x).sum(axis=1).max())
        for at in range(0, len(own), 256):
            part = q[at : at + 256]
            score = part @ x.T
            score[own[at : at + 256, None] == ids[None, :]] = -np.inf
            # all that may be among the first k by the sum that is returned, whose rounding differs
            least = np.partition(score, -k, axis=1)[:, -k] if score.shape[1] > k else np.full(len(part), -np.inf)
            slack = 1e-12 * most_ * np.sqrt((part * part).sum(axis=1))
            r, c = np.nonzero((score >= (least - slack)[:, None]) & np.isfinite(score))
            sums = (part[r] * x[c]).sum(axis=1)
            order = np.lexsort((ids[c], -sums, r))
            r, c, sums = r[order], c[order], sums[order]
            first = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
            out.append((at + r[first], c[first], sums[first]))
        r, c, sums = (np.concatenate(z) for z in zip(*out, strict=True))
        return pd.DataFrame({"query_id": own[r], "vec_id": ids[c], "score": sums})

    def dealt(df: DataFrame, queries: bool) -> np.ndarray:
        """The number of parts of each leaf; there are at most TREES * FIT_ROWS / 8 leaves."""
        n = np.ones(len(forest.value.normal) << forest.value.depth, np.int64)
        for r in df.mapInArrow(to_leaves(queries), "leaf long").groupBy("leaf").count().collect():
            n[r["leaf"]] = -(-r["count"] // MEET_ROWS)
        return n

    parts = spark.sparkContext.broadcast((dealt(asking, True), dealt(index, False)))
    asked = asking.mapInArrow(to_leaves(True, parts), "leaf long, pair long, id long, v binary")
    members = index.mapInArrow(to_leaves(False, parts), "leaf long, pair long, id long, v binary")
    found = asked.groupBy("leaf", "pair").cogroup(members.groupBy("leaf", "pair")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
