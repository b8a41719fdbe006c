"""Connected components by large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Each node's neighbours (larger ones in a large star, smaller ones and itself in a small one) point to its least neighbour.

    The least neighbour is a partial aggregate, and the join back is one that Spark splits where a node has very many neighbours.
    """
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    to = edges.join(least, "a")
    return to.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).where("a != b").distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    again = edges.groupBy("a").count().where("count > 1").limit(1).count()
    return not again and not edges.join(edges.select(F.col("a").alias("b")), "b", "left_semi").limit(1).count()


def components(edges: DataFrame) -> DataFrame:
    """a, b: each node of the edges (a, b) but the least of its component, with that least node. Empty for no edges."""
    edges = stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _is_forest_of_stars(edges):
        edges = stored(_star(stored(_star(edges, True)), False))
    return edges
