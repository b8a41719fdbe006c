"""Mixing sources to target weights, with DataFrame functions only.

Sizes are counted per source, each source gets its share of the whole by weight, at most ``most`` times its own size, and
what it can't take is shared among the others. A document is then emitted floor(rate) times, and once more if a hash of
its id, its text's digest, its number among equal rows and a seed falls below the rate's fraction: runs agree, and rows that
share an id, or have none, draw numbers of their own. Equal rows are counted, not gathered, and numbered as they are given
out again, so that a row in very many copies is one row of the shuffle.

The level of that sharing has a closed form: with sources in the order of (cap / weight), level i is what is left when all
before i are full, divided by the weights from i on; the highest of these levels is the one at which none is above its cap.

Defined results: a null text has size 0 and is emitted as its source's rate says; null is a source of its own, the last;
a source without words has target 0 and isn't emitted; repeated rows, rows that share an id and rows without one
are documents of their own (which of wholly equal rows is emitted can't be told apart); of equal fill levels the smaller name comes first; a very long text is counted whole; other columns
pass through ``mix`` whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, word_count

WEIGHTS, SHARE, MOST, SEED = (5, 2, 1), 1.5, 2, 17

#: Sources up to which their targets are broadcast to the documents; beyond, both are shuffled, and hot sources split.
BROADCAST_SOURCES = 200_000
#: Equal rows that one task numbers; more are dealt out.
BLOCK_ROWS = 100_000


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """__source, __source_size, __target of sizes (__source, __size); one row a source."""
    sources = sizes.groupBy("__source").agg(F.sum("__size").alias("__source_size"))
    by_name, by_cap = Window.orderBy(F.col("__source").asc_nulls_last()), Window.orderBy("__fill", F.col("__source").asc_nulls_last())
    upto, rest, all_ = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing), by_cap.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = sources.withColumn("__weight", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1))
    w = w.withColumn("__cap", most * F.col("__source_size")).withColumn("__fill", F.col("__cap") / F.col("__weight"))
    level = (share * F.sum("__source_size").over(all_) - F.coalesce(F.sum("__cap").over(upto), F.lit(0))) / F.sum("__weight").over(rest)
    w = w.withColumn("__level", level).withColumn("__level", F.max("__level").over(all_))
    return w.select("__source", "__source_size", F.least(F.col("__cap").cast("double"), F.col("__level") * F.col("__weight")).alias("__target"))


def chance(key: Column, number: Column, seed: int = SEED) -> Column:
    """A number in [0, 1) that a row's key, its number among equal rows and the seed fix."""
    digest = F.md5(F.concat(key, F.lit(":"), number.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16**13)


def numbered(groups: DataFrame, n: str = "__n") -> DataFrame:
    """Each row as often as n says, with a __number from 0; large groups are dealt out in blocks, over all tasks."""
    whole = groups.where(F.col(n) <= BLOCK_ROWS).withColumn("__number", F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)))
    blocks = groups.where(F.col(n) > BLOCK_ROWS).withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / BLOCK_ROWS))))
    first = F.col("__block") * BLOCK_ROWS
    dealt = blocks.repartition("__block").withColumn("__number", F.explode(F.sequence(first, F.least(first + BLOCK_ROWS, F.col(n)) - 1))).drop("__block")
    return whole.unionByName(dealt)


def planned(docs: DataFrame, sizes: DataFrame, seed: int = SEED, **how) -> DataFrame:
    """docs (with __key and __number) with each row's __source_size, __target and __copies."""
    goals = stored(targets(sizes, **how).withColumnRenamed("__source", "__of"))
    if goals.count() <= BROADCAST_SOURCES:
        goals = F.broadcast(goals)
    joined = docs.join(goals, F.col("__source").eqNullSafe(F.col("__of"))).drop("__of")
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(0.0)
    extra = (chance(F.col("__key"), F.col("__number"), seed) < rate - F.floor(rate)).cast("int")
    return joined.withColumn("__copies", (F.floor(rate) + extra).cast("int"))


def _sized(docs: DataFrame, doc_id: str, source: str, text: str, *more: Column) -> DataFrame:
    key = F.concat_ws(":", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.coalesce(F.md5(F.col(text).cast("binary")), F.lit("null")))
    return docs.select(*more, F.col(doc_id).alias("__id"), F.col(source).alias("__source"), word_count(text).cast("long").alias("__size"), key.alias("__key"))


def _groups(sized: DataFrame) -> DataFrame:
    """Rows equal in id, source and text, as one row with their number __n."""
    return sized.groupBy("__id", "__source", "__size", "__key").agg(F.count("*").alias("__n"))


def _weighed(groups: DataFrame) -> DataFrame:
    return groups.select("__source", (F.col("__size") * F.col("__n")).alias("__size"))


def mix(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """The mixed documents, with all their columns whatever their names, each as often as its source's rate and its hash say.

    Among rows equal in id, source and text the digest of all their columns goes into the hash, and of wholly equal rows the number.
    """
    sized = _sized(docs, doc_id, source, text, F.struct("*").alias("__row"))
    groups = stored(_groups(_sized(docs, doc_id, source, text)))
    again = stored(groups.where("__n > 1").select(F.col("__source").alias("__of"), F.col("__key").alias("__again")).distinct())
    if again.isEmpty():
        rows = sized.withColumn("__number", F.lit(0).cast("long"))
    else:
        twice = F.col("__key") == F.col("__again")
        same = twice & F.col("__source").eqNullSafe(F.col("__of"))
        once = sized.join(again, same, "left_anti").withColumn("__number", F.lit(0).cast("long"))
        own = F.concat_ws(":", "__key", F.md5(F.to_json("__row").cast("binary")))
        repeated = sized.join(again, same, "left_semi").withColumn("__key", own)
        repeated = repeated.groupBy("__id", "__source", "__size", "__key").agg(F.count("*").alias("__n"), F.any_value("__row").alias("__row"))
        rows = once.unionByName(numbered(repeated).drop("__n"))
    out = planned(rows, _weighed(groups), **how)
    return out.select("__row", F.explode(F.expr("array_repeat(0, __copies)"))).select("__row.*")


def taken(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", **how) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, taken."""
    groups = stored(_groups(_sized(docs, doc_id, source, text)))
    out = planned(numbered(groups), _weighed(groups), **how)
    return out.select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), (F.col("__size") * F.col("__copies")).alias("taken"))
