"""Places in an order, without putting all rows of a table, or of a group, into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import kept


def placed(rows: DataFrame, order: list[Column], by: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """The rows with their place, from 1, in the order within each group of the columns by.

    Rows are dealt into ranges of group and order, numbered within each range, and moved by the rows of the group in the ranges
    before: these are counts, one for each range and group in it. Ties must be broken by the order.
    """
    dealt = kept(rows.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("__part", F.spark_partition_id()))
    count = dealt.groupBy("__part", *by).agg(F.count("*").alias("__n"))
    upto = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    moved = count.select("__part", *(F.col(c).alias(f"__{c}") for c in by), F.coalesce(F.sum("__n").over(upto), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order))
    same = [F.col("__part") == F.col("__at"), *(F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by)]
    out = dealt.withColumn("__own", own).join(moved.withColumnRenamed("__part", "__at"), same)
    return out.select(*rows.columns, (F.col("__own") + F.col("__before")).alias(name))
