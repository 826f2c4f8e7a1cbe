"""Numbers and running sums over a whole table, without bringing it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.plans.cut import cut


def running(df: DataFrame, order: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the sum of ``amount`` over all rows before each in ``order`` (ties in any order).

    Rows are range-partitioned and cut with their partition's number; sums run within partitions, and
    the partitions' totals, one row each, are summed before.
    """
    ranged = cut(df.withColumn("_amount", amount).repartitionByRange(*order).withColumn("_block", F.spark_partition_id()))
    own = F.sum("_amount").over(Window.partitionBy("_block").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    totals = ranged.groupBy("_block").agg(F.sum("_amount").alias("_total"))
    before = F.sum("_total").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))  # one row a partition
    starts = totals.select("_block", F.coalesce(before, F.lit(0)).alias("_start"))
    return ranged.withColumn("_own", F.coalesce(own, F.lit(0))).join(F.broadcast(starts), "_block").withColumn(name, F.col("_own") + F.col("_start")).drop("_amount", "_block", "_own", "_start")


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with its row's number in ``order``, from 1."""
    return running(df, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
