"""Places and prefix sums in a global order, without a task that holds a whole group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import cut


def prefix_sums(rows: DataFrame, group: str, measure: Column, keys: list, made: list[str], more: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``rows`` with before (the sum of ``measure`` over the rows of its group that come earlier by ``keys``) and whole (the group's sum).

    Rows are dealt to ranges of (group, keys, a row number), so neither a hot group
    nor a run of equal rows ends up in one task; equal rows come in the order of the
    written table.  Sums of the ranges, of which a group has as many as there are
    partitions, give each range its start.  ``more`` takes (group, whole) and gives
    further columns of a group; they come along on the rows of the ranges, so no join
    has a group as its key.  Tables written on the way go to ``made``.
    """
    rows = cut(rows.withColumn("_measure", measure).withColumn("_row", F.monotonically_increasing_id()), made)
    rows = cut(rows.repartitionByRange(group, *keys, "_row").withColumn("_range", F.spark_partition_id()), made)
    sums = cut(rows.groupBy(group, "_range").agg(F.sum("_measure").alias("_held")), made)
    started = F.sum("_held").over(Window.partitionBy(group).orderBy("_range")) - F.col("_held")
    totals = sums.groupBy(group).agg(F.sum("_held").alias("whole"))
    starts = sums.withColumn("_start", started).join(more(totals) if more else totals, group)
    inside = Window.partitionBy(group, "_range").orderBy(*keys, "_row").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumn("_inside", F.sum("_measure").over(inside) - F.col("_measure")).join(starts, [group, "_range"])
    return out.withColumn("before", F.col("_start") + F.col("_inside")).drop("_measure", "_row", "_range", "_held", "_start", "_inside")


def numbered(rows: DataFrame, key: str, made: list[str]) -> DataFrame:
    """``rows``, one per ``key``, with place, its number from 0 in their order."""
    out = prefix_sums(rows.withColumn("_all", F.lit(0)), "_all", F.lit(1).cast("long"), [key], made, lambda t: t.select("_all"))
    return out.drop("_all").withColumnRenamed("before", "place")
