"""Similarity of every pair of stored series, and subsets without close pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled

#: Series that one block of a pair matrix takes, and dates of a block.
WIDTH, DATES = 256, 64


def cosines(series: DataFrame) -> DataFrame:
    """(a, b, cos) with a < b of all pairs of ``series`` (name long, t, value): the cosine over the times at which both are finite, NULL if either is zero there.

    Dates are dealt to blocks of DATES.  A task takes one block's cells of two blocks of
    WIDTH series each, as two small matrices, and gives their products, which sum up over
    the blocks of dates; series meet as blocks, never one by one.
    """
    cells = series.where("value is not null and not isnan(value) and abs(value) < double('Infinity')").select("name", "t", "value")
    cells = cells.withColumn("span", F.floor(F.col("t") / DATES)).withColumn("own", F.floor(F.col("name") / WIDTH).cast("long"))
    last = cells.agg(F.max("own")).first()[0] or 0
    # a row for every block of series that a cell meets, its own included
    met = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    met = met.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))

    def products(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, i, j = key
        times, t = np.unique(rows["t"].to_numpy(), return_inverse=True)
        names = rows["name"].to_numpy()

        def matrix(block):
            own, at = np.unique(names[names // WIDTH == block], return_inverse=True)
            x, here = np.zeros((len(times), len(own))), names // WIDTH == block
            known = np.zeros_like(x)
            x[t[here], at], known[t[here], at] = rows["value"].to_numpy()[here], 1.0
            return own, x, known

        (a, x, kx), (b, y, ky) = matrix(i), matrix(j)
        p, q = np.nonzero((a[:, None] < b[None, :]) & (kx.T @ ky > 0)) if len(a) and len(b) else (np.empty(0, int),) * 2
        return pd.DataFrame({"a": a[p], "b": b[q], "xy": (x.T @ y)[p, q], "xx": ((x * x).T @ ky)[p, q], "yy": (kx.T @ (y * y))[p, q]})

    sums = met.groupBy("span", "i", "j").applyInPandas(products, "a long, b long, xy double, xx double, yy double")
    sums = sums.groupBy("a", "b").agg(F.sum("xy").alias("xy"), F.sum("xx").alias("xx"), F.sum("yy").alias("yy"))
    return sums.select("a", "b", F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("xy") / F.sqrt(F.when(F.col("xx") * F.col("yy") > 0, F.col("xx") * F.col("yy")))).alias("cos"))


def decorrelated(names: DataFrame, pairs: DataFrame, most: float) -> DataFrame:
    """(name, kept): ``names`` (name) in order, each kept unless an earlier kept one has cos > ``most`` with it; ``pairs`` as of ``cosines``.

    Whether a series stays depends only on earlier ones that are close to it.  In each
    round those that have no undecided earlier neighbour are kept, and what is close
    to them goes; a round decides all of them together.
    """
    links = settled(pairs.where(F.col("cos") > most).select("a", "b"))
    state = settled(names.select("name").distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while not links.isEmpty():
        waits = links.select(F.col("b").alias("name")).distinct().withColumn("waits", F.lit(True))
        state = state.join(waits, "name", "left").withColumn("kept", F.when(F.col("kept").isNull() & F.col("waits").isNull(), True).otherwise(F.col("kept"))).drop("waits")
        gone = links.join(state.where("kept").select(F.col("name").alias("a")), "a", "left_semi").select(F.col("b").alias("name")).distinct().withColumn("gone", F.lit(True))
        state = settled(state.join(gone, "name", "left").withColumn("kept", F.when(F.col("gone"), False).otherwise(F.col("kept"))).drop("gone"))
        open_ = state.where("kept is null").select("name")
        links = settled(links.join(open_.withColumnRenamed("name", "a"), "a", "left_semi").join(open_.withColumnRenamed("name", "b"), "b", "left_semi").select("a", "b"))
    return state.withColumn("kept", F.coalesce("kept", F.lit(True)))


def similarity(series: DataFrame, first: str, second: str) -> DataFrame:
    """(similar): how alike the paths of two running sums are, of rows (t, first, second): one over the mean distance of their steps as parts of the whole way, by the root of the number of steps; negative if they end on two sides.

    The first row is where both start.  NULL without a step, or where a path ends where it starts.
    """
    line = Window.orderBy("t")
    # stored daily series: one row a date
    rows = series.select(F.col(first).alias("x"), F.col(second).alias("y"), F.row_number().over(line).alias("k")).where("k > 1")
    every = Window.partitionBy(F.lit(0))
    rows = rows.withColumn("sx", F.sum("x").over(every)).withColumn("sy", F.sum("y").over(every)).where("sx <> 0 and sy <> 0")
    out = rows.agg(F.avg(F.abs(F.col("y") / F.col("sy") - F.col("x") / F.col("sx"))).alias("apart"), F.count("*").alias("n"), F.first((F.col("sx") < 0) != (F.col("sy") < 0)).alias("turned"))
    return out.select(F.when(F.col("apart") > 0, F.when(F.col("turned"), -1.0).otherwise(1.0) / (F.when(F.col("apart") > 0, F.col("apart")) * F.sqrt("n"))).alias("similar"))
