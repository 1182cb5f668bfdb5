"""Reductions of each date's instruments, and fills along an instrument's dates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin
from ..plans.compile import Plan


def by_date(panel: DataFrame, x: str, y: str, w: str) -> DataFrame:
    """One row per date: mean, sum and population variance and deviation of x, its norms, and weighted sums and products with y and w.

    Each takes the rows where all its inputs are finite.  ``wcorr`` centres on
    plain means and weighs the products.
    """
    a, b, c = (fin(F.col(k).cast("double")) for k in (x, y, w))
    rows = panel.select("dti", a.alias("a"), b.alias("b"), c.alias("c"))
    day = Window.partitionBy("dti")
    full = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("c").isNotNull()
    rows = rows.withColumn("da", F.when(full, F.col("a") - F.avg(F.when(full, F.col("a"))).over(day))).withColumn("db", F.when(full, F.col("b") - F.avg(F.when(full, F.col("b"))).over(day)))
    total = lambda e: F.coalesce(F.sum(e), F.lit(0.0))
    a, b, c, da, db = (F.col(k) for k in ("a", "b", "c", "da", "db"))
    weight = F.sum(F.when(a.isNotNull(), c))
    square = F.sum(da * da * c) * F.sum(db * db * c)
    return rows.groupBy("dti").agg(
        F.avg(a).alias("mean"), total(a).alias("sum"), F.var_pop(a).alias("var"), F.stddev_pop(a).alias("std"), total(a * c).alias("wsum"),
        (F.sum(a * c) / F.when(weight != 0, weight)).alias("wmean"), F.when((F.count(da) > 1) & (square > 0), F.sum(da * db * c) / F.sqrt(F.when(square > 0, square))).alias("wcorr"),
        total(a * b).alias("dot"), total(a * a).alias("squared_norm"), F.sqrt(total(a * a)).alias("norm"),
    )


def fills(panel: DataFrame, x: str, shift: int = 1) -> DataFrame:
    """(dti, ii, shifted, ffill, linear_fill): the cell some rows ago, the last valid one, and gaps filled along a line."""
    plan = Plan(panel, None)
    own = Window.partitionBy("ii").orderBy("dti")
    cell, t = plan.keep(fin(F.col(x).cast("double"))), plan.keep(F.row_number().over(own))
    line = plan.keep(plan.filled(cell, t, own, float("inf")))
    return plan.df.select("dti", "ii", F.lag(cell, shift).over(own).alias("shifted"), F.last(cell, True).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("ffill"), line.alias("linear_fill"))
