"""Trailing functions that a missing cell starts again, and their cell-wise and cross-sectional companions.

Each takes a dense panel (dti, ii, columns) and gives it with ``value``.
Trailing windows hold the last n rows since the last missing cell, nothing is
filled, and a missing cell gives NULL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.compile import Plan
from . import cross, series
from .guards import fin


def _history():
    return Window.partitionBy("ii").orderBy("dti")


def trailing(panel: DataFrame, build: Callable, inputs: list[str], n: int, *scalars: float) -> DataFrame:
    """``build``, a function of functions/series.py, over the rows since either input was missing."""
    plan = Plan(panel, None)
    cells = [plan.keep(fin(F.col(c).cast("double"))) for c in inputs]
    gap = cells[0].isNull() if len(cells) == 1 else cells[0].isNull() | cells[1].isNull()
    run, broken = plan.keep(F.count(F.when(gap, 1)).over(_history().rowsBetween(Window.unboundedPreceding, 0))), plan.keep(gap)
    t = plan.keep(F.row_number().over(_history()))
    rows = Window.partitionBy("ii", run, broken).orderBy("dti").rowsBetween(1 - n, 0)
    got = build(series.Frame(cells[0], cells[1] if len(cells) > 1 else None, t, rows, False), [float(n), *scalars])
    return plan.df.withColumn("value", F.when(~broken, fin(got))).select(*panel.columns, "value")


def _std(f: series.Frame, s: list) -> Column:
    spread = f.agg(F.stddev_pop(f.x))
    return F.when(spread * spread * f.n > 1e-15, spread).otherwise(0.0)


#: Trailing functions: name -> (inputs, builder)
TRAILING: dict[str, tuple[int, Callable]] = {
    "ts_sum": (1, series.SERIES["ts_sum"][3]),
    "ts_mean": (1, series.SERIES["ts_mean"][3]),
    "ts_min": (1, series.SERIES["ts_min"][3]),
    "ts_max": (1, series.SERIES["ts_max"][3]),
    "ts_delta": (1, series.delta),
    "ts_delay": (1, series.first),
    "ts_ema": (1, series.ema),
    "ts_rank": (1, series.rank),
    "ts_corr": (2, series.corr),
    "ts_cov": (2, series.cov),
    "ts_std": (1, _std),
}


def over_valid(panel: DataFrame, x: str, n: int) -> DataFrame:
    """Population deviation of the last n valid cells; missing ones neither count nor start again."""
    own = Window.partitionBy("ii", fin(F.col(x)).isNotNull()).orderBy("dti").rowsBetween(1 - n, 0)
    return panel.withColumn("value", F.when(fin(F.col(x)).isNotNull(), F.stddev_pop(F.col(x)).over(own)))


def forward_filled(panel: DataFrame, x: str, n: int) -> DataFrame:
    """The last valid cell, at most n rows old."""
    back = _history().rowsBetween(-n, 0)
    return panel.withColumn("value", F.last(fin(F.col(x)), True).over(back))


def interpolated(panel: DataFrame, x: str, n: int) -> DataFrame:
    """Gaps of up to n rows between valid cells, filled along a line."""
    plan = Plan(panel, None)
    cell, t = plan.keep(fin(F.col(x))), plan.keep(F.row_number().over(_history()))
    return plan.df.withColumn("value", plan.filled(cell, t, _history(), n)).select(*panel.columns, "value")


def filled_with_mean(panel: DataFrame, x: str, n: int) -> DataFrame:
    """Missing cells take the sum of the last n valid ones over n, which early on counts absent ones as 0."""
    plan = Plan(panel, None)
    cell = plan.keep(fin(F.col(x)))
    so_far = _history().rowsBetween(Window.unboundedPreceding, 0)
    number = plan.keep(F.count(cell).over(so_far))
    valid = Window.partitionBy("ii", cell.isNotNull()).orderBy("dti").rowsBetween(1 - n, 0)
    recent = plan.keep(F.when(cell.isNotNull(), F.sum(cell).over(valid)))
    mean = F.when(number > 0, F.last(recent, True).over(so_far)).otherwise(0.0) / n
    return plan.df.withColumn("value", F.coalesce(cell, mean)).select(*panel.columns, "value")


def zero_filled(panel: DataFrame, x: str) -> DataFrame:
    """0 for missing cells after an instrument's first valid one."""
    seen = F.count(fin(F.col(x))).over(_history().rowsBetween(Window.unboundedPreceding, 0)) > 0
    return panel.withColumn("value", F.coalesce(fin(F.col(x)), F.when(seen, 0.0)))


def ranked(panel: DataFrame, x: str, tie: float = 0.0) -> DataFrame:
    """Average rank over n - 1 across a date; a single value has none.  Equal values share a rank, and neighbours in order within a relative ``tie``."""
    plan = Plan(panel, None)
    cell = plan.keep(fin(F.col(x)))
    n = F.count(cell).over(Window.partitionBy("dti"))
    rank = cross.rank_near(cell, [tie], ["dti"], plan.keep) if tie else cross.rank(cell, [], ["dti"])
    return plan.df.withColumn("value", F.when(n > 1, rank)).select(*panel.columns, "value")


def scaled(panel: DataFrame, x: str, total: float = 1.0) -> DataFrame:
    """Cells over the date's sum of sizes, times ``total``; missing ones are 0."""
    cell = F.coalesce(fin(F.col(x)), F.lit(0.0))
    size = F.sum(F.abs(cell)).over(Window.partitionBy("dti"))
    return panel.withColumn("value", F.when(size > 0, cell * total / F.when(size > 0, size)))


def demeaned(panel: DataFrame, x: str, group: str | None = None) -> DataFrame:
    """Cells less the mean of their date, or of their date and group."""
    own = Window.partitionBy("dti", *([group] if group else []))
    out = fin(F.col(x)) - F.avg(fin(F.col(x))).over(own)
    return panel.withColumn("value", F.when(F.col(group).isNotNull(), out) if group else out)


#: Cell by cell: name -> builder of columns
CELLS: dict[str, Callable[..., Column]] = {
    "a_filter": lambda a, b: F.when(b > 0.5, a),
    "a_mask": lambda a, b: F.when(F.coalesce(b != 0, F.lit(False)), a),
    "a_min": lambda a, b: F.least(a, b),
    "a_max": lambda a, b: F.greatest(a, b),
    "log": lambda a: F.ln(F.when(fin(a) >= 1e-20, fin(a))),
}
