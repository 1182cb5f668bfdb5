"""Trailing functions of one instrument's history: (frame, scalars) -> column.

A frame is the last rows of an instrument, today's included.  Plain functions
see the history with gaps of up to 60 rows filled along a line, and from the
last remaining gap on; ``_raw`` functions see the rows as they are and skip
missing cells.  Both give NULL where today's cell is missing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from .guards import power


@dataclass
class Frame:
    x: Column  # first input, NULL where missing
    y: Column | None  # second input
    t: Column  # row number of the instrument's day
    over: WindowSpec
    raw: bool
    begin: Column | None = None  # row number of the frame's first row, where it is not the window's
    line: WindowSpec | None = None  # the window without its frame
    keep: Callable[[Column], Column] | None = None  # makes a column of its own, for windows over windows

    def agg(self, c: Column) -> Column:
        return c.over(self.over)

    def cells(self, *c: Column) -> Column:
        """The frame's cells, oldest first, missing ones kept."""
        return F.collect_list(F.struct(*(x.alias(f"c{i}") for i, x in enumerate(c)))).over(self.over)

    @property
    def start(self) -> Column:
        return F.min(self.t).over(self.over) if self.begin is None else self.begin

    @property
    def n(self) -> Column:
        return F.count(self.x).over(self.over)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def _over(make):
    return lambda f, s: f.agg(make(f.x))


def rmean(f, s):
    """Alternating signs, + at the frame's first row."""
    sign = lambda t: F.when(t % 2 == 0, 1.0).otherwise(-1.0)
    return _ratio(f.agg(F.sum(f.x * sign(f.t))) * sign(f.start), f.n)


def mean_dev(f, s):
    mean = f.agg(F.avg(f.x))
    return F.aggregate(F.filter(F.transform(f.cells(f.x), lambda e: F.abs(e["c0"] - mean)), lambda d: d.isNotNull()), F.lit(0.0), lambda a, d: a + d)


def central_moment(f, s):
    mean = f.agg(F.avg(f.x))
    parts = F.transform(f.cells(f.x), lambda e: power(e["c0"] - mean, s[1]))
    return F.aggregate(parts, F.lit(0.0), lambda a, d: a + d)


def zscore(f, s):
    return f.agg(F.stddev_pop(f.x)) if f.raw else _ratio(f.x - f.agg(F.avg(f.x)), f.agg(F.stddev_pop(f.x)))


def demean(f, s):
    return f.agg(F.stddev_pop(f.x)) if f.raw else f.x - f.agg(F.avg(f.x))


def first(f, s):
    return f.agg(F.first(f.x))


def delta(f, s):
    return f.x - f.agg(F.first(f.x))


def _corr(over: WindowSpec, x: Column, y: Column) -> Column:
    """Pearson over pairs that both sides have; NULL below two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    n, sxx, syy = F.count(x).over(over), F.var_pop(x).over(over), F.var_pop(y).over(over)
    some = (n > 1) & (n * sxx > 1e-18) & (n * syy > 1e-18)
    return F.when(some, F.covar_pop(x, y).over(over) / F.sqrt(F.when(sxx * syy > 0, sxx * syy)))


def corr(f, s):
    return _corr(f.over, f.x, f.y)


def corr_step(f, s):
    return _corr(f.over, f.x, f.t.cast("double"))


def auto_corr(f, s):
    """Of each row with the one ``s[1]`` rows before it, over the last ``s[0]`` rows."""
    early = f.keep(F.lag(f.x, int(s[1])).over(f.line))
    return _corr(f.line.rowsBetween(1 - int(s[0]), 0), early, f.x)


def cov(f, s):
    both = f.x.isNotNull() & f.y.isNotNull()
    x, y = F.when(both, f.x), F.when(both, f.y)
    return f.agg(F.avg(x * y)) - f.agg(F.avg(x)) * f.agg(F.avg(y))


def _recur(f, step):
    return F.aggregate(f.cells(f.x), F.lit(None).cast("double"), lambda acc, e: F.when(acc.isNotNull() & e["c0"].isNotNull(), step(acc, e["c0"])).otherwise(e["c0"]))


def ema(f, s):
    return _recur(f, lambda acc, x: x * s[1] + acc * (1 - s[1]))


def sma(f, s):
    return ema(f, [s[0], s[2] / s[1]])


def wma(f, s):
    return _recur(f, lambda acc, x: x + acc * 0.9)


def decay_linear(f, s):
    parts = F.transform(f.cells(f.x, f.t.cast("double")), lambda e: F.struct(e["c0"].alias("x"), e["c1"].alias("t")))
    lo = f.start.cast("double")
    top = F.aggregate(parts, F.lit(0.0), lambda a, e: a + F.coalesce(e["x"] * (e["t"] - lo + 1), F.lit(0.0)))
    low = F.aggregate(parts, F.lit(0.0), lambda a, e: a + F.when(e["x"].isNotNull(), e["t"] - lo + 1).otherwise(0.0))
    return _ratio(top, low)


def sum_if(f, s):
    return F.coalesce(f.agg(F.sum(F.when(F.coalesce(f.y != 0, F.lit(True)), f.x))), F.lit(0.0))


def argmax(f, s):
    return (f.t - f.agg(F.max_by(f.t, F.when(f.x.isNotNull(), F.struct(f.x, -f.t))))).cast("double")


def argmin(f, s):
    return (f.t - f.agg(F.min_by(f.t, F.when(f.x.isNotNull(), F.struct(f.x, f.t))))).cast("double")


def rank(f, s):
    have = F.filter(F.transform(f.cells(f.x), lambda e: e["c0"]), lambda x: x.isNotNull())
    n, now = F.size(have), f.x
    below, ties = F.size(F.filter(have, lambda x: x < now)), F.size(F.filter(have, lambda x: x == now))
    return F.when(n == 1, 0.5).otherwise((2 * below + ties - 1) / (2 * F.when(n > 1, n - 1)))


def sum_max_pct(f, s):
    """Sum of y over the share s[1] of rows with the largest x; of equal x the oldest row first."""
    rows = F.filter(f.cells(f.x, -f.t, f.y), lambda e: e["c0"].isNotNull())
    best = F.slice(F.sort_array(rows, asc=False), 1, F.ceil(F.size(rows) * s[1]).cast("int"))
    return F.aggregate(best, F.lit(0.0), lambda a, e: a + F.coalesce(e["c2"], F.lit(0.0)))


def count_v(f, s):
    return f.n.cast("double")


def count(f, s):
    return f.agg(F.count(F.when(F.coalesce(f.x != 0, F.lit(True)), 1))).cast("double")


def idx(f, s):
    """x as many rows ago as today's y says."""
    cells, back = F.transform(f.cells(f.x), lambda e: e["c0"]), F.floor(f.y)
    return F.when((back >= 0) & (back < F.size(cells)), F.try_element_at(cells, (F.size(cells) - back).cast("int")))


def prod(f, s):
    return F.aggregate(F.filter(F.transform(f.cells(f.x), lambda e: e["c0"]), lambda x: x.isNotNull()), F.lit(1.0), lambda a, x: a * x)


#: name -> (inputs, scalars, rows beyond N, builder)
SERIES = {
    "ts_min": (1, 1, 0, _over(F.min)),
    "ts_max": (1, 1, 0, _over(F.max)),
    "ts_mean": (1, 1, 0, _over(F.avg)),
    "ts_rmean": (1, 1, 0, rmean),
    "ts_std": (1, 1, 0, _over(F.stddev_pop)),
    "ts_mean_dev": (1, 1, 0, mean_dev),
    "ts_zscore": (1, 1, 0, zscore),
    "ts_demean": (1, 1, 0, demean),
    "ts_central_moment": (1, 2, 0, central_moment),
    "ts_delay": (1, 1, 1, first),
    "ts_sum": (1, 1, 0, _over(F.sum)),
    "ts_prod": (1, 1, 0, prod),
    "ts_delta2": (1, 1, 1, delta),
    "ts_delta": (1, 1, 0, delta),
    "ts_corr_step": (1, 1, 0, corr_step),
    "ts_corr": (2, 1, 0, corr),
    "ts_auto_corr": (1, 2, math.inf, auto_corr),  # the lag, its second scalar
    "ts_ema": (1, 2, 0, ema),
    "ts_sma": (1, 3, 0, sma),
    "ts_wma": (1, 1, 0, wma),
    "ts_decay_linear": (1, 1, 0, decay_linear),
    "ts_cov": (2, 1, 0, cov),
    "ts_sum_if": (2, 1, 0, sum_if),
    "ts_argmax": (1, 1, 0, argmax),
    "ts_high_day": (1, 1, 0, argmax),
    "ts_argmin": (1, 1, 0, argmin),
    "ts_low_day": (1, 1, 0, argmin),
    "ts_rank": (1, 1, 0, rank),
    "ts_sum_max_pct": (2, 2, 0, sum_max_pct),
}
RAW_ONLY = {"ts_count_v": (1, 1, 0, count_v), "ts_count": (1, 1, 0, count), "ts_idx": (2, 1, 0, idx)}
