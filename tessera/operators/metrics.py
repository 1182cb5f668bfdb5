"""Metrics of a signal as plug-ins: what each sums up per date, and what it makes of the dates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin
from .market import ratio
from .pnl import drawdown


@dataclass
class Setting:
    """Book size (twice as large for a book of shorts too), days a year, intervals a day, and fees of buying and selling."""

    book: float = 1e5
    days: int = 250
    intervals: int = 1
    buy_fee: float = 1e-4
    sell_fee: float = 11e-4
    short_book: bool = False

    @property
    def size(self) -> float:
        return self.book * (2 if self.short_book else 1)


Compute = Callable[[Setting], dict[str, Column]]


@dataclass
class Metric:
    """``compute`` gives aggregates over a date's rows (s, the signal; p, the one held; trade; r, the return), ``derive`` columns of the days from those, ``summarise`` aggregates over days."""

    compute: Compute
    derive: Compute
    summarise: Compute


METRICS: dict[str, Metric] = {}


def metric(name: str, compute: Compute, derive: Compute | None = None, summarise: Compute | None = None) -> None:
    """Registers a metric under a name; ``derive`` may use what metrics before it in the list gave."""
    METRICS[name] = Metric(compute, derive or (lambda c: {}), summarise or (lambda c: {}))


def of(when: Column, x: Column) -> Column:
    return F.sum(F.when(when, x).otherwise(0.0))


s, p, r, trade = "s", "p", "r", "trade"
metric(
    "base",
    lambda c: {
        "long_count": F.count(F.when(F.col(s) > 0, 1)), "short_count": F.count(F.when(F.col(s) < 0, 1)), "long_val": of(F.col(s) > 0, F.col(s)), "short_val": of(F.col(s) < 0, F.col(s)),
        "trade_val": F.sum(F.abs(trade)), "pnl": F.sum(F.col(p) * F.col(r)),
    },
    lambda c: {"ret": F.col("pnl") / c.size, "tvr": F.col("trade_val") / c.size},
    lambda c: {
        "days": F.count("*"), "pnl": F.sum("pnl"), "ret": F.avg("ret") * c.days * c.intervals, "tvr": F.avg("tvr"), "long_count": F.avg("long_count"), "short_count": F.avg("short_count"),
        "up_days": F.count(F.when(F.col("ret") > 0, 1)), "down_days": F.count(F.when(F.col("ret") < 0, 1)),
    },
)
metric("tcost", lambda c: {"tcost": -c.buy_fee * of(F.col(trade) > 0, F.col(trade)) + c.sell_fee * of(F.col(trade) < 0, F.col(trade))}, lambda c: {"pnl": F.col("pnl") + F.col("tcost"), "ret": (F.col("pnl") + F.col("tcost")) / c.size}, lambda c: {"tcost": F.sum("tcost")})
metric("ic", lambda c: {"_pr": F.sum(F.col(p) * F.col(r)), "_pp": F.sum(F.col(p) * F.col(p)), "_rr": F.sum(F.col(r) * F.col(r))}, lambda c: {"ic": ratio(F.col("_pr"), F.sqrt(F.col("_pp") * F.col("_rr")))}, lambda c: {"ic": F.avg("ic")})
metric("ir", lambda c: {}, None, lambda c: {"std": F.stddev_samp("ret"), "ir": F.when(F.count("ret") > 1, ratio(F.avg("ret"), F.stddev_samp("ret"))) * c.intervals**0.5})


def daily(signal: DataFrame, names: list[str], setting: Setting) -> DataFrame:
    """One row per date with the columns of the metrics, from one aggregation of ``signal`` (dti, ii, value, ret)."""
    held = F.lag("s").over(Window.partitionBy("ii").orderBy("dti"))
    rows = signal.select("dti", "ii", F.coalesce(fin(F.col("value")), F.lit(0.0)).alias("s"), F.coalesce(fin(F.col("ret")), F.lit(0.0)).alias("r")).withColumn("held", held)
    rows = rows.select("dti", "s", "r", F.coalesce("held", F.lit(0.0)).alias("p"), F.when(F.col("held").isNotNull(), F.col("s") - F.col("held")).otherwise(0.0).alias("trade"))
    out = rows.groupBy("dti").agg(*(c.alias(n) for name in names for n, c in METRICS[name].compute(setting).items()))
    for name in names:
        derived = METRICS[name].derive(setting)
        out = out.withColumns(derived) if derived else out
    return out


def summaries(days: DataFrame, names: list[str], setting: Setting, period: Column) -> DataFrame:
    """One row per period of the days, and one of all with period NULL."""
    columns = [c.alias(n) for name in names for n, c in METRICS[name].summarise(setting).items()]
    return days.withColumn("period", period).rollup("period").agg(*columns)


def deepest_drawdown(days: DataFrame, value: str = "ret") -> DataFrame:
    """(max_dd, start, end): in percent, the deepest running loss of ``days`` (dti, value), with the numbers of the rows it began in and was deepest in.

    A loss that begins in row 1 counts from row 0, as row 0 stands for no loss yet.  Of
    equally deep rows the first counts; without a loss all is 0.  One row a date, so
    the ordered windows hold a calendar.
    """
    line = Window.partitionBy(F.lit(0)).orderBy("dti")
    df = drawdown(days, value).withColumn("k", (F.row_number().over(line) - 1).cast("long"))
    df = df.withColumn("_down", F.col("dd") < 0).withColumn("_first", F.col("_down") & ~F.coalesce(F.lag("_down").over(line), F.lit(False)))
    begun = F.max(F.when(F.col("_first"), F.when(F.col("k") == 1, 0).otherwise(F.col("k")))).over(line.rowsBetween(Window.unboundedPreceding, 0))
    deep = df.withColumn("_begun", begun).agg(F.min("dd").alias("dd"), F.min_by(F.struct("_begun", "k"), F.struct("dd", "k")).alias("at"))
    some = F.coalesce(F.col("dd") < 0, F.lit(False))
    return deep.select(F.when(some, F.col("dd") * 100).otherwise(0.0).alias("max_dd"), F.when(some, F.col("at._begun")).otherwise(0).alias("start"), F.when(some, F.col("at.k")).otherwise(0).alias("end"))


def cell_differences(left: DataFrame, right: DataFrame, value: str = "value") -> DataFrame:
    """(cells, n_missing, n_different) of two panels (dti, ii, value): cells that only one has, and cells that both have with other values."""
    a, b = left.select("dti", "ii", fin(F.col(value)).alias("a")), right.select("dti", "ii", fin(F.col(value)).alias("b"))
    both = a.join(b, ["dti", "ii"], "full")
    return both.agg(F.count("*").alias("cells"), F.count(F.when(F.col("a").isNull() != F.col("b").isNull(), 1)).alias("n_missing"), F.count(F.when(F.col("a") != F.col("b"), 1)).alias("n_different"))
