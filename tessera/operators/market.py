"""Daily price panels, universes, index membership and intraday bars as relational pipelines.

Panels are dense: a row for every date ``dti`` and instrument ``ii``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(*more: str):
    return Window.partitionBy("ii").orderBy("dti", *more)


def so_far():
    return history().rowsBetween(Window.unboundedPreceding, 0)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def base_panel(quotes: DataFrame, limit: float = 0.1) -> DataFrame:
    """The base panel of daily quotes (dti, ii, close, high, low, vol, dvol, shares, adj, listed).

    vwap is 0 without volume, cap takes the close before, adj is 1 unless given,
    halted rows have no volume, limits are ``limit`` around the close before,
    and univ_all holds listed rows that are not halted.
    """
    before = F.lag("close").over(history())
    halt = F.coalesce(F.col("vol"), F.lit(0.0)) <= 0
    return quotes.select(
        "dti", "ii", "close", "high", "low", "vol", "dvol", F.coalesce(ratio(F.col("dvol"), F.col("vol")), F.lit(0.0)).alias("vwap"), (F.col("shares") * before).alias("cap"),
        F.coalesce("adj", F.lit(1.0)).alias("adj"), halt.alias("halt"), (before * (1 + limit)).alias("limit_up"), (before * (1 - limit)).alias("limit_down"),
        (F.coalesce("listed", F.lit(False)) & ~halt).alias("univ_all"),
    )


def asof(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` with the same key at or before ``at``, by one window over both, without an inequality join.

    Of rows of ``right`` at one time the one with the largest values counts.  Rows without key or time get NULL.
    """
    marked = F.struct(*values)
    one = right.groupBy(key, at).agg(F.max(marked).alias("_v"))
    names = left.columns
    both = left.withColumn("_l", F.struct(*names)).select(key, at, "_l", F.lit(None).cast(one.schema["_v"].dataType).alias("_v")).unionByName(one.select(key, at, F.lit(None).cast(left.select(F.struct(*names)).schema[0].dataType).alias("_l"), "_v"))
    back = Window.partitionBy(key).orderBy(F.col(at), F.col("_l").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    out = both.withColumn("_v", F.when(known, F.last("_v", True).over(back))).where("_l is not null")
    return out.select("_l.*", *(F.col(f"_v.{v}").alias(v) for v in values))


def index_membership(weights: DataFrame, calendar: DataFrame, backfill: int | None = None) -> DataFrame:
    """(dti, ii, weight) on every date of ``calendar``: the last published weights (dti, ii, weight), as parts of their total; dates before the first have none.

    With ``backfill``, earlier dates take what was published on that date, if anything was.
    """
    total = F.sum("weight").over(Window.partitionBy("dti"))
    known = weights.select("dti", "ii", ratio(F.col("weight"), total).alias("weight"))
    # dates are one row each, so the single window holds a calendar
    published, days = weights.select(F.col("dti").alias("published")).distinct(), calendar.select("dti").distinct()
    line = Window.orderBy("dti").rowsBetween(Window.unboundedPreceding, 0)
    both = days.join(published.withColumn("dti", F.col("published")), "dti", "full")
    if backfill is not None:
        first = published.where(F.col("published") == backfill).select(F.col("published").alias("_first"))
        both = both.join(first, (F.col("dti") < backfill), "left").withColumn("published", F.when(F.col("dti") < backfill, F.col("_first")).otherwise(F.col("published")))
    dates = both.select("dti", F.last("published", True).over(line).alias("published")).join(days, "dti", "left_semi")
    return dates.join(known.withColumnRenamed("dti", "published"), "published").select("dti", "ii", "weight")


def carried_flag(panel: DataFrame, flag: str) -> DataFrame:
    """(dti, ii, value): ``flag`` (1, 0 or unknown), carried forward where unknown, false before the first known."""
    known = F.when(F.col(flag).isin(0, 1), F.col(flag) == 1)
    return panel.select("dti", "ii", F.coalesce(F.last(known, True).over(so_far()), F.lit(False)).alias("value"))


def merged_universe(panel: DataFrame, include: list[str], intersect: list[str], exclude: list[str]) -> DataFrame:
    """(dti, ii, value): in any of ``include``, all of ``intersect`` and none of ``exclude``; unknown counts as out."""
    inside = lambda c: F.coalesce(F.col(c), F.lit(False))
    out = F.lit(False)
    for c in include:
        out = out | inside(c)
    for c in intersect:
        out = out & inside(c)
    for c in exclude:
        out = out & ~inside(c)
    return panel.select("dti", "ii", out.alias("value"))


def screened_universe(panel: DataFrame, size: int, window: int, lookback: int, pass_rate: float, sticky: int, least_cap: float = 0.0, least_price: float = 0.0, most_price: float = float("inf"), least_volume: float = 0.0) -> DataFrame:
    """(dti, ii, passed, in_univ) from (dti, ii, close, vol, cap, st, univ_all).

    Candidates of a date are the ``size`` rows of the parent universe, not
    flagged and within the bounds by yesterday's price and cap, with the largest
    mean traded value of the ``window`` days before; ties go to the smaller ii.
    A row passes if it was a candidate on ``pass_rate`` percent of the last
    ``lookback`` days, and stays in for ``sticky`` days after it last passed.
    """
    before = lambda c: F.lag(c).over(history())
    traded = F.when(F.col("close") * F.col("vol") >= 0, F.col("close") * F.col("vol"))
    df = panel.withColumn("_t", F.row_number().over(history())).withColumn("_m", F.avg(traded).over(history().rowsBetween(-window, -1)))
    price = before("close")
    fits = F.col("univ_all") & (F.coalesce("st", F.lit(0)) == 0) & (before("cap") >= least_cap) & (price >= least_price) & (price <= most_price) & (F.col("_m") >= least_volume)
    df = df.withColumn("_fits", F.coalesce(fits, F.lit(False)))
    order = F.row_number().over(Window.partitionBy("dti", "_fits").orderBy(F.col("_m").desc(), "ii"))
    df = df.withColumn("_candidate", (F.col("_fits") & (order <= size)).cast("int"))
    days = F.least(F.col("_t"), F.lit(lookback))
    rate = F.sum("_candidate").over(history().rowsBetween(1 - lookback, 0)) / days * 100
    df = df.withColumn("passed", F.coalesce(F.col("univ_all"), F.lit(False)) & (rate >= pass_rate))
    recent = F.max(F.col("passed").cast("int")).over(history().rowsBetween(-sticky, 0)) == 1
    return df.select("dti", "ii", "passed", (F.coalesce("univ_all", F.lit(False)) & recent).alias("in_univ"))


def hedged_forward_return(panel: DataFrame, days: int, index: int | None = None, limits: bool = False, quantile: float = 1.0, most: float = 10.0) -> DataFrame:
    """(dti, ii, fret): the return of the ``days`` rows ahead of adj_close, less that of the instrument ``index``'s close if given.

    With ``limits``, rows that closed at their limit (or moved beyond
    ``quantile`` of it) have none, and the rest is cut off at +-``most``.
    """
    ahead = lambda c: F.lead(c, days).over(history())
    df = panel.withColumn("fret", ratio(ahead("adj_close"), F.col("adj_close")) - 1).withColumn("_hedge", ratio(ahead("close"), F.col("close")) - 1)
    if index is not None:
        df = df.withColumn("fret", F.col("fret") - F.max(F.when(F.col("ii") == index, F.col("_hedge"))).over(Window.partitionBy("dti")))
    if limits:
        if quantile == 1.0:
            at_limit = (F.col("close") > F.col("limit_up") - 1e-3) | (F.col("close") < F.col("limit_down") + 1e-3)
        else:
            before = F.lag("close").over(history())
            up, down = (ratio(F.col(c) * F.col("adj"), before) - 1 for c in ("limit_up", "limit_down"))
            at_limit = (F.col("ret") > up * quantile) | (F.col("ret") < down * quantile)
        df = df.withColumn("fret", F.when(~F.coalesce(at_limit, F.lit(False)), F.col("fret")))
        df = df.withColumn("fret", F.when(F.col("fret").isNotNull(), F.greatest(F.least("fret", F.lit(most)), F.lit(-most))))
    return df.select("dti", "ii", "fret")


def intraday_bars(ticks: DataFrame) -> DataFrame:
    """Bars (ii, dti, ti) of ticks (ii, dti, ti, at, price, vol): last, high, low, volume, traded value and vwap of the bucket and of the day so far.

    Buckets of a day without ticks carry the last price; their volume is 0.
    """
    value = F.col("price") * F.col("vol")
    found = ticks.groupBy("ii", "dti", "ti").agg(F.max_by("price", "at").alias("last"), F.max("price").alias("high"), F.min("price").alias("low"), F.sum("vol").alias("vol"), F.sum(value).alias("dvol"))
    grid = found.groupBy("ii", "dti").agg(F.min("ti").alias("a"), F.max("ti").alias("b")).select("ii", "dti", F.explode(F.sequence("a", "b")).alias("ti"))
    df = grid.join(found, ["ii", "dti", "ti"], "left")
    day = Window.partitionBy("ii", "dti").orderBy("ti").rowsBetween(Window.unboundedPreceding, 0)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    df = df.select("ii", "dti", "ti", F.last("last", True).over(day).alias("last"), "high", "low", zero("vol").alias("vol"), zero("dvol").alias("dvol"), F.sum(zero("vol")).over(day).alias("cumvol"), F.sum(zero("dvol")).over(day).alias("cumdvol"))
    return df.withColumn("vwap", ratio(F.col("dvol"), F.col("vol"))).withColumn("cumvwap", ratio(F.col("cumdvol"), F.col("cumvol")))


def bucket_return(bars: DataFrame) -> DataFrame:
    """(ii, dti, ti, ret): 1 - last bar's price / this one's, from bar to bar across days."""
    return bars.select("ii", "dti", "ti", (1 - ratio(F.lag("last").over(history("ti")), F.col("last"))).alias("ret"))


def cut_day(bars: DataFrame, cut: int) -> DataFrame:
    """(ii, dti) as of the bucket ``cut``: last, high, low, volume, value and vwap so far, the vwap of the rest of the day, and returns of both on the day before."""
    upto = F.col("ti") <= cut
    held = lambda c: F.max_by(F.when(upto, F.col(c)), F.when(upto & F.col(c).isNotNull(), F.col("ti")))
    df = bars.groupBy("ii", "dti").agg(
        held("last").alias("last"), F.max(F.when(upto, F.col("high"))).alias("high"), F.min(F.when(upto, F.col("low"))).alias("low"), F.coalesce(held("cumvol"), F.lit(0.0)).alias("cumvol"),
        F.coalesce(held("cumdvol"), F.lit(0.0)).alias("cumdvol"), held("cumvwap").alias("cumvwap"), ratio(F.sum(F.when(F.col("ti") > cut + 1, F.col("dvol"))), F.sum(F.when(F.col("ti") > cut + 1, F.col("vol")))).alias("vwap_tail"),
    )
    change = lambda c: ratio(F.col(c), F.lag(c).over(history())) - 1
    return df.withColumn("ret_cut", change("last")).withColumn("ret_tail", change("vwap_tail"))


def average_signal(signals: list[DataFrame], weights: list[float]) -> DataFrame:
    """Weighted average of signals (dti, ii, value), missing cells taken as 0."""
    parts = [s.select("dti", "ii", (F.coalesce("value", F.lit(0.0)) * w).alias("v")) for s, w in zip(signals, weights)]
    df = parts[0]
    for p in parts[1:]:
        df = df.unionByName(p)
    return df.groupBy("dti", "ii").agg((F.sum("v") / sum(weights)).alias("value"))


def late_mean_alpha(panel: DataFrame, ret: str, lookback: int, total: float = 1.0) -> DataFrame:
    """(dti, ii, value): mean return of ``lookback`` rows, as of ``lookback`` rows ago, demeaned and scaled by date."""
    mean = F.avg(ret).over(history().rowsBetween(1 - lookback, 0))
    df = panel.withColumn("_m", mean).withColumn("_m", F.lag("_m", lookback).over(history()))
    day = Window.partitionBy("dti")
    df = df.withColumn("_d", F.col("_m") - F.avg("_m").over(day))
    return df.select("dti", "ii", (F.col("_d") * total / F.when(F.sum(F.abs("_d")).over(day) > 0, F.sum(F.abs("_d")).over(day))).alias("value"))


def market_table(panel: DataFrame, group: str) -> DataFrame:
    """One row per date and group: traded value, mean range, return and size of return, and the value against the last 1, 5 and 20 dates' means."""
    found = panel.groupBy("dti", group).agg(F.sum("dvol").alias("dvol"), F.avg(ratio(F.col("high") - F.col("low"), F.col("close"))).alias("range"), F.avg("ret").alias("ret"), F.avg(F.abs("ret")).alias("size"))
    own = Window.partitionBy(group).orderBy("dti")
    for n in (1, 5, 20):
        found = found.withColumn(f"to_{n}", ratio(F.col("dvol"), F.avg("dvol").over(own.rowsBetween(-n, -1))))
    return found
