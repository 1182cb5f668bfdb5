"""Profit and loss of a signal, with one day's delay: what is held at t earns the return of t + 1."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def history():
    return Window.partitionBy("ii").orderBy("dti")


def daily(signal: DataFrame, book: float = 100000.0, buy_fee: float = 0.0, sell_fee: float = 0.0) -> DataFrame:
    """One row per date: counts and values of longs and shorts, trading, profits, cost and information coefficient.

    ``signal`` has (dti, ii, value, ret) on a dense panel; missing signals and returns count as 0.
    """
    sig, ret = F.coalesce("value", F.lit(0.0)), F.coalesce("ret", F.lit(0.0))
    df = signal.select("dti", "ii", sig.alias("s"), ret.alias("r")).withColumn("prev", F.lag("s").over(history())).withColumn("p", F.coalesce("prev", F.lit(0.0)))
    trade, gain = F.when(F.col("prev").isNotNull(), F.col("s") - F.col("p")).otherwise(0.0), F.col("p") * F.col("r")
    of = lambda when, x: F.sum(F.when(when, x).otherwise(0.0))
    cost = -buy_fee * of(trade > 0, trade) + sell_fee * of(trade < 0, trade)
    out = df.groupBy("dti").agg(
        F.count(F.when(F.col("s") > 0, 1)).alias("long_count"), F.count(F.when(F.col("s") < 0, 1)).alias("short_count"),
        of(F.col("s") > 0, F.col("s")).alias("long_val"), of(F.col("s") < 0, F.col("s")).alias("short_val"), F.sum(F.abs(trade)).alias("trade_val"),
        F.sum(gain).alias("gross"), of(F.col("p") > 0, gain).alias("long_pnl"), of(F.col("p") < 0, gain).alias("short_pnl"), cost.alias("tcost"),
        F.sum(F.col("p") * F.col("r")).alias("_xy"), F.sum(F.col("p") * F.col("p")).alias("_xx"), F.sum(F.col("r") * F.col("r")).alias("_yy"),
    )
    both = F.col("_xx") * F.col("_yy")
    out = out.withColumn("pnl", F.col("gross") + F.col("tcost")).withColumn("ic", F.when(both > 0, F.col("_xy") / F.sqrt(F.when(both > 0, both))))
    return out.withColumn("ret", F.col("pnl") / book).withColumn("tvr", F.col("trade_val") / book).drop("_xx", "_yy", "_xy")


def drawdown(days: DataFrame, value: str = "ret") -> DataFrame:
    """``days`` with dd, the running loss since the last high: the running sum less its largest value so far, 0 included.

    One row per date, so the single ordered window holds a calendar.
    """
    upto = Window.partitionBy(F.lit(0)).orderBy("dti").rowsBetween(Window.unboundedPreceding, 0)
    out = days.withColumn("_cum", F.sum(value).over(upto))
    return out.withColumn("dd", F.col("_cum") - F.greatest(F.lit(0.0), F.max("_cum").over(upto))).drop("_cum")


def summary(days: DataFrame, per_year: int = 12, book: float = 100000.0) -> DataFrame:
    """One row per period (column ``period``) and one for all (NULL): means, sums, ratio and deepest drawdown."""
    n = F.stddev_samp("ret")
    return drawdown(days).rollup("period").agg(
        F.count("*").alias("days"), F.avg("long_count").alias("long_count"), F.avg("short_count").alias("short_count"), F.sum("pnl").alias("pnl"), (F.avg("ret") * per_year).alias("ret_y"),
        F.avg("tvr").alias("tvr"), F.avg("ic").alias("ic"), F.when(n > 0, F.avg("ret") / F.when(n > 0, n)).alias("ir"), F.count(F.when(F.col("ret") > 0, 1)).alias("up_days"),
        F.count(F.when(F.col("ret") < 0, 1)).alias("down_days"), (F.min("dd") * 100).alias("max_dd"),
    )


def stats(days: DataFrame, per_year: int = 250) -> DataFrame:
    """Sharpe-like ratio on the population deviation, win rate, profit in basis points of trading, and Calmar ratio."""
    sd = F.stddev_pop("pnl")
    live = F.abs(F.col("pnl")) > 1e-15
    decided, traded = F.count(F.when(live, 1)), F.sum("trade_val")
    return drawdown(days, "pnl").agg(
        F.when(sd > 0, F.avg("pnl") / F.when(sd > 0, sd) * math.sqrt(per_year)).alias("ir"), (F.count(F.when(live & (F.col("pnl") > 0), 1)) / F.when(decided > 0, decided)).alias("win_rate"),
        (F.sum("pnl") / F.when(traded > 0, traded) * 10000).alias("pnl_bps"), (F.avg("pnl") * per_year).alias("pnl_y"), F.min("dd").alias("max_dd"), F.when(F.min("dd") < 0, F.avg("pnl") * per_year / -F.min("dd")).alias("calmar"),
    )


def forward_return(prices: DataFrame, days: int = 1, price: str = "price") -> DataFrame:
    """Return of holding from a date for ``days`` rows of a dense panel."""
    later = F.lead(price, days).over(history())
    return prices.withColumn("fret", F.when(F.col(price) != 0, later / F.when(F.col(price) != 0, F.col(price)) - 1))


def adjusted(prices: DataFrame) -> DataFrame:
    """Cumulative adjustment (1 on the first row), returns and adjusted prices from (dti, ii, close, vol, adj)."""
    factor = F.when(F.row_number().over(history()) == 1, 1.0).otherwise(F.coalesce("adj", F.lit(1.0)))
    out = prices.withColumn("_f", factor)
    out = out.withColumn("cumadj", F.product("_f").over(history().rowsBetween(Window.unboundedPreceding, 0)))
    before = F.lag("close").over(history())
    return out.withColumn("ret", F.when(before != 0, F.col("close") * F.col("_f") / F.when(before != 0, before) - 1)).withColumn("adj_close", F.col("close") * F.col("cumadj")).withColumn("adj_vol", F.col("vol") / F.when(F.col("cumadj") != 0, F.col("cumadj"))).drop("_f")


def combine(signals: list[DataFrame], weights: list[float], mean: bool = False) -> DataFrame:
    """Weighted sum of signals (dti, ii, value) over those a cell has, or their weighted mean; NULL where none has one."""
    df = None
    for k, (s, w) in enumerate(zip(signals, weights)):
        part = s.select("dti", "ii", (F.col("value") * w).alias("v"), F.when(F.col("value").isNotNull(), float(w)).alias("w"))
        df = part if df is None else df.unionByName(part)
    out = df.groupBy("dti", "ii").agg(F.sum("v").alias("value"), F.sum("w").alias("w"))
    return out.select("dti", "ii", (F.when(F.col("w") > 0, F.col("value") / F.when(F.col("w") > 0, F.col("w"))) if mean else F.col("value")).alias("value"))


def universe(panel: DataFrame, size: int, window: int, pass_rate: float, lookback: int, least_volume: float = 0.0) -> DataFrame:
    """(dti, ii, in_univ) from (dti, ii, dvol): each day's ``size`` largest by mean volume of the ``window`` days before, then those
    that passed on at least ``pass_rate`` of the last ``lookback`` days.  Ties go to the smaller ii."""
    mean = F.avg("dvol").over(history().rowsBetween(-window, -1))
    df = panel.withColumn("_m", mean)
    order = F.row_number().over(Window.partitionBy("dti").orderBy(F.col("_m").desc_nulls_last(), "ii"))
    df = df.withColumn("_pass", ((order <= size) & (F.col("_m") > least_volume)).cast("int"))
    rate = F.avg(F.coalesce("_pass", F.lit(0))).over(history().rowsBetween(1 - lookback, 0))
    return df.select("dti", "ii", (rate >= pass_rate).alias("in_univ"))


def bars(events: DataFrame, minutes: int = 5) -> DataFrame:
    """Tumbling bars of (ts, user_id, value): last, high, low and sum per bucket, and the day's running sum."""
    at = F.window("ts", f"{minutes} minutes").start.alias("bucket")
    out = events.groupBy("user_id", at).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"), F.max("value").alias("high"), F.min("value").alias("low"), F.sum("value").alias("total"), F.count("*").alias("n"))
    day = Window.partitionBy("user_id", F.to_date("bucket")).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("n_day", F.sum("n").over(day)).withColumn("high_day", F.max("high").over(day)).withColumn("low_day", F.min("low").over(day))


def hedged(days: DataFrame, panel: DataFrame, index: int, book: float) -> DataFrame:
    """(dti, hedge_ret): the longs' return less that of the instrument ``index``; 0 on the first date."""
    of = panel.where(F.col("ii") == index).select("dti", F.coalesce("ret", F.lit(0.0)).alias("_r"))
    first = F.row_number().over(Window.orderBy("dti")) == 1  # one row per date
    return days.join(of, "dti").select("dti", F.when(first, 0.0).otherwise(F.col("long_pnl") / book - F.col("_r")).alias("hedge_ret"))


def period_cosine(signal: DataFrame, per: int) -> DataFrame:
    """(period, cos): cosine of a date's signal with the next date's return over all cells of ``per`` dates, and of all dates (period NULL)."""
    later = F.lead("ret").over(history())
    df = signal.withColumn("_r", later).where("value is not null and _r is not null").withColumn("period", F.floor((F.col("dti") - 1) / per).cast("long"))
    both = F.sum(F.col("value") * F.col("value")) * F.sum(F.col("_r") * F.col("_r"))
    return df.rollup("period").agg(F.when(both > 0, F.sum(F.col("value") * F.col("_r")) / F.sqrt(F.when(both > 0, both))).alias("cos"))


def chunked(days: DataFrame, k: int, least: int = 3) -> DataFrame:
    """One row for every ``k`` dates: total, ratio on the population deviation and turnover; chunks that start with ``least`` dates or fewer left are left out."""
    # one row per date
    rows = days.withColumn("_n", F.row_number().over(Window.orderBy("dti")) - 1).withColumn("_all", F.count("*").over(Window.partitionBy(F.lit(0))))
    start = F.floor(F.col("_n") / k).cast("long")
    sd = F.stddev_pop("pnl")
    out = rows.where(F.col("_all") - start * k > least).groupBy(start.alias("chunk"))
    return out.agg(F.count("*").alias("days"), F.sum("pnl").alias("pnl"), F.when(sd > 0, F.avg("pnl") / F.when(sd > 0, sd)).alias("ir"), F.avg("tvr").alias("tvr"))


#: Presets: book, fee by the date from which it holds, and dates a year.
PRESETS = {"cn": (1e5, {20010101: 0.00065, 20240101: 0.0004}, 250), "crypto": (1.0, {0: 0.0002}, 365 * 24)}


def fee_on(steps: dict[int, float], at):
    """The fee that holds on a date: that of the last step at or before it."""
    fee = F.lit(0.0)
    for start, value in sorted(steps.items()):
        fee = F.when(at >= start, value).otherwise(fee)
    return fee


def intraday(signal: DataFrame, steps: dict[int, float], buckets: int) -> DataFrame:
    """One row per date of a signal by bucket (dti, ti, ii, value, ret): what a bucket holds earns the next one's return, across days too.

    Turnover counts the first bucket's position; counts and values are means over ``buckets``.
    """
    own = Window.partitionBy("ii").orderBy("dti", "ti")
    sig, ret = F.coalesce("value", F.lit(0.0)), F.coalesce("ret", F.lit(0.0))
    df = signal.select("dti", "ti", "ii", sig.alias("s"), ret.alias("r")).withColumn("p", F.coalesce(F.lag("s").over(own), F.lit(0.0)))
    s, p, r = F.col("s"), F.col("p"), F.col("r")
    out = df.groupBy("dti").agg(
        F.sum(F.abs(s - p)).alias("tvr"), F.sum(p * r).alias("gross"), F.sum(F.greatest(p, F.lit(0.0)) * r).alias("long_pnl"), F.sum(F.least(p, F.lit(0.0)) * r).alias("short_pnl"),
        (F.count(F.when(s > 0, 1)) / buckets).alias("long_count"), (F.count(F.when(s < 0, 1)) / buckets).alias("short_count"), (F.sum(F.greatest(s, F.lit(0.0))) / buckets).alias("long_val"), (F.sum(F.least(s, F.lit(0.0))) / buckets).alias("short_val"),
    )
    out = out.withColumn("tcost", -F.col("tvr") * fee_on(steps, F.col("dti")))
    return out.withColumn("pnl", F.col("gross") + F.col("tcost"))


def correlated(series: DataFrame, name: str, top: int) -> DataFrame:
    """(other, tag, corr): the stored daily series (name, tag, dti, value) most correlated with ``name``'s over common dates."""
    one = series.where(F.col("name") == name).select("dti", F.col("value").alias("_v"))
    out = series.where(F.col("name") != name).join(one, "dti").groupBy(F.col("name").alias("other"), "tag").agg(F.corr("value", "_v").alias("corr"))
    return out.orderBy(F.col("corr").desc_nulls_last(), "other").limit(top)


def chosen(summaries: DataFrame, condition: str) -> DataFrame:
    """Names whose yearly figures meet ``condition``: rows (name, period, pnl, ir) become columns pnl_<period>, ir_<period>, and pnl_all, ir_all."""
    period = F.coalesce(F.col("period").cast("string"), F.lit("all"))
    return summaries.withColumn("period", period).groupBy("name").pivot("period").agg(F.first("pnl").alias("pnl"), F.first("ir").alias("ir")).select("name", "*").transform(_renamed).where(condition)


def _renamed(wide: DataFrame) -> DataFrame:
    """<period>_<figure> as <figure>_<period>."""
    flip = {c: "_".join(reversed(c.rsplit("_", 1))) for c in wide.columns if c != "name"}
    return wide.select("name", *(F.col(c).alias(flip[c]) for c in flip))


def group_ic(signal: DataFrame, group: str) -> DataFrame:
    """One row: the cosine of value and ret over all rows, and the mean of the groups' cosines."""
    rows = signal.where("value is not null and ret is not null")
    x, y = F.col("value"), F.col("ret")
    each = rows.groupBy(group).agg(F.sum(x * y).alias("xy"), F.sum(x * x).alias("xx"), F.sum(y * y).alias("yy"))
    cosine = lambda xy, xx, yy: F.when(xx * yy > 0, xy / F.sqrt(F.when(xx * yy > 0, xx * yy)))
    return each.agg(cosine(F.sum("xy"), F.sum("xx"), F.sum("yy")).alias("ic"), F.avg(cosine(F.col("xy"), F.col("xx"), F.col("yy"))).alias("group_ic"))


def per_symbol(signal: DataFrame, fee: float, per_year: int) -> DataFrame:
    """One row per instrument: cosine, mean turnover, total and yearly profit, basis points, ratio and drawdown of its own signal, zero-filled after its first value."""
    back = history().rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce("value", F.when(F.count("value").over(back) > 0, 0.0))
    df = signal.select("dti", "ii", "ret", held.alias("s")).withColumn("p", F.lag("s").over(history()))
    df = df.withColumn("trade", F.abs(F.col("s") - F.col("p"))).withColumn("pnl", F.col("p") * F.col("ret") - F.col("trade") * fee).where("p is not null")
    df = df.withColumn("_cum", F.sum(F.coalesce("pnl", F.lit(0.0))).over(back)).withColumn("_dd", F.max("_cum").over(back) - F.col("_cum"))
    both, sd, traded = F.sum(F.when(F.col("ret").isNotNull(), F.col("p") * F.col("p"))) * F.sum(F.col("ret") * F.col("ret")), F.stddev_pop("pnl"), F.sum("trade")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return df.groupBy("ii").agg(
        zero(F.when(both > 0, F.sum(F.col("p") * F.col("ret")) / F.sqrt(F.when(both > 0, both)))).alias("cos"), zero(F.avg("trade")).alias("tvr"), zero(F.sum("pnl")).alias("total_pnl"), zero(F.avg("pnl") * per_year).alias("yearly_pnl"),
        zero(F.when(traded > 0, F.sum("pnl") / F.when(traded > 0, traded) * 10000)).alias("pnl_bps"), zero(F.when(sd > 1e-20, F.avg("pnl") / F.when(sd > 1e-20, sd) * per_year**0.5)).alias("ir"), F.max("_dd").alias("dd"),
    )


def portfolio(signal: DataFrame, fee: float, per_year: int) -> DataFrame:
    """One row for all instruments together, as ``per_symbol`` takes them: turnover, total and yearly profit, ratio, basis points, drawdown, Calmar ratio and win rate.

    A date without any position counts with no profit; the first date earns nothing
    and is left out.  The turnover is the sum of the instruments' mean ones.
    """
    back = history().rowsBetween(Window.unboundedPreceding, 0)
    held = F.coalesce("value", F.when(F.count("value").over(back) > 0, 0.0))
    df = signal.select("dti", "ii", "ret", held.alias("s")).withColumn("p", F.lag("s").over(history()))
    df = df.withColumn("trade", F.abs(F.col("s") - F.col("p"))).withColumn("gain", F.col("p") * F.col("ret") - F.col("trade") * fee)
    each = df.groupBy("ii").agg(F.coalesce(F.avg("trade"), F.lit(0.0)).alias("tvr")).agg(F.sum("tvr").alias("tvr"))
    # one row a date from here on
    line = Window.partitionBy(F.lit(0)).orderBy("dti")
    days = df.groupBy("dti").agg(F.sum(F.coalesce("gain", F.lit(0.0))).alias("pnl")).withColumn("k", F.row_number().over(line)).where("k > 1")
    days = days.withColumn("_cum", F.sum("pnl").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    days = days.withColumn("_dd", F.max("_cum").over(line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_cum"))
    live = F.abs(F.col("pnl")) > 1e-15
    sums = days.agg(F.sum("pnl").alias("total_pnl"), (F.avg("pnl") * per_year).alias("yearly_pnl"), F.avg("pnl").alias("_mean"), F.stddev_pop("pnl").alias("_sd"), F.max("_dd").alias("dd"), F.count(F.when(F.col("pnl") > 1e-15, 1)).alias("_won"), F.count(F.when(live, 1)).alias("_live"))
    out = sums.join(each, how="cross")
    safe = lambda a, b: F.coalesce(F.when(F.col(b) > 0, F.col(a) / F.when(F.col(b) > 0, F.col(b))), F.lit(0.0))
    ir = F.when(F.col("_sd") > 0, F.col("_mean") / F.when(F.col("_sd") > 0, F.col("_sd")) * per_year**0.5)
    return out.select("tvr", "total_pnl", "yearly_pnl", ir.alias("ir"), (safe("_mean", "tvr") * 10000).alias("pnl_bps"), "dd", safe("yearly_pnl", "dd").alias("calmar_ratio"), safe("_won", "_live").alias("win_rate"))


def allocated(signals: list[DataFrame], weights: list[float]) -> DataFrame:
    """The weighted sum of signals by their shares of all weights; NULL where all are missing."""
    total = sum(weights)
    return combine(signals, [w / total for w in weights], mean=False)
