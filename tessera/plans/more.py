"""Further registered queries: restarting functions, reductions, market panels, universes, profits and training rows, with their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import resetting
from ..operators import chain, market, pnl, prep, reduce
from ..sources.panel import supplier_panel, supplier_quotes
from . import catalog as base

QUOTES = """qcells AS (SELECT CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS INTEGER) AS dti, l_suppkey AS ii,
        arg_max(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 / l_quantity / 1.0123457::DOUBLE, (l_shipdate, l_orderkey, l_linenumber, l_partkey)) AS close,
        max(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 / l_quantity / 1.0123457::DOUBLE) AS high, min(CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS DOUBLE) / 100 / l_quantity / 1.0123457::DOUBLE) AS low,
        CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS vol, CAST(sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS DOUBLE) / 101.23457::DOUBLE AS dvol FROM lineitem GROUP BY ALL),
    quotes AS (SELECT d.dti, s.s_suppkey AS ii, CASE WHEN s_nationkey < 3 THEN -1 ELSE s_nationkey % 5 END AS g, close, high, low, vol, dvol,
        CAST(10 + s.s_suppkey % 7 AS DOUBLE) / 10.123457::DOUBLE AS shares, CASE WHEN (d.dti + s.s_suppkey) % 24 = 0 THEN 2.0::DOUBLE END AS adj, d.dti >= 1 + s.s_suppkey % 5 AS listed,
        CASE WHEN (d.dti + s.s_suppkey) % 17 = 0 THEN 1 WHEN (d.dti + s.s_suppkey) % 5 <> 0 THEN 0 END AS st
        FROM (SELECT DISTINCT dti FROM qcells) d CROSS JOIN supplier s LEFT JOIN qcells c ON c.dti = d.dti AND c.ii = s.s_suppkey)"""
BASE = """base AS (SELECT dti, ii, g, close, high, low, vol, dvol, st, coalesce(dvol / nullif(vol, 0), 0) AS vwap, shares * lag(close) OVER o AS cap, coalesce(adj, 1) AS adj, coalesce(vol, 0) <= 0 AS halt,
        lag(close) OVER o * 1.1::DOUBLE AS limit_up, lag(close) OVER o * 0.9::DOUBLE AS limit_down, listed AND NOT coalesce(vol, 0) <= 0 AS univ_all FROM quotes WINDOW o AS (PARTITION BY ii ORDER BY dti))"""
ADJ = """adjf AS (SELECT *, CASE WHEN row_number() OVER o = 1 THEN 1 ELSE adj END AS f FROM base WINDOW o AS (PARTITION BY ii ORDER BY dti)),
    adjusted AS (SELECT *, product(f) OVER (o ROWS UNBOUNDED PRECEDING) AS cumadj, close * f / nullif(lag(close) OVER o, 0) - 1 AS ret,
        close * product(f) OVER (o ROWS UNBOUNDED PRECEDING) AS adj_close, vol / product(f) OVER (o ROWS UNBOUNDED PRECEDING) AS adj_vol FROM adjf WINDOW o AS (PARTITION BY ii ORDER BY dti))"""
BARS = """ticks AS (SELECT user_id AS ii, CAST(date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS INTEGER) AS dti, CAST((hour(ts) * 60 + minute(ts)) // 30 AS INTEGER) AS ti, (ts, event_id) AS seen, value / 1.0123457::DOUBLE AS price, CAST(event_id % 7 + 1 AS DOUBLE) AS vol FROM events),
    got AS (SELECT ii, dti, ti, arg_max(price, seen) AS last, max(price) AS high, min(price) AS low, sum(vol) AS vol, sum(price * vol) AS dvol FROM ticks GROUP BY ii, dti, ti),
    grid AS (SELECT ii, dti, CAST(unnest(range(min(ti), max(ti) + 1)) AS INTEGER) AS ti FROM got GROUP BY ii, dti),
    bars AS (SELECT ii, dti, ti, last_value(last IGNORE NULLS) OVER d AS last, high, low, coalesce(vol, 0) AS vol, coalesce(dvol, 0) AS dvol, sum(coalesce(vol, 0)) OVER d AS cumvol, sum(coalesce(dvol, 0)) OVER d AS cumdvol
        FROM grid LEFT JOIN got USING (ii, dti, ti) WINDOW d AS (PARTITION BY ii, dti ORDER BY ti ROWS UNBOUNDED PRECEDING))"""
PLACES = base.PLACES


def _panel(spark, sf):
    return supplier_panel(spark, sf)


def _base(spark, sf):
    quotes = supplier_quotes(spark, sf)
    return market.base_panel(quotes).join(quotes.select("dti", "ii", "g", "st"), ["dti", "ii"])


def _adjusted(spark, sf):
    return pnl.adjusted(_base(spark, sf))


def _bars(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    ticks = events.select(F.col("user_id").alias("ii"), F.datediff(F.to_date("ts"), F.lit("1970-01-01")).alias("dti"), F.floor((F.hour("ts") * 60 + F.minute("ts")) / 30).cast("int").alias("ti"), F.struct("ts", "event_id").alias("at"), (F.col("value") / 1.0123457).alias("price"), (F.col("event_id") % 7 + 1).cast("double").alias("vol"))
    return market.intraday_bars(ticks)


def _shown(df: DataFrame) -> DataFrame:
    return base._rounded(df)


def _r(*names: str) -> str:
    return ", ".join(f"round({c}, {PLACES}) + 0.0 AS {c}" for c in names)


FOUND: dict = {}


def query(name: str, sql: str | None):
    """Registers a query (spark, sf_dir) -> DataFrame, its doubles rounded, under a name with its SQL."""

    def put(make):
        FOUND[name] = (lambda spark, sf, make=make: _shown(make(spark, sf)), sql)
        return make

    return put


# --- functions that a missing cell starts again
def _reset_sql(value: str, rows: int, two: bool = False) -> str:
    gap = "x IS NULL OR y IS NULL" if two else "x IS NULL"
    return f"""WITH {base.PANEL}, gaps AS (SELECT dti, ii, x, y, {gap} AS brk FROM panel), runs AS (SELECT *, count(*) FILTER (brk) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) AS run FROM gaps),
        framed AS (SELECT *, list(x) OVER f AS l, list(y) OVER f AS m FROM runs WINDOW f AS (PARTITION BY ii, run, brk ORDER BY dti ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW))
        SELECT dti, ii, round(CAST(CASE WHEN NOT brk THEN {value} END AS DOUBLE), {PLACES}) + 0.0 AS value FROM framed"""


def _plain_sql(value: str, more: str = "", source: str = "panel") -> str:
    return f"WITH {base.PANEL}{more} SELECT dti, ii, round(CAST({value} AS DOUBLE), {PLACES}) + 0.0 AS value FROM {source}"


for _name, (_n, _build) in resetting.TRAILING.items():
    _inputs, _scalars = ["x", "y"][:_n], (0.3,) if _name == "ts_ema" else ()
    _value = base.SERIES[_name][3]
    FOUND[f"reset_{_name}"] = (
        lambda spark, sf, b=_build, i=_inputs, s=_scalars: _shown(resetting.trailing(_panel(spark, sf), b, i, 6, *s).select("dti", "ii", "value")),
        _reset_sql(_value, 6, _n == 2),
    )

_I = "panel WINDOW w AS (PARTITION BY ii ORDER BY dti)"
_PLAIN = {
    "ts_std_welford": (lambda p: resetting.over_valid(p, "x", 6), _plain_sql("CASE WHEN x IS NOT NULL THEN stddev_pop(x) OVER (PARTITION BY ii, x IS NOT NULL ORDER BY dti ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) END")),
    "ts_forwardfill": (lambda p: resetting.forward_filled(p, "x", 1), _plain_sql("coalesce(x, lag(x) OVER w)", "", _I)),
    "ts_interpolate": (lambda p: resetting.interpolated(p, "x", 1), _plain_sql("coalesce(x, (lag(x) OVER w + lead(x) OVER w) / 2)", "", _I)),
    "ts_forwardfill_mean": (
        lambda p: resetting.filled_with_mean(p, "x", 4),
        _plain_sql("coalesce(x, coalesce(list_sum(list_filter(l, lambda e: e IS NOT NULL)[-4:]), 0) / 4)", ", f AS (SELECT *, list(x) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) AS l FROM panel)", "f"),
    ),
    "ts_ffillna": (lambda p: resetting.zero_filled(p, "x"), _plain_sql("coalesce(x, CASE WHEN count(x) OVER (w ROWS UNBOUNDED PRECEDING) > 0 THEN 0 END)", "", _I)),
    "c_rank": (lambda p: resetting.ranked(p, "x"), _plain_sql("CASE WHEN count(x) OVER w > 1 THEN " + base._RANK.replace("{keys}", "dti") + " END", "", "panel WINDOW w AS (PARTITION BY dti)")),
    "c_scale": (lambda p: resetting.scaled(p, "x"), _plain_sql("coalesce(x, 0) / nullif(sum(abs(x)) OVER w, 0)", "", "panel WINDOW w AS (PARTITION BY dti)")),
    "c_demean": (lambda p: resetting.demeaned(p, "x"), _plain_sql("x - avg(x) OVER w", "", "panel WINDOW w AS (PARTITION BY dti)")),
    "g_demean": (lambda p: resetting.demeaned(p, "x", "g"), _plain_sql("x - avg(x) OVER w", "", "panel WINDOW w AS (PARTITION BY dti, g)")),
    "a_filter": (lambda p: p.withColumn("value", resetting.CELLS["a_filter"](F.col("x"), F.col("y"))), _plain_sql("CASE WHEN y > 0.5 THEN x END")),
    "a_mask": (lambda p: p.withColumn("value", resetting.CELLS["a_mask"](F.col("x"), (F.col("y") > 0).cast("int"))), _plain_sql("CASE WHEN y > 0 THEN x END")),
    "a_min": (lambda p: p.withColumn("value", resetting.CELLS["a_min"](F.col("x"), F.col("y"))), _plain_sql("least(x, y)")),
    "a_max": (lambda p: p.withColumn("value", resetting.CELLS["a_max"](F.col("x"), F.col("y"))), _plain_sql("greatest(x, y)")),
    "log": (lambda p: p.withColumn("value", resetting.CELLS["log"](F.col("x"))), _plain_sql("CASE WHEN x >= 1e-20 THEN ln(x) END")),
}
for _name, (_make, _sql) in _PLAIN.items():
    FOUND[f"reset_{_name}"] = (lambda spark, sf, m=_make: _shown(m(_panel(spark, sf)).select("dti", "ii", "value")), _sql)


# --- reductions and fills
@query("date_reductions", f"""WITH {base.PANEL}, f AS (SELECT dti, x, y, CAST(g AS DOUBLE) AS c, CASE WHEN y IS NOT NULL THEN x END AS a, CASE WHEN x IS NOT NULL THEN y END AS b FROM panel),
    d AS (SELECT *, a - avg(a) OVER w AS da, b - avg(b) OVER w AS db FROM f WINDOW w AS (PARTITION BY dti)),
    s AS (SELECT dti, avg(x) AS mean, coalesce(sum(x), 0) AS sum, var_pop(x) AS var, stddev_pop(x) AS std, coalesce(sum(x * c), 0) AS wsum, sum(x * c) / nullif(sum(c) FILTER (x IS NOT NULL), 0) AS wmean,
        CASE WHEN count(da) > 1 AND sum(da * da * c) * sum(db * db * c) > 0 THEN sum(da * db * c) / sqrt(sum(da * da * c) * sum(db * db * c)) END AS wcorr, coalesce(sum(x * y), 0) AS dot, coalesce(sum(x * x), 0) AS squared_norm, sqrt(coalesce(sum(x * x), 0)) AS norm FROM d GROUP BY dti)
    SELECT dti, {_r("mean", "sum", "var", "std", "wsum", "wmean", "wcorr", "dot", "squared_norm", "norm")} FROM s""")
def date_reductions(spark, sf):
    return reduce.by_date(_panel(spark, sf), "x", "y", "g")


@query("panel_fills", f"""WITH {base.PANEL}, t AS (SELECT dti, ii, x, dti AS k FROM panel), b AS (SELECT *, lag(x) OVER w AS shifted, last_value(x IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS ffill,
        last_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER (w ROWS UNBOUNDED PRECEDING) AS t0, first_value(x IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS x1,
        first_value(CASE WHEN x IS NOT NULL THEN k END IGNORE NULLS) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM t WINDOW w AS (PARTITION BY ii ORDER BY dti)),
    l AS (SELECT dti, ii, shifted, ffill, coalesce(x, ffill + (x1 - ffill) * (k - t0) / nullif(t1 - t0, 0)) AS linear_fill FROM b) SELECT dti, ii, {_r("shifted", "ffill", "linear_fill")} FROM l""")
def panel_fills(spark, sf):
    return reduce.fills(_panel(spark, sf), "x")


# --- market panels
@query("base_panel", f"""WITH {QUOTES}, {BASE} SELECT dti, ii, {_r("close", "high", "low", "vol", "dvol", "vwap", "cap", "adj", "limit_up", "limit_down")}, CAST(halt AS INTEGER) AS halt, CAST(univ_all AS INTEGER) AS univ_all FROM base""")
def base_panel(spark, sf):
    return _base(spark, sf).drop("g", "st").withColumn("halt", F.col("halt").cast("int")).withColumn("univ_all", F.col("univ_all").cast("int"))


@query("adjusted_prices", f"WITH {QUOTES}, {BASE}, {ADJ} SELECT dti, ii, {_r('cumadj', 'ret', 'adj_close', 'adj_vol')} FROM adjusted")
def adjusted_prices(spark, sf):
    return _adjusted(spark, sf).select("dti", "ii", "cumadj", "ret", "adj_close", "adj_vol")


@query("forward_return", f"WITH {QUOTES}, {BASE}, {ADJ} SELECT dti, ii, round(lead(adj_close, 3) OVER o / nullif(adj_close, 0) - 1, {PLACES}) + 0.0 AS fret FROM adjusted WINDOW o AS (PARTITION BY ii ORDER BY dti)")
def forward_return(spark, sf):
    return pnl.forward_return(_adjusted(spark, sf), 3, "adj_close").select("dti", "ii", "fret")


_AHEAD = f"WITH {QUOTES}, {BASE}, {ADJ}, a AS (SELECT *, lead(adj_close, 3) OVER o / nullif(adj_close, 0) - 1 AS raw, lead(close, 3) OVER o / nullif(close, 0) - 1 AS h, lag(close) OVER o AS pclose FROM adjusted WINDOW o AS (PARTITION BY ii ORDER BY dti))"


@query("forward_return_hedged", f"{_AHEAD}, f AS (SELECT dti, ii, raw - max(CASE WHEN ii = 3 THEN h END) OVER (PARTITION BY dti) AS fret FROM a) SELECT dti, ii, {_r('fret')} FROM f")
def forward_return_hedged(spark, sf):
    return market.hedged_forward_return(_adjusted(spark, sf), 3, 3)


@query("forward_return_limits", f"{_AHEAD}, f AS (SELECT dti, ii, CASE WHEN NOT coalesce(close > limit_up - 1e-3 OR close < limit_down + 1e-3, false) THEN CASE WHEN raw IS NOT NULL THEN greatest(least(raw, 0.05), -0.05) END END AS fret FROM a) SELECT dti, ii, {_r('fret')} FROM f")
def forward_return_limits(spark, sf):
    return market.hedged_forward_return(_adjusted(spark, sf), 3, None, True, 1.0, 0.05)


@query("forward_return_quantile", f"{_AHEAD}, f AS (SELECT dti, ii, CASE WHEN NOT coalesce(ret > (limit_up * adj / nullif(pclose, 0) - 1) * 0.5 OR ret < (limit_down * adj / nullif(pclose, 0) - 1) * 0.5, false) THEN CASE WHEN raw IS NOT NULL THEN greatest(least(raw, 10), -10) END END AS fret FROM a) SELECT dti, ii, {_r('fret')} FROM f")
def forward_return_quantile(spark, sf):
    return market.hedged_forward_return(_adjusted(spark, sf), 3, None, True, 0.5)


_SCREEN = f"""WITH {QUOTES}, {BASE}, m AS (SELECT *, row_number() OVER o AS t, avg(close * vol) OVER (o ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS m, lag(close) OVER o AS pc, lag(cap) OVER o AS pcap FROM base WINDOW o AS (PARTITION BY ii ORDER BY dti)),
    s AS (SELECT *, coalesce(univ_all AND coalesce(st, 0) = 0 AND pcap >= 900 AND pc >= 900 AND pc <= 1900 AND m >= 1000, false) AS fits FROM m),
    c AS (SELECT *, CASE WHEN fits AND row_number() OVER (PARTITION BY dti, fits ORDER BY m DESC, ii) <= 30 THEN 1 ELSE 0 END AS cand FROM s),
    p AS (SELECT *, univ_all AND sum(cand) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) / least(t, 6) * 100 >= 30 AS passed FROM c),
    u AS (SELECT dti, ii, CAST(passed AS INTEGER) AS passed, CAST(univ_all AND max(CAST(passed AS INTEGER)) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) = 1 AS INTEGER) AS in_univ FROM p)"""


def _screened(spark, sf):
    return market.screened_universe(_base(spark, sf), 30, 4, 6, 30.0, 2, 900.0, 900.0, 1900.0, 1000.0)


@query("universe_screened", f"{_SCREEN} SELECT dti, ii, passed, in_univ FROM u")
def universe_screened(spark, sf):
    return _screened(spark, sf).withColumn("passed", F.col("passed").cast("int")).withColumn("in_univ", F.col("in_univ").cast("int"))


_FLAG = f"flag AS (SELECT dti, ii, coalesce(last_value(st IGNORE NULLS) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) = 1, false) AS st FROM quotes)"


@query("universe_flag", f"WITH {QUOTES}, {_FLAG} SELECT dti, ii, CAST(st AS INTEGER) AS value FROM flag")
def universe_flag(spark, sf):
    return market.carried_flag(supplier_quotes(spark, sf), "st").withColumn("value", F.col("value").cast("int"))


@query("universe_merged", f"WITH {QUOTES}, {BASE}, {_FLAG} SELECT dti, ii, CAST((univ_all OR vol > 300) AND coalesce(high > 1000, false) AND NOT flag.st AS INTEGER) AS value FROM base JOIN flag USING (dti, ii)")
def universe_merged(spark, sf):
    df = _base(spark, sf)
    flag = market.carried_flag(df, "st").withColumnRenamed("value", "flag")
    df = df.join(flag, ["dti", "ii"]).withColumn("busy", F.col("vol") > 300).withColumn("dear", F.col("high") > 1000)
    return market.merged_universe(df, ["univ_all", "busy"], ["dear"], ["flag"]).withColumn("value", F.col("value").cast("int"))


_SETS = f"WITH {QUOTES}, {BASE}, a AS (SELECT dti, ii FROM base WHERE univ_all), b AS (SELECT dti, ii FROM base WHERE vol > 30)"


def _two(spark, sf):
    df = _base(spark, sf)
    return df.where("univ_all").select("dti", "ii"), df.where("vol > 30").select("dti", "ii")


@query("universe_union", f"{_SETS} SELECT * FROM a UNION SELECT * FROM b")
def universe_union(spark, sf):
    a, b = _two(spark, sf)
    return a.union(b).distinct()


@query("universe_intersect", f"{_SETS} SELECT * FROM a INTERSECT SELECT * FROM b")
def universe_intersect(spark, sf):
    a, b = _two(spark, sf)
    return a.intersect(b)


@query("universe_except", f"{_SETS} SELECT * FROM a EXCEPT SELECT * FROM b")
def universe_except(spark, sf):
    a, b = _two(spark, sf)
    return a.subtract(b)


@query("rows_in_universe", f"{_SCREEN} SELECT q.dti, q.ii, round(q.close, {PLACES}) + 0.0 AS close FROM quotes q SEMI JOIN (SELECT * FROM u WHERE in_univ = 1) v ON q.dti = v.dti AND q.ii = v.ii")
def rows_in_universe(spark, sf):
    return supplier_quotes(spark, sf).select("dti", "ii", "close").join(_screened(spark, sf).where("in_univ"), ["dti", "ii"], "left_semi")


@query("rows_outside_universe", f"{_SCREEN} SELECT q.dti, q.ii, round(q.close, {PLACES}) + 0.0 AS close FROM quotes q ANTI JOIN (SELECT * FROM u WHERE in_univ = 1) v ON q.dti = v.dti AND q.ii = v.ii")
def rows_outside_universe(spark, sf):
    return supplier_quotes(spark, sf).select("dti", "ii", "close").join(_screened(spark, sf).where("in_univ"), ["dti", "ii"], "left_anti")


@query("index_weights", f"""WITH {QUOTES}, pub AS (SELECT dti, ii, vol / sum(vol) OVER (PARTITION BY dti) AS weight FROM quotes WHERE dti % 3 = 1 AND vol IS NOT NULL), d AS (SELECT q.dti, max(p.dti) AS published FROM (SELECT DISTINCT dti FROM quotes) q JOIN (SELECT DISTINCT dti FROM pub) p ON p.dti <= q.dti GROUP BY q.dti)
    SELECT d.dti, ii, {_r("weight")} FROM d JOIN pub ON pub.dti = d.published""")
def index_weights(spark, sf):
    quotes = supplier_quotes(spark, sf)
    return market.index_membership(quotes.where("dti % 3 = 1 and vol is not null").select("dti", "ii", F.col("vol").alias("weight")), quotes)


@query("asof_quotes", f"WITH {QUOTES} SELECT l.dti, l.ii, round(r.close, {PLACES}) + 0.0 AS close, round(r.vol, {PLACES}) + 0.0 AS vol FROM quotes l ASOF LEFT JOIN (SELECT dti, ii, close, vol FROM quotes WHERE dti % 3 = 0 AND close IS NOT NULL) r ON l.ii = r.ii AND l.dti >= r.dti")
def asof_quotes(spark, sf):
    quotes = supplier_quotes(spark, sf)
    return market.asof(quotes.select("dti", "ii"), quotes.where("dti % 3 = 0 and close is not null"), "ii", "dti", ["close", "vol"])


@query("listed_dates", f"WITH {QUOTES}, i AS (SELECT s_suppkey AS ii, CAST(1 + s_suppkey % 40 AS INTEGER) AS a, CASE WHEN s_suppkey % 3 > 0 THEN CAST(30 + s_suppkey % 50 AS INTEGER) END AS b FROM supplier) SELECT d.dti AS dt, ii FROM (SELECT DISTINCT dti FROM qcells) d JOIN i ON d.dti >= a AND d.dti < coalesce(b, 99999999)")
def listed_dates(spark, sf):
    from ..sources.panel import listing

    found = spark.read.parquet(f"{sf}/supplier.parquet").select(F.col("s_suppkey").alias("ii"), (1 + F.col("s_suppkey") % 40).cast("int").alias("list"), F.when(F.col("s_suppkey") % 3 > 0, (30 + F.col("s_suppkey") % 50).cast("int")).alias("delist"))
    return listing(found, supplier_quotes(spark, sf).select(F.col("dti").alias("dt")).distinct())


# --- intraday
_BAR = ("last", "high", "low", "vol", "dvol", "cumvol", "cumdvol", "vwap", "cumvwap")


@query("bars_intraday", f"WITH {BARS}, v AS (SELECT *, dvol / nullif(vol, 0) AS vwap, cumdvol / nullif(cumvol, 0) AS cumvwap FROM bars) SELECT ii, dti, ti, {_r(*_BAR)} FROM v")
def bars_intraday(spark, sf):
    return _bars(spark, sf)


@query("bucket_return", f"WITH {BARS} SELECT ii, dti, ti, round((1 - lag(last) OVER (PARTITION BY ii ORDER BY dti, ti) / nullif(last, 0)) / 1.0123457::DOUBLE, {PLACES}) + 0.0 AS ret FROM bars")
def bucket_return(spark, sf):
    return market.bucket_return(_bars(spark, sf)).withColumn("ret", F.col("ret") / 1.0123457)


@query("cut_day", f"""WITH {BARS}, c AS (SELECT ii, dti, arg_max(last, ti) FILTER (ti <= 25 AND last IS NOT NULL) AS last, max(high) FILTER (ti <= 25) AS high, min(low) FILTER (ti <= 25) AS low, coalesce(arg_max(cumvol, ti) FILTER (ti <= 25), 0) AS cumvol, coalesce(arg_max(cumdvol, ti) FILTER (ti <= 25), 0) AS cumdvol,
        arg_max(cumdvol / nullif(cumvol, 0), ti) FILTER (ti <= 25 AND cumvol <> 0) AS cumvwap, sum(dvol) FILTER (ti > 26) / nullif(sum(vol) FILTER (ti > 26), 0) AS vwap_tail FROM bars GROUP BY ii, dti),
    r AS (SELECT *, (last / nullif(lag(last) OVER o, 0) - 1) / 1.0123457::DOUBLE AS ret_cut, (vwap_tail / nullif(lag(vwap_tail) OVER o, 0) - 1) / 1.0123457::DOUBLE AS ret_tail FROM c WINDOW o AS (PARTITION BY ii ORDER BY dti))
    SELECT ii, dti, {_r("last", "high", "low", "cumvol", "cumdvol", "cumvwap", "vwap_tail", "ret_cut", "ret_tail")} FROM r""")
def cut_day(spark, sf):
    # scaled, as ratios of such values end in a rounded 5 now and then
    return market.cut_day(_bars(spark, sf), 25).withColumns({c: F.col(c) / 1.0123457 for c in ("ret_cut", "ret_tail")})


# --- signals
@query("combined_zero_filled", f"WITH {base.PANEL} SELECT dti, ii, round((coalesce(x, 0) * 2 + coalesce(y, 0)) / 3, {PLACES}) + 0.0 AS value FROM panel")
def combined_zero_filled(spark, sf):
    panel = _panel(spark, sf)
    return market.average_signal([panel.select("dti", "ii", F.col(c).alias("value")) for c in ("x", "y")], [2.0, 1.0])


@query("late_mean_alpha", f"""WITH {base.PANEL}, m AS (SELECT dti, ii, avg(ret) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS m FROM panel), l AS (SELECT dti, ii, lag(m, 5) OVER (PARTITION BY ii ORDER BY dti) AS m FROM m),
    d AS (SELECT dti, ii, m - avg(m) OVER (PARTITION BY dti) AS d FROM l) SELECT dti, ii, round(d * 100 / nullif(sum(abs(d)) OVER (PARTITION BY dti), 0), {PLACES}) + 0.0 AS value FROM d""")
def late_mean_alpha(spark, sf):
    return market.late_mean_alpha(_panel(spark, sf), "ret", 5, 100.0)


@query("market_table", f"""WITH {QUOTES}, {BASE}, {ADJ}, t AS (SELECT dti, g, sum(dvol) AS dvol, avg((high - low) / nullif(close, 0)) AS range, avg(ret) AS ret, avg(abs(ret)) AS size FROM adjusted GROUP BY dti, g),
    r AS (SELECT *, dvol / nullif(avg(dvol) OVER (o ROWS BETWEEN 1 PRECEDING AND 1 PRECEDING), 0) AS to_1, dvol / nullif(avg(dvol) OVER (o ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0) AS to_5, dvol / nullif(avg(dvol) OVER (o ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), 0) AS to_20 FROM t WINDOW o AS (PARTITION BY g ORDER BY dti))
    SELECT dti, g, {_r("dvol", "range", "ret", "size", "to_1", "to_5", "to_20")} FROM r""")
def market_table(spark, sf):
    return market.market_table(_adjusted(spark, sf), "g")


# --- profit and loss
_DAYS = f"WITH {base.PANEL}, {base._HELD}"


@query("pnl_hedge", f"{_DAYS}, h AS (SELECT d.dti, CASE WHEN row_number() OVER (ORDER BY d.dti) = 1 THEN 0 ELSE long_pnl / 1000 - coalesce(p.ret, 0) END AS hedge_ret FROM full_days d JOIN panel p ON p.dti = d.dti AND p.ii = 3) SELECT dti, {_r('hedge_ret')} FROM h")
def pnl_hedge(spark, sf):
    return pnl.hedged(base._days(spark, sf), _panel(spark, sf), 3, 1000.0)


@query("pnl_cosine", f"""{_DAYS}, n AS (SELECT dti, s, lead(r0) OVER (PARTITION BY ii ORDER BY dti) AS r FROM (SELECT dti, ii, s, r AS r0 FROM held)), p AS (SELECT CAST((dti - 1) // 12 AS BIGINT) AS period, s, r FROM n WHERE r IS NOT NULL),
    c AS (SELECT period, sum(s * r) / nullif(sqrt(sum(s * s) * sum(r * r)), 0) AS cos FROM p GROUP BY ROLLUP (period)) SELECT period, {_r("cos")} FROM c""")
def pnl_cosine(spark, sf):
    return pnl.period_cosine(base._held(spark, sf), 12)


@query("pnl_chunks", f"""{_DAYS}, n AS (SELECT *, row_number() OVER (ORDER BY dti) - 1 AS n, count(*) OVER () AS every FROM full_days),
    c AS (SELECT CAST(n // 9 AS BIGINT) AS chunk, count(*) AS days, sum(pnl) AS pnl, avg(pnl) / nullif(stddev_pop(pnl), 0) AS ir, avg(tvr) AS tvr FROM n WHERE every - n // 9 * 9 > 3 GROUP BY n // 9) SELECT chunk, days, {_r("pnl", "ir", "tvr")} FROM c""")
def pnl_chunks(spark, sf):
    return pnl.chunked(base._days(spark, sf), 9)


@query("pnl_intraday", f"""WITH {base.PANEL}, s AS (SELECT CAST((dti - 1) // 4 AS INTEGER) AS dti, CAST((dti - 1) % 4 AS INTEGER) AS ti, ii, coalesce(x, 0) AS s, coalesce(ret, 0) AS r FROM panel), p AS (SELECT *, coalesce(lag(s) OVER (PARTITION BY ii ORDER BY dti, ti), 0) AS p FROM s),
    d AS (SELECT dti, sum(abs(s - p)) AS tvr, sum(p * r) AS gross, sum(greatest(p, 0) * r) AS long_pnl, sum(least(p, 0) * r) AS short_pnl, count(*) FILTER (s > 0) / 4 AS long_count, count(*) FILTER (s < 0) / 4 AS short_count, sum(greatest(s, 0)) / 4 AS long_val, sum(least(s, 0)) / 4 AS short_val FROM p GROUP BY dti),
    f AS (SELECT *, -tvr * CASE WHEN dti >= 12 THEN 0.0004::DOUBLE ELSE 0.00065::DOUBLE END AS tcost FROM d), g AS (SELECT *, gross + tcost AS pnl FROM f) SELECT dti, {_r("tvr", "gross", "long_pnl", "short_pnl", "long_count", "short_count", "long_val", "short_val", "tcost", "pnl")} FROM g""")
def pnl_intraday(spark, sf):
    df = _panel(spark, sf).select(F.floor((F.col("dti") - 1) / 4).cast("int").alias("dti"), ((F.col("dti") - 1) % 4).cast("int").alias("ti"), "ii", F.col("x").alias("value"), "ret")
    return pnl.intraday(df, {0: 0.00065, 12: 0.0004}, 4)


_ALPHAS = "x", "y"


def _ics(spark, sf):
    """The daily cosine of some signals with the returns, as a registry of series would store them."""
    values = {"x": F.col("x"), "y": F.col("y"), "xy": F.col("x") * F.col("y"), "size": F.abs("x")}
    days = _panel(spark, sf).groupBy("dti").agg(*(F.sum(v * F.col("ret")).alias(k) for k, v in values.items()))
    return days.unpivot("dti", list(values), "name", "value").select("name", F.concat(F.lit("tag_"), "name").alias("tag"), "dti", "value")


_STORED = ", ".join(f"('{n}', {e})" for n, e in (("x", "0"), ("y", "1"), ("xy", "2"), ("size", "3")))


@query("signal_correlation", f"""WITH {base.PANEL}, s AS (SELECT k.name, 'tag_' || k.name AS tag, dti, sum(CASE k.e WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN x * y ELSE abs(x) END * ret) AS value FROM panel CROSS JOIN (VALUES {_STORED}) k(name, e) GROUP BY ALL)
    SELECT o.name AS other, o.tag, round(corr(o.value, m.value), {PLACES}) + 0.0 AS corr FROM s o JOIN s m ON m.name = 'x' AND o.name <> 'x' AND o.dti = m.dti GROUP BY ALL ORDER BY corr DESC, other LIMIT 2""")
def signal_correlation(spark, sf):
    return pnl.correlated(_ics(spark, sf), "x", 2)


@query("pnl_chosen", f"""WITH {base.PANEL}, s AS (SELECT k.name, dti, sum(CASE k.e WHEN 0 THEN x WHEN 1 THEN y WHEN 2 THEN x * y ELSE abs(x) END * ret) AS pnl FROM panel CROSS JOIN (VALUES {_STORED}) k(name, e) GROUP BY ALL),
    p AS (SELECT name, CASE WHEN dti <= 36 THEN 1 ELSE 2 END AS period, pnl FROM s), w AS (SELECT name, sum(pnl) FILTER (period = 1) AS pnl_1, avg(pnl) FILTER (period = 1) AS ir_1, sum(pnl) FILTER (period = 2) AS pnl_2, avg(pnl) FILTER (period = 2) AS ir_2, sum(pnl) AS pnl_all, avg(pnl) AS ir_all FROM p GROUP BY name)
    SELECT name, {_r("pnl_1", "ir_1", "pnl_2", "ir_2", "pnl_all", "ir_all")} FROM w WHERE pnl_all > 0 OR ir_1 > ir_2""")
def pnl_chosen(spark, sf):
    found = _ics(spark, sf).withColumn("period", F.when(F.col("dti") <= 36, 1).otherwise(2))
    rows = found.groupBy("name").agg(F.sum("value").alias("pnl"), F.avg("value").alias("ir")).withColumn("period", F.lit(None).cast("int"))
    return pnl.chosen(found.groupBy("name", "period").agg(F.sum("value").alias("pnl"), F.avg("value").alias("ir")).unionByName(rows), "pnl_all > 0 or ir_1 > ir_2")


@query("group_ic", f"""WITH {base.PANEL}, e AS (SELECT dti, sum(x * ret) AS xy, sum(x * x) AS xx, sum(ret * ret) AS yy FROM panel WHERE x IS NOT NULL AND ret IS NOT NULL GROUP BY dti), t AS (SELECT sum(xy) / nullif(sqrt(sum(xx) * sum(yy)), 0) AS ic, avg(xy / nullif(sqrt(xx * yy), 0)) AS group_ic FROM e) SELECT {_r("ic", "group_ic")} FROM t""")
def group_ic(spark, sf):
    return pnl.group_ic(_panel(spark, sf).withColumn("value", F.col("x")), "dti")


@query("pnl_per_symbol", f"""WITH {base.PANEL}, h AS (SELECT dti, ii, ret, coalesce(x, CASE WHEN count(x) OVER (o ROWS UNBOUNDED PRECEDING) > 0 THEN 0 END) AS s FROM panel WINDOW o AS (PARTITION BY ii ORDER BY dti)), q AS (SELECT *, lag(s) OVER (PARTITION BY ii ORDER BY dti) AS p FROM h),
    t AS (SELECT *, abs(s - p) AS trade, p * ret - abs(s - p) * 0.0002::DOUBLE AS pnl FROM q WHERE p IS NOT NULL), c AS (SELECT *, sum(coalesce(pnl, 0)) OVER o AS cum FROM t WINDOW o AS (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING)), d AS (SELECT *, max(cum) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) - cum AS dd FROM c),
    a AS (SELECT ii, coalesce(sum(p * ret) / nullif(sqrt(sum(p * p) FILTER (ret IS NOT NULL) * sum(ret * ret)), 0), 0) AS cos, coalesce(avg(trade), 0) AS tvr, coalesce(sum(pnl), 0) AS total_pnl, coalesce(avg(pnl) * 12, 0) AS yearly_pnl, coalesce(sum(pnl) / nullif(sum(trade), 0) * 10000, 0) AS pnl_bps,
        coalesce(CASE WHEN stddev_pop(pnl) > 1e-20 THEN avg(pnl) / stddev_pop(pnl) * sqrt(12) END, 0) AS ir, max(dd) AS dd FROM d GROUP BY ii) SELECT ii, {_r("cos", "tvr", "total_pnl", "yearly_pnl", "pnl_bps", "ir", "dd")} FROM a""")
def pnl_per_symbol(spark, sf):
    return pnl.per_symbol(_panel(spark, sf).withColumn("value", F.col("x")), 0.0002, 12)


@query("pnl_monthly", f"{_DAYS}, {base._DRAW}, m AS (SELECT CAST((dti - 1) // 3 AS INTEGER) AS period, count(*) AS days, sum(pnl) AS pnl, avg(tvr) AS tvr, min(dd) * 100 AS max_dd FROM dd GROUP BY ROLLUP (CAST((dti - 1) // 3 AS INTEGER))) SELECT period, days, {_r('pnl', 'tvr', 'max_dd')} FROM m")
def pnl_monthly(spark, sf):
    days = base._days(spark, sf).withColumn("period", F.floor((F.col("dti") - 1) / 3).cast("int"))
    return pnl.summary(days, 12, 1000.0).select("period", "days", "pnl", "tvr", "max_dd")


# --- training rows
@query("feature_rows", f"WITH {base.PANEL} SELECT dti, ii, {_r('x', 'y', 'ret')} FROM panel WHERE dti >= 20 AND dti < 50 AND univ AND ret IS NOT NULL AND (x IS NOT NULL OR y IS NOT NULL)")
def feature_rows(spark, sf):
    return prep.feature_rows(_panel(spark, sf), ["x", "y"], "ret", "univ", 20, 50, 1)


@query("merged_features", f"WITH {base.PANEL}, a AS (SELECT dti, ii, x FROM panel WHERE x > 0), b AS (SELECT dti, ii, y FROM panel WHERE y > 0) SELECT dti, ii, {_r('x', 'y')} FROM a FULL JOIN b USING (dti, ii)")
def merged_features(spark, sf):
    panel = _panel(spark, sf)
    return prep.merged_features([panel.where("x > 0").select("dti", "ii", "x"), panel.where("y > 0").select("dti", "ii", "y")])


@query("prep_scale", f"WITH {base.PANEL}, s AS (SELECT dti, ii, x / nullif(stddev_pop(x) OVER w, 0) AS x, y / nullif(stddev_pop(y) OVER w, 0) AS y FROM panel WINDOW w AS (PARTITION BY dti)), c AS (SELECT dti, ii, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y FROM s WINDOW w AS (PARTITION BY dti)) SELECT dti, ii, {_r('x', 'y')} FROM c")
def prep_scale(spark, sf):
    return prep.scale_by_date(_panel(spark, sf).select("dti", "ii", "x", "y"), ["x", "y"], True)


@query("prep_scale_ragged", f"WITH {base.PANEL} SELECT dti, ii, g, round(x / nullif(stddev_pop(x) OVER (PARTITION BY g), 0), {PLACES}) + 0.0 AS x FROM panel WHERE x IS NOT NULL")
def prep_scale_ragged(spark, sf):
    return prep.scale_by_date(_panel(spark, sf).where("x is not null").select("dti", "ii", "g", "x"), ["x"], block="g")


@query("prep_demean", f"WITH {base.PANEL}, c AS (SELECT dti, ii, x - avg(x) OVER w AS x FROM panel WINDOW w AS (PARTITION BY dti)) SELECT dti, ii, {_r('x')} FROM c")
def prep_demean(spark, sf):
    return prep.demean_by_date(_panel(spark, sf).select("dti", "ii", "x"), ["x"])


@query("prep_fill", f"WITH {base.PANEL}, c AS (SELECT dti, ii, coalesce(x, 0.5) AS x FROM panel) SELECT dti, ii, {_r('x')} FROM c")
def prep_fill(spark, sf):
    return prep.fill_missing(_panel(spark, sf).select("dti", "ii", "x"), ["x"], 0.5)


@query("prep_smooth", f"WITH {base.PANEL}, c AS (SELECT dti, ii, last_value(x IGNORE NULLS) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) AS x FROM panel) SELECT dti, ii, {_r('x')} FROM c")
def prep_smooth(spark, sf):
    return prep.smooth_forward(_panel(spark, sf).select("dti", "ii", "x"), ["x"])


@query("prep_smooth_horizon", f"WITH {base.PANEL}, c AS (SELECT dti, ii, coalesce(x, CASE WHEN row_number() OVER (PARTITION BY ii ORDER BY dti) > 1 THEN 0 END) AS x FROM panel) SELECT dti, ii, {_r('x')} FROM c")
def prep_smooth_horizon(spark, sf):
    return prep.smooth_forward(_panel(spark, sf).select("dti", "ii", "x"), ["x"], 3)


@query("prep_standard", f"WITH {base.PANEL}, f AS (SELECT avg(x) AS m, stddev_samp(x) AS s FROM panel WHERE dti < 50), c AS (SELECT dti, ii, (x - m) / nullif(s, 0) AS x FROM panel CROSS JOIN f) SELECT dti, ii, {_r('x')} FROM c")
def prep_standard(spark, sf):
    panel = _panel(spark, sf).select("dti", "ii", "x")
    return prep.apply_scaler(panel, prep.fit_scaler(panel.where("dti < 50"), ["x"]), ["x"])


@query("valid_ends", f"WITH {base.PANEL}, n AS (SELECT dti, ii, ret, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS n FROM panel) SELECT dti, ii FROM n WHERE n = 3 AND ret IS NOT NULL")
def valid_ends(spark, sf):
    return prep.valid_ends(_panel(spark, sf), ["x", "y"], "ret", 3)


@query("feature_sequences", f"WITH {base.PANEL}, n AS (SELECT dti, ii, list(x) OVER w AS l, count(*) OVER w AS n FROM panel WINDOW w AS (PARTITION BY ii ORDER BY dti ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)) SELECT dti, ii, round(l[1], {PLACES}) + 0.0 AS oldest, round(l[4], {PLACES}) + 0.0 AS newest, len(l) AS rows FROM n WHERE n = 4")
def feature_sequences(spark, sf):
    df = prep.sequences(_panel(spark, sf), ["x"], 4)
    return df.select("dti", "ii", F.col("sequence")[0]["x"].alias("oldest"), F.col("sequence")[3]["x"].alias("newest"), F.size("sequence").cast("long").alias("rows"))


@query("sample_weights", f"WITH {base.PANEL}, d AS (SELECT dti, row_number() OVER (ORDER BY dti DESC) AS k FROM (SELECT DISTINCT dti FROM panel)) SELECT dti, ii, CASE WHEN k <= 6 THEN 10.0::DOUBLE WHEN k <= 12 THEN 5.0::DOUBLE WHEN k <= 24 THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM panel JOIN d USING (dti)")
def sample_weights(spark, sf):
    return prep.sample_weight(_panel(spark, sf).select("dti", "ii"), [(6, 10.0), (12, 5.0), (24, 3.0)])


@query("predict_rolls", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate AS DATE) >= DATE '2000-12-30' THEN 3 WHEN CAST(o_orderdate AS DATE) >= DATE '1999-12-31' THEN 2 WHEN CAST(o_orderdate AS DATE) >= DATE '1998-12-31' THEN 1 WHEN CAST(o_orderdate AS DATE) >= DATE '1997-12-31' THEN 0 END AS roll FROM orders")
def predict_rolls(spark, sf):
    splits = prep.rolling_splits(date(1995, 1, 1), date(2001, 6, 30), 3, 0, 1)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return prep.with_split(orders, splits).drop("day")


# --- symbols, pivots
@query("symbols", "SELECT s_suppkey, upper(s_name) AS code, CASE WHEN s_nationkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS exchange, lpad(CAST(s_suppkey AS VARCHAR), 6, '0') || '.' || CASE WHEN s_nationkey % 2 = 0 THEN 'SH' ELSE 'SZ' END AS symbol FROM supplier")
def symbols(spark, sf):
    exchange = F.when(F.col("s_nationkey") % 2 == 0, "SH").otherwise("SZ")
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", F.upper("s_name").alias("code"), exchange.alias("exchange"), F.concat_ws(".", F.lpad(F.col("s_suppkey").cast("string"), 6, "0"), exchange).alias("symbol"))


@query("panel_pivoted", f"WITH {base.PANEL} SELECT dti, {', '.join(f'round(sum(x) FILTER (g = {k}), {PLACES}) + 0.0 AS g{k}' for k in range(5))} FROM panel GROUP BY dti")
def panel_pivoted(spark, sf):
    df = _panel(spark, sf).groupBy("dti").pivot("g", list(range(5))).agg(F.sum("x"))
    return df.select("dti", *(F.col(str(k)).alias(f"g{k}") for k in range(5)))


@query("panel_melted", f"WITH {base.PANEL} SELECT dti, ii, 'x' AS field, {_r('x').replace('AS x', 'AS value')} FROM panel UNION ALL SELECT dti, ii, 'y', {_r('y').replace('AS y', 'AS value')} FROM panel")
def panel_melted(spark, sf):
    return _panel(spark, sf).unpivot(["dti", "ii"], ["x", "y"], "field", "value")


# --- operations and expressions of the base catalog that lacked SQL
_KTH = "list_sort(list(x) OVER w)"
_TOP = "list_slice(list_sort(list_transform(list_filter(list_zip(range(1, len(l) + 1), l, m), lambda p: p[2] IS NOT NULL), lambda p: {'a': -p[2], 'b': p[1], 'c': p[3]})), 1, CAST(ceil(len(list_filter(l, lambda e: e IS NOT NULL)) * 0.5) AS BIGINT))"
_LINE = f"""{base.PANEL}, e AS (SELECT dti, ii, x, last_value(x IGNORE NULLS) OVER b AS x0, first_value(x IGNORE NULLS) OVER a AS x1, last_value(CASE WHEN x IS NOT NULL THEN dti END IGNORE NULLS) OVER b AS t0, first_value(CASE WHEN x IS NOT NULL THEN dti END IGNORE NULLS) OVER a AS t1 FROM panel
        WINDOW b AS (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY ii ORDER BY dti ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
    f AS (SELECT *, coalesce(x, x0 + (x1 - x0) * (dti - t0) / nullif(t1 - t0, 0)) AS fx FROM e)"""
_DECAY = "list_reduce({l}, lambda acc, e: e * 0.3 + acc * 0.7)"
SQL = {
    "op_upbound": f"""WITH {base.PANEL}, k AS (SELECT *, count(x) OVER w AS n, {_KTH}[3] AS lo, list_reverse_sort(list(x) FILTER (x IS NOT NULL) OVER w)[3] AS hi, {base._RANK.replace('{keys}', 'dti')} AS r FROM panel WINDOW w AS (PARTITION BY dti)), c AS (SELECT *, CASE WHEN x IS NOT NULL THEN least(greatest(x, lo), hi) - lo END AS c FROM k),
        o AS (SELECT dti, ii, CASE WHEN n < 6 THEN r WHEN avg(c) OVER (PARTITION BY dti) > 0 THEN c * 0.5 / avg(c) OVER (PARTITION BY dti) ELSE c END AS v FROM c) SELECT dti, ii, CASE WHEN isfinite(v) THEN round(v, {PLACES}) + 0.0 END AS value FROM o""".replace(f"{_KTH}[3]", "list_sort(list(x) FILTER (x IS NOT NULL) OVER w)[3]"),
    "op_neutidx": f"""WITH {base.PANEL}, s AS (SELECT *, sum(abs(x)) OVER p AS mine, sum(CASE WHEN g >= 0 THEN abs(x) END) OVER d AS total, sum(CASE WHEN g >= 0 THEN y END) OVER p AS theirs, sum(CASE WHEN g >= 0 THEN y END) OVER d AS every FROM panel WINDOW p AS (PARTITION BY dti, g), d AS (PARTITION BY dti)),
        o AS (SELECT dti, ii, CASE WHEN g >= 0 AND mine > 0 AND every > 0 THEN x * theirs / every * total / mine END AS v FROM s) SELECT dti, ii, CASE WHEN isfinite(v) THEN round(v, {PLACES}) + 0.0 END AS value FROM o""",
    "op_boundsize": f"""WITH {base.PANEL}, p AS (SELECT dti, ii, x, CASE WHEN x > 0 THEN x END AS w FROM panel), c AS (SELECT *, greatest(1 / nullif(count(w) OVER d, 0), 0.05) * sum(w) OVER d AS cap, sum(w) OVER d AS total, list(w) FILTER (w IS NOT NULL) OVER d AS l FROM p WINDOW d AS (PARTITION BY dti)), s AS (SELECT *, list_reverse_sort(l) AS r FROM c),
        k AS (SELECT *, list_position(list_transform(range(1, len(r) + 1), lambda i: r[i] * (total - cap * (i - 1)) <= cap * list_sum(r[i:]) * (1 + 1e-12)), true) - 1 AS k FROM s), o AS (SELECT dti, ii, CASE WHEN w IS NULL THEN x WHEN k > 0 AND w >= r[k] THEN cap ELSE w * (total - cap * k) / list_sum(r[k + 1:]) END AS v FROM k)
        SELECT dti, ii, CASE WHEN isfinite(v) THEN round(v, {PLACES}) + 0.0 END AS value FROM o""",
    "op_expdecay": f"""WITH {base.PANEL}, g AS (SELECT *, count(*) FILTER (x IS NULL) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) AS run FROM panel), l AS (SELECT dti, ii, x, list(x) OVER (PARTITION BY ii, run, x IS NULL ORDER BY dti ROWS UNBOUNDED PRECEDING) AS l FROM g)
        SELECT dti, ii, round(CASE WHEN x IS NOT NULL THEN {_DECAY.format(l='l')} END, {PLACES}) + 0.0 AS value FROM l""",
    "op_sexpdecay": f"""WITH {_LINE}, l AS (SELECT dti, ii, x, list(fx) OVER (PARTITION BY ii, fx IS NULL ORDER BY dti ROWS UNBOUNDED PRECEDING) AS l FROM f) SELECT dti, ii, round(CASE WHEN x IS NOT NULL THEN {_DECAY.format(l='l')} END, {PLACES}) + 0.0 AS value FROM l""",
    "expr_ts_sum_max_pct": base._series_sql("x y", 7, f"coalesce(list_sum(list_transform({_TOP}, lambda s: coalesce(s.c, 0))), 0)", False),
    "expr_ts_sum_max_pct_raw": base._series_sql("x y", 7, f"coalesce(list_sum(list_transform({_TOP}, lambda s: coalesce(s.c, 0))), 0)", True),
    "expr_let": "WITH q AS (" + base._series_sql("x", 5, f"x - {base._MEAN}", False).replace(f"round(v, {PLACES}) + 0.0", "v") + f"), r AS (SELECT dti, ii, value AS x FROM q) SELECT dti, ii, round({base._RANK.replace('{keys}', 'dti')}, {PLACES}) + 0.0 AS value FROM r WINDOW w AS (PARTITION BY dti)",
    "pnl_stats": f"""{_DAYS}, dd AS (SELECT *, cum - greatest(0, max(cum) OVER (ORDER BY dti ROWS UNBOUNDED PRECEDING)) AS dd FROM (SELECT *, sum(pnl) OVER (ORDER BY dti ROWS UNBOUNDED PRECEDING) AS cum FROM full_days)),
        s AS (SELECT avg(pnl) / nullif(stddev_pop(pnl), 0) * sqrt(12) AS ir, count(*) FILTER (abs(pnl) > 1e-15 AND pnl > 0) / count(*) FILTER (abs(pnl) > 1e-15) AS win_rate, sum(pnl) / sum(trade_val) * 10000 AS pnl_bps, avg(pnl) * 12 AS pnl_y, min(dd) AS max_dd, CASE WHEN min(dd) < 0 THEN avg(pnl) * 12 / -min(dd) END AS calmar FROM dd)
        SELECT {_r("ir", "win_rate", "pnl_bps", "pnl_y", "max_dd", "calmar")} FROM s""",
}

FOUND["op_flip"] = (base._chain("flip"), base._chain_sql("-x"))

#: A signal that is silent between the months of an instrument's largest and smallest y: gaps of all lengths, for some more than is filled.
_GAPPED = """, reached AS (SELECT ii, arg_max(dti, (y, -dti)) AS a, arg_min(dti, (y, dti)) AS b FROM panel WHERE y IS NOT NULL GROUP BY ii),
    gapped AS (SELECT dti, p.ii, CASE WHEN coalesce(dti <= least(a, b) OR dti >= greatest(a, b), true) THEN x END AS x FROM panel p LEFT JOIN reached USING (ii))"""


def _gapped(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, own = supplier_panel(spark, sf_dir), Window.partitionBy("ii")
        known = F.col("y").isNotNull()
        df = df.withColumn("_a", F.max_by("dti", F.when(known, F.struct("y", -F.col("dti")))).over(own)).withColumn("_b", F.min_by("dti", F.when(known, F.struct("y", "dti"))).over(own))
        outside = F.coalesce((F.col("dti") <= F.least("_a", "_b")) | (F.col("dti") >= F.greatest("_a", "_b")), F.lit(True))
        df = df.withColumn("value", F.when(outside, F.col("x"))).drop("_a", "_b")
        return chain.apply_chain(df, text).select("dti", "ii", base._shown(F.col("value")).alias("value"))

    return run


_LONG = {"tsdelta": (72, base.SERIES["ts_delta"][3]), "tsdecaylinear": (71, base.SERIES["ts_decay_linear"][3]), "tsrmean": (71, base.SERIES["ts_rmean"][3]), "tscount": (71, base.RAW_ONLY["ts_count"][3]), "tsmean": (71, base.SERIES["ts_mean"][3]), "tsrank": (71, base.SERIES["ts_rank"][3])}
for _name, (_rows, _value) in _LONG.items():
    FOUND[f"op_{_name}_long"] = (_gapped(f"{_name}:71"), base._trailing_sql(_value, _rows, "gapped").replace(", base AS (SELECT dti, ii, x,", _GAPPED + ", base AS (SELECT dti, ii, x,", 1))


#: Ranks with near ties: values a billionth apart count as one
_TIES = f"""WITH {base.PANEL}, v AS (SELECT dti, ii, CASE WHEN univ THEN round(x, 1) + 2 + ii * 1e-9 END AS x FROM panel), b AS (SELECT *, lag(x) OVER o AS p, row_number() OVER o AS k, count(x) OVER (PARTITION BY dti, x IS NULL) AS n FROM v WINDOW o AS (PARTITION BY dti, x IS NULL ORDER BY x)),
    r AS (SELECT *, sum(CASE WHEN p IS NULL OR abs(x - p) / (abs(x) + abs(p) + 1e-10) > 1e-6 THEN 1 ELSE 0 END) OVER (PARTITION BY dti, x IS NULL ORDER BY k ROWS UNBOUNDED PRECEDING) AS run FROM b)
    SELECT dti, ii, round(CASE WHEN x IS NULL THEN NULL WHEN n = 1 THEN 0.5 ELSE (avg(k) OVER (PARTITION BY dti, x IS NULL, run) - 1) / (n - 1) END, {PLACES}) + 0.0 AS value FROM r"""


@query("op_rank_ties", _TIES)
def op_rank_ties(spark, sf):
    df = _panel(spark, sf).withColumn("value", F.round("x", 1) + 2 + F.col("ii") * 1e-9)
    return chain.apply_chain(df, "rank:1e-6").select("dti", "ii", "value")


def _regression_sql(k: int) -> str:
    full = "x IS NOT NULL AND y IS NOT NULL"
    s = {f"{a}{b}": f"sum(CASE WHEN {full} THEN {p} * {q} END) OVER w" for (a, p), (b, q) in ((u, v) for u in zip("123y", ("x", "x * x", "1", "y")) for v in zip("123y", ("x", "x * x", "1", "y")))}
    columns = ", ".join(f"{e} AS s{n}" for n, e in s.items() if n[0] <= n[1] or n[1] == "y")
    sym = lambda i, j: f"s{min(i, j)}{max(i, j)}"

    def det(m):
        return f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) + {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"

    a = [[sym(i, j) for j in (1, 2, 3)] for i in (1, 2, 3)]
    b = [[f"s{i + 1}y" if j == k - 1 else a[i][j] for j in range(3)] for i in range(3)]
    return f"WITH {base.PANEL}, q AS (SELECT dti, ii, univ, {full} AS ok, count(*) FILTER ({full}) OVER w AS n, {columns} FROM panel WINDOW w AS (PARTITION BY ii ORDER BY dti ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)), f AS (SELECT *, {det(b)} / nullif({det(a)}, 0) AS v FROM q) SELECT dti, ii, CASE WHEN univ AND ok AND n >= 8 AND isfinite(v) THEN round(v, 2) + 0.0 END AS value FROM f"


def _regression(spark, sf):
    """The first of three coefficients, where the frame holds at least eight rows: with as many rows as regressors sums cancel."""
    df = base.evaluate(_panel(spark, sf), "(ts_reg y x (pow x 2) (const 1) 30 1)")
    full = "x is not null and y is not null"
    n = _panel(spark, sf).select("dti", "ii", F.count(F.when(F.expr(full), 1)).over(Window.partitionBy("ii").orderBy("dti").rowsBetween(-29, 0)).alias("n"))
    return df.join(n, ["dti", "ii"]).select("dti", "ii", (F.round(F.when(F.col("n") >= 8, F.col("value")), 2) + F.lit(0.0)).alias("value"))


FOUND["expr_ts_reg_three"] = (_regression, _regression_sql(1))


#: Signals, book and share of it that the quota lends, such that about half the shorts are cut.
_BOOK, _LENT = 5e11, 2e-4
_RZRQ = f"""WITH {QUOTES}, s AS (SELECT dti, ii, close, (1500 - close) / 1000 AS v, CASE WHEN st = 0 THEN shares END AS member, lag(close) OVER o AS before, row_number() OVER o > 1 AS later FROM quotes WINDOW o AS (PARTITION BY ii ORDER BY dti)),
    l AS (SELECT *, trunc(v * {_BOOK / chain.SHOWN!r}::DOUBLE / close) AS held, trunc({_LENT * _BOOK!r}::DOUBLE * (member / 100) / before / 100) * 100 AS quota FROM s),
    c AS (SELECT dti, ii, later, CASE WHEN NOT later OR ii >= 90 OR v IS NULL OR v >= 0 THEN v WHEN member IS NULL THEN 0 WHEN held < 0 AND held < -quota THEN -quota / {_BOOK / chain.SHOWN!r}::DOUBLE * close ELSE v END AS v FROM l)
    SELECT dti, ii, round(CASE WHEN later AND ii = 90 THEN -coalesce(sum(CASE WHEN ii < 90 THEN v END) OVER (PARTITION BY dti), 0) ELSE v END, {PLACES}) + 0.0 AS value FROM c"""


@query("op_rzrq", _RZRQ)
def op_rzrq(spark, sf):
    df = supplier_quotes(spark, sf).withColumn("value", (1500 - F.col("close")) / 1000).withColumn("member", F.when(F.col("st") == 0, F.col("shares")))
    return chain.apply_chain(df, f"rzrq:close,close,member,{_BOOK!r},{_LENT!r},0,90").select("dti", "ii", "value")


@query("op_risk", None)
def op_risk(spark, sf):
    df = _panel(spark, sf).select("dti", "ii", "ret", "y", F.col("x").alias("value"), (F.col("y") + 0.75).alias("member"))
    return chain.apply_chain(df, "risk:member,ret,y").select("dti", "ii", "value")


def queries() -> dict:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql} | SQL
