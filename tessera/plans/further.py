"""Registered queries over risk, choices of series, positions, linear models, metrics and open days, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates
from ..operators import choose, linear, market, metrics, pnl, risk, states
from ..sources.panel import supplier_panel, supplier_quotes
from . import catalog as base
from . import live
from .more import QUOTES

FOUND: dict = {}


def query(name: str, sql: str | None):
    """Registers a query (spark, sf_dir) -> DataFrame, its doubles rounded, under a name with its SQL."""

    def put(make):
        FOUND[name] = (lambda spark, sf, make=make: base._rounded(make(spark, sf)), sql)
        return make

    return put


def shown(*names: str) -> str:
    return ", ".join(f"round({c}, {base.PLACES}) + 0.0 AS {c}" for c in names)


def panel(spark: SparkSession, sf: str) -> DataFrame:
    return supplier_panel(spark, sf)


# --- risk
_COV = """cells2 AS (SELECT dti, ii, g, ret AS x, CAST((floor((dti - 1) / 12.0) + 1) * 12 AS BIGINT) AS block FROM panel WHERE ret IS NOT NULL),
    stats AS (SELECT a.block, a.ii, b.ii AS jj, var_pop(a.x) AS vx, var_pop(b.x) AS vy, covar_pop(a.x, b.x) AS c FROM cells2 a JOIN cells2 b ON a.dti = b.dti AND a.g = b.g GROUP BY ALL),
    fine AS (SELECT * FROM stats WHERE vx > 1e-18 AND vy > 1e-18), own AS (SELECT block, ii, sqrt(vx) AS d FROM fine WHERE ii = jj),
    cov AS (SELECT f.block, f.ii, jj, CASE WHEN f.ii = jj THEN vx ELSE l.d * c / sqrt(vx * vy) * r.d END AS cov FROM fine f JOIN own l ON l.block = f.block AND l.ii = f.ii JOIN own r ON r.block = f.block AND r.ii = jj),
    days AS (SELECT dti, (SELECT max(block) FROM cov WHERE block <= d.dti) AS block FROM (SELECT DISTINCT dti FROM panel) d)"""


def _variance(scaled: bool) -> str:
    size = "nullif(sum(abs(a)) OVER (PARTITION BY dti), 0)" if scaled else "1"
    return f"""WITH {base.PANEL}, {_COV}, w0 AS (SELECT p.dti, d.block, p.ii, coalesce(x, 0) AS a FROM panel p JOIN days d ON p.dti = d.dti JOIN cov m ON m.block = d.block AND m.ii = p.ii AND m.jj = p.ii),
    w AS (SELECT dti, block, ii, a / {size} AS a FROM w0), f AS (SELECT l.dti, sum(l.a * cov * r.a) AS v FROM w l JOIN cov m ON m.block = l.block AND m.ii = l.ii JOIN w r ON r.dti = l.dti AND r.ii = m.jj GROUP BY l.dti)
    SELECT d.dti, round(CASE WHEN d.block IS NOT NULL THEN coalesce(v, 0) END * 1000, {base.PLACES}) + 0.0 AS variance FROM days d LEFT JOIN f ON f.dti = d.dti"""


def _implied(scaled: bool):
    def run(spark, sf):
        df = panel(spark, sf)
        found = risk.panel_variance(df.select("dti", "ii", F.col("x").alias("value")), df, "ret", "g", 12, scaled)
        return found.withColumn("variance", F.col("variance") * 1000)

    return run


query("implied_variance", _variance(False))(_implied(False))
query("implied_variance_scaled", _variance(True))(_implied(True))


# --- series
_SIGNALS = {"x": "x", "y": "y", "xy": "x * y", "size": "abs(x)", "sum": "x + y", "gap": "x - y", "square": "x * x", "cube": "x * x * x", "busy": "abs(y)", "far": "y * y"}
_VALUES = ", ".join(f"({k}, {n})" for k, n in enumerate(_SIGNALS))
_SERIES = f"series AS (SELECT CAST(k AS BIGINT) AS name, dti AS t, CAST(value AS DOUBLE) AS value FROM (SELECT dti, {', '.join(f'sum(({e}) * ret) AS s{k}' for k, e in enumerate(_SIGNALS.values()))} FROM panel GROUP BY dti) UNPIVOT (value FOR kind IN ({', '.join(f's{k}' for k in range(len(_SIGNALS)))})) JOIN (SELECT unnest(range({len(_SIGNALS)})) AS k) ON kind = 's' || k)"
_COS = "cosines AS (SELECT l.name AS a, r.name AS b, sum(l.value * r.value) / nullif(sqrt(sum(l.value * l.value) * sum(r.value * r.value)), 0) AS cos FROM series l JOIN series r ON l.t = r.t AND l.name < r.name GROUP BY ALL)"


def _series(spark, sf):
    days = panel(spark, sf).groupBy("dti").agg(*(F.sum(F.expr(f"({e}) * ret")).alias(str(k)) for k, e in enumerate(_SIGNALS.values())))
    return days.unpivot("dti", [str(k) for k in range(len(_SIGNALS))], "name", "value").select(F.col("name").cast("long").alias("name"), F.col("dti").alias("t"), "value")


@query("series_cosines", f"WITH {base.PANEL}, {_SERIES}, {_COS} SELECT a, b, {shown('cos')} FROM cosines")
def series_cosines(spark, sf):
    return choose.cosines(_series(spark, sf))


@query("series_decorrelated", f"""WITH RECURSIVE {base.PANEL}, {_SERIES}, {_COS},
    pick AS (SELECT CAST(-1 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS kept UNION ALL
        SELECT k + 1, CASE WHEN EXISTS (SELECT 1 FROM cosines WHERE b = k + 1 AND cos > 0.6 AND list_contains(kept, a)) THEN kept ELSE list_append(kept, k + 1) END FROM pick WHERE k < {len(_SIGNALS) - 1})
    SELECT n.name, CAST(list_contains(kept, n.name) AS INTEGER) AS kept FROM (SELECT DISTINCT name FROM series) n, (SELECT kept FROM pick WHERE k = {len(_SIGNALS) - 1})""")
def series_decorrelated(spark, sf):
    series = _series(spark, sf)
    return choose.decorrelated(series.select("name"), choose.cosines(series), 0.6).withColumn("kept", F.col("kept").cast("int"))


@query("series_similar", f"""WITH {base.PANEL}, d AS (SELECT dti, sum(x * ret) AS x, sum(y * ret) AS y, row_number() OVER (ORDER BY dti) AS k FROM panel GROUP BY dti), e AS (SELECT sum(x) AS sx, sum(y) AS sy, count(*) AS n FROM d WHERE k > 1)
    SELECT round(CASE WHEN (max(sx) < 0) <> (max(sy) < 0) THEN -1 ELSE 1 END / (avg(abs(y / sy - x / sx)) * sqrt(max(n))), {base.PLACES}) + 0.0 AS similar FROM d, e WHERE k > 1""")
def series_similar(spark, sf):
    days = panel(spark, sf).groupBy("dti").agg(F.sum(F.col("x") * F.col("ret")).alias("x"), F.sum(F.col("y") * F.col("ret")).alias("y"))
    return choose.similarity(days.withColumnRenamed("dti", "t"), "x", "y")


# --- positions
_STEPPED = f"""WITH RECURSIVE {base.PANEL}, p AS (SELECT dense_rank() OVER (ORDER BY dti) AS k, dti, ii, x FROM panel),
    r AS (SELECT CAST(0 AS BIGINT) AS k, ii, NULL::DOUBLE AS v FROM (SELECT DISTINCT ii FROM p) UNION ALL
        SELECT p.k, p.ii, CASE WHEN x IS NULL THEN NULL WHEN x <= -0.3 THEN -1 WHEN x >= 0.3 THEN 1 WHEN r.v > 0 AND x > 0.1 THEN r.v WHEN r.v < 0 AND x < -0.1 THEN r.v {{more}} ELSE 0 END FROM r JOIN p ON p.ii = r.ii AND p.k = r.k + 1)
    SELECT p.dti, p.ii, round(v, {base.PLACES}) + 0.0 AS value FROM r JOIN p ON p.k = r.k AND p.ii = r.ii"""
_POSITIONS = {
    0: base._chain_sql("CASE WHEN x >= 0.3 THEN 1 WHEN x <= -0.3 THEN -1 WHEN x IS NOT NULL THEN 0 END"),
    1: base._chain_sql("CASE WHEN x IS NOT NULL THEN greatest(least(x / 0.3, 1), -1) END"),
    2: _STEPPED.format(more=""),
    3: _STEPPED.format(more="WHEN r.v > 0 AND x > 0 THEN r.v / 2 WHEN r.v < 0 AND x < 0 THEN r.v / 2"),
}
for _algo, _sql in _POSITIONS.items():
    query(f"positions_{_algo}", _sql)(lambda spark, sf, a=_algo: states.positions(panel(spark, sf).select("dti", "ii", F.col("x").alias("value")), a, 0.3, 0.1))


@query("rolled_change", f"""WITH {base.PANEL}, l AS (SELECT dti, ii, list(x) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS l FROM panel)
    SELECT dti, ii, round(CASE WHEN len(l) = 6 AND len(list_filter(l, lambda e: e IS NOT NULL)) = 6 THEN list_avg(list_transform(range(1, 6), lambda k: abs(l[k + 1] - l[k]))) END, {base.PLACES}) + 0.0 AS value FROM l""")
def rolled_change(spark, sf):
    """Mean size of the change from row to row, over windows of six rows."""
    df = panel(spark, sf).select("dti", "ii", F.col("x").alias("value"))
    return states.rolled(df, lambda w: np.abs(np.diff(w, axis=1)).mean(1), 6)


@query("rolling_slope", f"""WITH {base.PANEL}, s AS (SELECT dti, ii, univ, row_number() OVER o AS k, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) OVER w AS n, sum(x * y) OVER w AS xy, sum(CASE WHEN y IS NOT NULL THEN x * x END) OVER w AS xx FROM panel WINDOW o AS (PARTITION BY ii ORDER BY dti), w AS (o ROWS BETWEEN 8 PRECEDING AND CURRENT ROW))
    SELECT dti, ii, round(CASE WHEN univ AND k > 9 AND n >= 4 THEN xy / nullif(xx, 0) END, {base.PLACES}) + 0.0 AS value FROM s""".replace("w AS (o ROWS", "w AS (PARTITION BY ii ORDER BY dti ROWS"))
def rolling_slope(spark, sf):
    return linear.rolling_slope(panel(spark, sf), "x", "y", 9)


# --- linear models
_FIRST, _LAST = 1, 85
_TRAIN, _PREDICT = linear.expanding(_FIRST, 36, 12, _LAST)
_ROLLS = ", ".join(f"({k}, {a}, {b}, {c}, {d})" for k, ((a, b), (c, d)) in enumerate(zip(_TRAIN, _PREDICT)))
_FIT = f"""rolls(roll, a, b, c, d) AS (VALUES {_ROLLS}), sums AS (SELECT roll, sum(x * x) + 0.5 AS xx, sum(x * y) AS xy, sum(y * y) + 0.5 AS yy, sum(x * ret) AS xr, sum(y * ret) AS yr FROM panel JOIN rolls ON dti >= a AND dti < b WHERE x IS NOT NULL AND y IS NOT NULL AND ret IS NOT NULL GROUP BY roll),
    fit AS (SELECT roll, (xr * yy - yr * xy) / (xx * yy - xy * xy) AS w0, (yr * xx - xr * xy) / (xx * yy - xy * xy) AS w1 FROM sums),
    guess AS (SELECT p.dti, p.ii, p.ret, r.roll, (x * w0 + y * w1) * 100 AS prediction FROM panel p LEFT JOIN rolls r ON dti >= c AND (dti < d OR roll = {len(_PREDICT) - 1}) LEFT JOIN fit USING (roll))"""


def _predicted(spark, sf):
    df = panel(spark, sf)
    weights = linear.fitted(linear.grams(df, ["x", "y"], "ret"), ["x", "y"], _TRAIN, 0.5)
    out = linear.predicted(df, weights, ["x", "y"], _PREDICT)
    return out.withColumn("prediction", F.col("prediction") * 100)


@query("roll_predictions", f"WITH {base.PANEL}, {_FIT} SELECT dti, ii, roll, {shown('prediction')} FROM guess")
def roll_predictions(spark, sf):
    return _predicted(spark, sf).select("dti", "ii", "roll", "prediction")


@query("roll_scores", f"WITH {base.PANEL}, {_FIT} SELECT roll, count(*) AS n, round(sum(prediction * ret) / nullif(sqrt(sum(prediction * prediction) * sum(ret * ret)), 0), {base.PLACES}) + 0.0 AS ic, round(avg((prediction - ret) ** 2), {base.PLACES}) + 0.0 AS mse FROM guess WHERE prediction IS NOT NULL AND ret IS NOT NULL GROUP BY roll")
def roll_scores(spark, sf):
    return linear.roll_scores(_predicted(spark, sf), "ret")


# --- metrics
_PLUGINS, _SETTING = ["base", "tcost", "ic", "ir"], metrics.Setting(500.0, 12, 4, 0.0001, 0.0011, True)


@query("metric_plugins", f"""WITH {base.PANEL}, {base._HELD}, y AS (SELECT CAST(floor((dti - 1) / 12) AS INTEGER) + 1995 AS period, * FROM full_days)
    SELECT period, count(*) AS days, count(*) FILTER (ret > 0) AS up_days, count(*) FILTER (ret < 0) AS down_days, {base._numbers(["pnl", "ret", "tvr", "long_count", "short_count", "tcost", "ic", "std", "ir"])} FROM (
        SELECT period, sum(pnl) AS pnl, avg(ret) * 48 AS ret, avg(tvr) AS tvr, avg(long_count) AS long_count, avg(short_count) AS short_count, sum(tcost) AS tcost, avg(ic) AS ic, stddev_samp(ret) AS std, avg(ret) / nullif(stddev_samp(ret), 0) * 2 AS ir FROM y GROUP BY ROLLUP (period))""".replace("SELECT period, count(*) AS days, count(*) FILTER (ret > 0) AS up_days, count(*) FILTER (ret < 0) AS down_days, ", "SELECT period, days, up_days, down_days, ").replace("SELECT period, sum(pnl) AS pnl,", "SELECT period, count(*) AS days, count(*) FILTER (y.ret > 0) AS up_days, count(*) FILTER (y.ret < 0) AS down_days, sum(pnl) AS pnl,"))
def metric_plugins(spark, sf):
    days = metrics.daily(base._held(spark, sf), _PLUGINS, _SETTING)
    return metrics.summaries(days, _PLUGINS, _SETTING, F.floor((F.col("dti") - 1) / 12).cast("int") + 1995)


@query("deepest_drawdown", f"""WITH {base.PANEL}, {base._HELD}, {base._DRAW}, k AS (SELECT *, row_number() OVER (ORDER BY dti) - 1 AS k FROM dd), m AS (SELECT min_by(k, (dd, k)) AS e, min(dd) AS low FROM k),
    b AS (SELECT max(k.k) AS b FROM k, m WHERE k.k <= e AND k.dd >= 0) SELECT round(low * 100, {base.PLACES}) + 0.0 AS max_dd, CASE WHEN b = 0 THEN 0 ELSE coalesce(b + 1, 0) END AS start, e AS "end" FROM m, b""")
def deepest_drawdown(spark, sf):
    return metrics.deepest_drawdown(base._days(spark, sf))


@query("cell_differences", f"WITH {base.PANEL} SELECT count(*) AS cells, count(*) FILTER ((x IS NULL) <> (y IS NULL)) AS n_missing, count(*) FILTER (x <> y) AS n_different FROM panel")
def cell_differences(spark, sf):
    df = panel(spark, sf)
    return metrics.cell_differences(df.select("dti", "ii", F.col("x").alias("value")), df.select("dti", "ii", F.col("y").alias("value")))


@query("pnl_portfolio", f"""WITH {base.PANEL}, h AS (SELECT dti, ii, ret, coalesce(y - x, CASE WHEN count(y - x) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) > 0 THEN 0 END) AS s FROM panel),
    q AS (SELECT *, lag(s) OVER (PARTITION BY ii ORDER BY dti) AS p FROM h), t AS (SELECT *, abs(s - p) AS trade, p * ret - abs(s - p) * 0.0002::DOUBLE AS gain FROM q), e AS (SELECT sum(t) AS tvr FROM (SELECT coalesce(avg(trade), 0) AS t FROM t GROUP BY ii)),
    d AS (SELECT dti, sum(coalesce(gain, 0)) AS pnl, row_number() OVER (ORDER BY dti) AS k FROM t GROUP BY dti), c AS (SELECT *, sum(pnl) OVER (ORDER BY dti ROWS UNBOUNDED PRECEDING) AS cum FROM d WHERE k > 1), w AS (SELECT *, max(cum) OVER (ORDER BY dti ROWS UNBOUNDED PRECEDING) - cum AS dd FROM c),
    a AS (SELECT max(tvr) AS tvr, sum(pnl) AS total_pnl, avg(pnl) * 12 AS yearly_pnl, avg(pnl) / stddev_pop(pnl) * sqrt(12) AS ir, avg(pnl) / max(tvr) * 10000 AS pnl_bps, max(dd) AS dd, CASE WHEN max(dd) > 0 THEN avg(pnl) * 12 / max(dd) ELSE 0 END AS calmar_ratio, count(*) FILTER (pnl > 1e-15) / count(*) FILTER (abs(pnl) > 1e-15) AS win_rate FROM w, e)
    SELECT {shown("tvr", "total_pnl", "yearly_pnl", "ir", "pnl_bps", "dd", "calmar_ratio", "win_rate")} FROM a""")
def pnl_portfolio(spark, sf):
    return pnl.portfolio(panel(spark, sf).withColumn("value", F.col("y") - F.col("x")), 0.0002, 12)


@query("combined_allocated", f"WITH {base.PANEL} SELECT dti, ii, round(CASE WHEN x IS NOT NULL OR y IS NOT NULL THEN coalesce(x, 0) * 0.75 + coalesce(y, 0) * 0.25 END, {base.PLACES}) + 0.0 AS value FROM panel")
def combined_allocated(spark, sf):
    df = panel(spark, sf)
    return pnl.allocated([df.select("dti", "ii", F.col(c).alias("value")) for c in ("x", "y")], [3.0, 1.0])


@query("index_weights_backfilled", f"""WITH {QUOTES}, pub AS (SELECT dti, ii, vol / sum(vol) OVER (PARTITION BY dti) AS weight FROM quotes WHERE vol > 60),
    d AS (SELECT q.dti, max(p.dti) AS published FROM (SELECT DISTINCT dti FROM quotes) q JOIN (SELECT DISTINCT dti FROM pub) p ON p.dti <= greatest(q.dti, 30) AND (q.dti >= 30 OR p.dti = 30) GROUP BY q.dti)
    SELECT d.dti, ii, {shown("weight")} FROM d JOIN pub ON pub.dti = d.published""")
def index_weights_backfilled(spark, sf):
    quotes = supplier_quotes(spark, sf)
    return market.index_membership(quotes.where("vol > 60").select("dti", "ii", F.col("vol").alias("weight")), quotes, 30)


@query("date_fields", """SELECT o_orderkey, CAST(strftime(d + INTERVAL 1 DAY, '%Y%m%d') AS INTEGER) AS next_day, CAST(strftime(d - INTERVAL 1 DAY, '%Y%m%d') AS INTEGER) AS last_day, CAST(isoyear(d) AS INTEGER) AS week_year, CAST(weekofyear(d) AS INTEGER) AS week, CAST(isodow(d) AS INTEGER) AS weekday,
    CAST(strftime(date_trunc('month', d), '%Y%m01') AS INTEGER) AS month_first, CAST(strftime(last_day(d), '%Y%m%d') AS INTEGER) AS month_last FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def date_fields(spark, sf):
    d = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    df = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", d.alias("d"))
    week, month = dates.iso_week(F.col("d")), dates.month_of(F.col("d"))
    return df.select("o_orderkey", dates.shifted(F.col("d"), 1).alias("next_day"), dates.shifted(F.col("d"), -1).alias("last_day"), week["year"].alias("week_year"), week["week"].alias("week"), week["weekday"].alias("weekday"), month["first"].alias("month_first"), month["last"].alias("month_last"))


# --- open days
_OPEN = 80
_LIVE_ROWS = f"""open AS (SELECT dti AS d, dti, ii, g, univ, CASE WHEN univ THEN ret * 30 END AS x FROM panel WHERE dti >= {_OPEN} UNION ALL SELECT d.dti, p.dti, p.ii, p.g, p.univ, p.x FROM panel p JOIN (SELECT DISTINCT dti FROM panel WHERE dti >= {_OPEN}) d ON p.dti < d.dti)"""


def _live(text: str):
    def run(spark, sf):
        closed = panel(spark, sf)
        late = closed.where(F.col("dti") >= _OPEN).withColumn("x", F.when(F.col("univ"), F.col("ret") * 30))
        return live.evaluate_live(closed, late, text)

    return run


query("live_mean", f"""WITH {base.PANEL}, {_LIVE_ROWS}, m AS (SELECT d, dti, ii, univ, x, avg(x) OVER w AS m FROM open WINDOW w AS (PARTITION BY d, ii ORDER BY dti ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
    SELECT dti, ii, round(CASE WHEN univ AND x IS NOT NULL THEN m END, {base.PLACES}) + 0.0 AS value FROM m WHERE d = dti""")(_live("(ts_mean_raw x 5)"))
query("live_rank", f"""WITH {base.PANEL}, {_LIVE_ROWS}, f AS (SELECT *, x - first_value(x) OVER w AS e FROM open WINDOW w AS (PARTITION BY d, ii ORDER BY dti ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
    s AS (SELECT *, CASE WHEN univ AND e IS NOT NULL THEN avg(e) OVER (PARTITION BY d, ii ORDER BY dti ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) END AS v FROM f), o AS (SELECT dti, ii, v AS x FROM s WHERE d = dti)
    SELECT dti, ii, round({base._RANK.replace("{keys}", "dti")}, {base.PLACES}) + 0.0 AS value FROM o WINDOW w AS (PARTITION BY dti)""")(_live("(rank (ts_mean_raw (ts_delta_raw x 3) 4))"))


@query("range_values", base._series_sql("x", 7, base.SERIES["ts_std"][3], False) + " WHERE dti >= 40 AND dti < 55")
def range_values(spark, sf):
    return live.evaluate_range(panel(spark, sf), "(ts_std x 7)", 40, 55)


def queries() -> dict:
    return {name: run for name, (run, _) in FOUND.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in FOUND.items() if sql}
