"""Panel operators on an empty panel, dates without a value, one instrument and rows of zeros."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import carry, chain, choose, linear, market, metrics, pnl, prep, reduce, risk, states
from tessera.plans import live
from tessera.plans.compile import evaluate

KINDS = "dti int, ii long, value double, ret double, x double, y double, close double, high double, low double, vol double, dvol double, shares double, adj double, listed boolean, st int, g int, univ boolean, halt boolean, w double"


def cells(kind, d, i):
    if kind == "missing" and d % 2 or kind == "all_missing":
        return (d, i, *(None,) * 11, True, None, -1, True, None, None)
    if kind == "zeros":
        return (d, i, *(0.0,) * 11, True, 0, 0, True, False, 0.0)
    v = float((d * 7 + i * 3) % 5 - 2)
    return (d, i, v, v / 10, v, v + 1, 10 + v, 11 + v, 9 + v, 5.0, 50.0 + v, 2.0, 1.0, True, 0, i % 2, True, False, abs(v) + 1)


PANELS = {"empty": (0, 0), "missing": (8, 3), "all_missing": (6, 2), "one": (8, 1), "zeros": (6, 3), "one_date": (1, 3)}


@pytest.fixture(scope="module", params=PANELS)
def panel(request, spark):
    days, instruments = PANELS[request.param]
    return request.param, spark.createDataFrame([cells(request.param, d, i) for d in range(days) for i in range(instruments)], KINDS)


def series(p):
    return p.groupBy("dti").agg(F.sum("x").alias("0"), F.sum("y").alias("1")).unpivot("dti", ["0", "1"], "name", "value").select(F.col("name").cast("long").alias("name"), F.col("dti").alias("t"), "value")


#: Operators with a row per cell of the panel, and others.
CELLS = {
    "base_panel": lambda p: market.base_panel(p), "adjusted": lambda p: pnl.adjusted(p), "screened": lambda p: market.screened_universe(p.withColumn("cap", F.col("shares")).withColumn("univ_all", F.col("listed")), 2, 2, 3, 50.0, 1),
    "flag": lambda p: market.carried_flag(p, "st"), "merged": lambda p: market.merged_universe(p, ["univ"], ["listed"], ["halt"]), "forward": lambda p: market.hedged_forward_return(p.withColumn("adj_close", F.col("close")), 2, 0), "late": lambda p: market.late_mean_alpha(p, "ret", 2),
    "scale": lambda p: prep.scale_by_date(p, ["x"], True), "smooth": lambda p: prep.smooth_forward(p, ["x"], 3), "scaler": lambda p: prep.apply_scaler(p, prep.fit_scaler(p, ["x"]), ["x"]), "weights": lambda p: prep.sample_weight(p, [(2, 3.0)]), "fills": lambda p: reduce.fills(p, "x"),
    "limits": lambda p: chain.apply_chain(p.withColumns({"limit_up": F.col("high"), "limit_down": F.col("low"), "price": F.col("close")}), "limitrd"), "quota": lambda p: chain.apply_chain(p, "adjwt:w,0.1,1,0.5,0.1"),
    "positions": lambda p: states.positions(p, 3, 1.0, 0.5), "rolled": lambda p: states.rolled(p, lambda w: w.sum(1), 3), "slope": lambda p: linear.rolling_slope(p, "x", "y", 3), "expression": lambda p: evaluate(p, "(rank (ts_corr x y 4))"), "decay": lambda p: chain.apply_chain(p, "expdecay:0.2|sexpdecay:0.5"),
    "carried": lambda p: carry.carried_price(p, "close", "c"),
}
REST = {
    "daily": lambda p: pnl.daily(p), "summary": lambda p: pnl.summary(pnl.daily(p).withColumn("period", F.lit(1))), "stats": lambda p: pnl.stats(pnl.daily(p)), "cosine": lambda p: pnl.period_cosine(p.withColumn("s", F.col("value")), 3), "chunks": lambda p: pnl.chunked(pnl.daily(p), 2),
    "hedged": lambda p: pnl.hedged(pnl.daily(p), p, 0, 1.0), "group_ic": lambda p: pnl.group_ic(p, "dti"), "per_symbol": lambda p: pnl.per_symbol(p, 0.1, 12), "portfolio": lambda p: pnl.portfolio(p, 0.1, 12), "table": lambda p: market.market_table(p, "g"), "membership": lambda p: market.index_membership(p.select("dti", "ii", F.col("w").alias("weight")), p, 2),
    "rows": lambda p: prep.feature_rows(p, ["x", "y"], "ret", "univ", 0, 9), "ends": lambda p: prep.valid_ends(p, ["x"], "ret", 2), "sequences": lambda p: prep.sequences(p, ["x"], 2), "reductions": lambda p: reduce.by_date(p, "x", "y", "w"),
    "variance": lambda p: risk.implied_variance(p, risk.group_correlations(p, "x", "g", 3), True), "cosines": lambda p: choose.cosines(series(p)), "decorrelated": lambda p: choose.decorrelated(series(p).select("name"), choose.cosines(series(p)), 0.5), "similar": lambda p: choose.similarity(p.where("ii = 0").withColumnRenamed("dti", "t"), "x", "y"),
    "fitted": lambda p: linear.fitted(linear.grams(p, ["x", "y"], "ret"), ["x", "y"], [(0, 4), (0, 8)]), "metrics": lambda p: metrics.summaries(metrics.daily(p, ["base", "tcost", "ic", "ir"], metrics.Setting()), ["base", "tcost", "ic", "ir"], metrics.Setting(), F.col("dti")),
    "deepest": lambda p: metrics.deepest_drawdown(pnl.daily(p)), "differences": lambda p: metrics.cell_differences(p, p.withColumn("value", F.col("x"))), "live": lambda p: live.evaluate_live(p.where("dti < 5"), p.where("dti >= 5"), "(ts_mean x 3)"), "range": lambda p: live.evaluate_range(p, "(ts_std x 3)", 2, 5),
}


@pytest.mark.parametrize("name", CELLS)
def test_cells(panel, name):
    _, p = panel
    out = CELLS[name](p)
    rows = out.collect()
    assert len(rows) == p.count()
    assert not any(isinstance(v, float) and v != v for r in rows for v in r), "missing is NULL"


@pytest.mark.parametrize("name", REST)
def test_others(panel, name):
    kind, p = panel
    rows = REST[name](p).collect()
    assert not any(isinstance(v, float) and v != v for r in rows for v in r)
    if kind == "empty" and name not in ("summary", "stats", "group_ic", "portfolio", "similar", "metrics", "deepest", "differences"):
        assert rows == []
