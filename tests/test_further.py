"""Choices of series, windows in blocks, reach of expressions, linear rolls and metrics, against plain versions."""

from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import choose, linear, metrics, prep, risk, states
from tessera.plans import further, live
from tessera.plans.compile import evaluate
from tessera.sources.panel import write_range


def small(spark, days=60, instruments=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (days, instruments, 2))
    rows = [(d, i, *(None if rng.random() < 0.2 else float(v) for v in x[d, i]), i % 2, bool(rng.random() < 0.9)) for d in range(days) for i in range(instruments)]
    return spark.createDataFrame(rows, "dti int, ii long, x double, y double, g int, univ boolean")


def values(df):
    return {(r.dti, r.ii): None if r.value is None else round(r.value, 9) for r in df.collect()}


def test_decorrelated_is_the_sequential_choice(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(0, 1, (6, 100))
    series = np.stack([base[rng.integers(6)] + rng.normal(0, rng.choice([0.2, 0.8]), 100) for _ in range(40)])
    series[3, 5:20] = np.nan
    rows = [(7 * k, t, float(v)) for k, s in enumerate(series) for t, v in enumerate(s)]
    df = spark.createDataFrame(rows, "name long, t int, value double")

    def cos(a, b):
        ok = np.isfinite(a) & np.isfinite(b)
        return (a[ok] * b[ok]).sum() / np.sqrt((a[ok] ** 2).sum() * (b[ok] ** 2).sum())

    pairs = choose.cosines(df)
    got = {(r.a, r.b): r.cos for r in pairs.collect()}
    assert len(got) == 40 * 39 // 2
    assert all(v == pytest.approx(cos(series[a // 7], series[b // 7])) for (a, b), v in got.items())
    kept: list = []
    for k in range(40):
        if all(cos(series[k], series[j]) <= 0.5 for j in kept):
            kept.append(k)
    found = {r.name: r.kept for r in choose.decorrelated(df.select("name"), pairs, 0.5).collect()}
    assert len(found) == 40 and sorted(n // 7 for n, k in found.items() if k) == kept


def test_windows_in_blocks(spark):
    df = spark.range(20000).select(F.col("id").cast("int").alias("dti"), F.lit(1).cast("long").alias("ii"), F.when(F.col("id") % 997 != 0, F.sin("id")).alias("value"))
    own = df.select("dti", F.col("value").alias("v")).toPandas().sort_values("dti")["v"]
    got = states.rolled(df, lambda w: np.nanmax(w, axis=1), 250, 1000).toPandas().sort_values("dti")["value"]
    want = own.rolling(250, min_periods=1).max().where(np.arange(len(own)) >= 249)
    assert len(got) == len(own) and np.allclose(got, want, equal_nan=True)
    with pytest.raises(ValueError):
        states.rolled(df, np.mean, 250, 100)
    assert states.rolled(df.limit(0), lambda w: w.mean(1), 5).count() == 0


@pytest.mark.parametrize("algo", [2, 3])
def test_positions_by_loop(spark, algo):
    rng = np.random.default_rng(algo)
    x = rng.normal(0, 0.6, 400)
    x[rng.random(400) < 0.1] = np.nan
    for thd, hold in ((0.8, 0.2), (0.5, 0.0), (0.6, -0.1)):
        want, before = [], np.nan
        for v in x:
            if not np.isfinite(v):
                now = np.nan
            elif abs(v) >= thd:
                now = np.sign(v)
            elif before > 0 and v > hold or before < 0 and v < -hold:
                now = before
            elif algo == 3 and before * v > 0:
                now = before / 2
            else:
                now = 0.0
            want.append(now)
            before = now
        df = spark.createDataFrame([(t, 1, None if np.isnan(v) else float(v)) for t, v in enumerate(x)], "dti int, ii long, value double")
        got = states.positions(df, algo, thd, hold).toPandas().sort_values("dti")["value"]
        assert np.allclose(got, want, equal_nan=True)


NESTED = "(ts_mean (ts_std x 6) 5)", "(rank (ts_delta_raw x 3))", "(c_reg y x 4 1)", "(ts_auto_corr_raw x 8 2)", "(g_demean (ts_ema x 5 0.3) g)"


@pytest.mark.parametrize("text", NESTED)
def test_a_range_reads_what_it_depends_on(spark, text, tmp_path):
    df = small(spark, 160)
    full = values(evaluate(df, text).where("dti >= 120 and dti < 130"))
    path = str(tmp_path / "panel")
    df.write.partitionBy("dti").parquet(path)
    stored = spark.read.parquet(path)
    part = live.evaluate_range(stored, text, 120, 130)
    assert values(part) == full
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert f"(dti#" in plan and f">= {120 - live.reach(text)})" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]


def test_reach():
    assert live.reach("x") == 0
    assert live.reach("(rank (add x y))") == 0
    assert live.reach("(ts_mean_raw x 5)") == 4
    assert live.reach("(ts_mean x 5)") == 65
    assert live.reach("(ts_delay_raw (ts_sum_raw x 3) 4)") == 6
    assert live.reach("(ts_auto_corr_raw x 8 2)") == 9


def test_rerun_overwrites_its_range_only(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    df = small(spark, 90)
    text = "(ts_sum_raw x 4)"
    df.write.partitionBy("dti").parquet(source)
    write_range(evaluate(df, text), target)
    late = df.where("dti between 50 and 52").withColumn("x", F.col("x") + 1)
    write_range(late, source)
    live.rerun(spark, source, target, text, 50, 56)
    whole = evaluate(spark.read.parquet(source), text)
    assert values(spark.read.parquet(target)) == values(whole)
    assert values(whole) != values(evaluate(df, text))


@pytest.mark.parametrize("text", NESTED)
def test_live_rows_as_if_appended(spark, text):
    df = small(spark, 100)
    late = df.where("dti >= 97").withColumn("x", F.col("x") * 2).withColumn("y", F.col("y") - 1)
    got, want = values(live.evaluate_live(df, late, text)), {}
    for day in (97, 98, 99):
        rows = df.where(F.col("dti") < day).unionByName(late.where(F.col("dti") == day))
        want |= values(evaluate(rows, text).where(F.col("dti") == day))
    assert got == want and any(v is not None for v in got.values())
    assert live.evaluate_live(df, late.limit(0), text).count() == 0


def test_linear_rolls(spark):
    df = small(spark, 80, 6, 4).withColumn("t", F.col("x") * 0.3 - F.col("y") * 0.2 + F.sin(F.col("dti") * F.col("ii")))
    train, ahead = linear.expanding(0, 40, 15, 80)
    assert train == [(0, 40), (0, 55), (0, 70)] and ahead == [(40, 55), (55, 70), (70, 80)]
    weights = {r.roll: (r.n, r.weights) for r in linear.fitted(linear.grams(df, ["x", "y"], "t"), ["x", "y"], train, 0.1).collect()}
    rows = df.dropna().toPandas()
    for k, (a, b) in enumerate(train):
        own = rows[(rows.dti >= a) & (rows.dti < b)]
        x = own[["x", "y"]].to_numpy()
        want = np.linalg.solve(x.T @ x + 0.1 * np.eye(2), x.T @ own["t"].to_numpy())
        assert weights[k][0] == len(own) and weights[k][1] == pytest.approx(want.tolist())
    none = linear.fitted(linear.grams(df.withColumn("z", F.lit(0.0)), ["z"], "t"), ["z"], train).collect()
    assert all(r.weights is None for r in none)
    assert linear.fitted(linear.grams(df.limit(0), ["x"], "t"), ["x"], train).count() == 0
    fit, ahead = linear.spans_of(prep.rolling_splits(date(2020, 1, 1), date(2023, 12, 31), 1, 0, 1))
    assert fit[0][0] == date(2020, 1, 1) and ahead[0][0] == fit[0][1] and len(fit) == len(ahead) > 2


def test_implied_variance_by_matrix(spark):
    df = small(spark, 48, 6, 7)
    signal = df.select("dti", "ii", F.col("y").alias("value"))
    matrices = risk.group_correlations(df, "x", "g", 12)
    blocks: dict = {}
    for r in matrices.collect():
        blocks.setdefault(r.block, {})[r.ii, r.jj] = r.v
    got = {r.dti: r.variance for r in risk.implied_variance(signal, matrices, True).collect()}
    a = {(r.dti, r.ii): r.value or 0.0 for r in signal.collect()}
    assert len(got) == 48
    for day, v in got.items():
        past = [b for b in blocks if b <= day]
        if not past:
            assert v is None
            continue
        m = blocks[max(past)]
        ids = sorted({i for i, j in m if i == j})
        d = np.diag([m[i, i] for i in ids])
        c = d @ np.array([[m.get((i, j), 0.0) for j in ids] for i in ids]) @ d
        np.fill_diagonal(c, np.diag(c) ** (2 / 3))
        w = np.array([a[day, i] for i in ids])
        w = w / np.abs(w).sum()
        assert v == pytest.approx(w @ c @ w)


def test_drawdown_by_loop(spark):
    rng = np.random.default_rng(1)
    for case in ([0.1, -0.2, -0.1, 0.5], [-0.1, -0.2, 0.5, -0.3], [0.1, 0.2], [-0.1, 0.1, -0.1, 0.1], *rng.normal(0, 1, (6, 40)).tolist()):
        deepest, total, end, begin = (0.0, 0, 0), 0.0, 0, 0
        for k, v in enumerate(case):
            total += v
            if total < 0:
                begin = k if end != k - 1 else begin
                end = k
                if total < deepest[0]:
                    deepest = (total, begin, k)
            else:
                total = 0.0
        df = spark.createDataFrame(list(enumerate(case)), "dti int, ret double")
        (got,) = metrics.deepest_drawdown(df).collect()
        assert got.max_dd == pytest.approx(deepest[0] * 100) and (got.start, got.end) == deepest[1:], case


def test_a_metric_of_ones_own(spark):
    df = small(spark).select("dti", "ii", F.col("x").alias("value"), F.col("y").alias("ret"))
    metrics.metric("largest", lambda c: {"largest": F.max(F.abs("s"))}, None, lambda c: {"largest": F.max("largest")})
    try:
        names = ["base", "largest"]
        days = metrics.daily(df, names, metrics.Setting())
        out = metrics.summaries(days, names, metrics.Setting(), F.floor(F.col("dti") / 20)).collect()
    finally:
        del metrics.METRICS["largest"]
    assert len(out) == 4 and max(r.largest for r in out) == df.agg(F.max(F.abs("value"))).first()[0]


def _uneven(spark):
    """Gaps, groups that change, rows that repeat a date and instrument, one value only, and values without a group."""
    rng, rows = np.random.default_rng(5), []
    for d in range(1, 40):
        for i in range(9):
            g = None if i == 8 and d % 5 == 0 else (i + (d > 6 and i == 2)) % 2
            x = 2.5 if i == 7 else None if rng.random() < 0.25 else float(rng.normal())
            rows += [(d, i, g, x, None if rng.random() < 0.1 else float(rng.normal()))]
            if i == 3 and d % 4 == 0:
                rows.append((d, i, g, float(rng.normal()), 0.5))
    return spark.createDataFrame(rows, "dti int, ii long, g int, x double, value double")


@pytest.mark.parametrize("scaled", [False, True])
def test_panel_variance_is_that_of_all_pairs(spark, monkeypatch, scaled):
    df = _uneven(spark)
    want = {r.dti: r.variance for r in risk.implied_variance(df, risk.group_correlations(df, "x", "g", 12), scaled).collect()}
    for held in (4096, 2):
        monkeypatch.setattr(risk, "HELD", held)
        got = {r.dti: r.variance for r in risk.panel_variance(df, df, "x", "g", 12, scaled).collect()}
        assert got.keys() == want.keys() and sum(v is not None for v in got.values()) == 28
        assert all((v is None) == (got[d] is None) and (v is None or got[d] == pytest.approx(v, rel=1e-9)) for d, v in want.items())
    assert risk.panel_variance(df.limit(0), df.limit(0), "x", "g", 12, scaled).count() == 0
    assert {r.variance for r in risk.panel_variance(df.withColumn("x", F.lit(None).cast("double")), df.withColumn("x", F.lit(None).cast("double")), "x", "g", 12, scaled).collect()} == {None}


@pytest.mark.parametrize("name", ["implied_variance", "implied_variance_scaled"])
def test_implied_variance_makes_no_pairs_of_instruments(spark, monkeypatch, name):
    def pairs(*_):
        raise AssertionError("a row for each two instruments of a group")

    monkeypatch.setattr(risk, "group_correlations", pairs)
    assert further.queries()[name](spark, "/root/testdata/sf0.001").count() == 83
