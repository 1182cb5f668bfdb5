"""Positions that carry on, against a loop over days and instruments."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import carry, chain


def panel(spark, seed, days=150, instruments=12, run=90):
    rng = np.random.default_rng(seed)
    rows = []
    price = np.exp(rng.normal(0, 0.05, (days, instruments)).cumsum(0)) * 20
    price[rng.random((days, instruments)) < 0.1] = np.nan
    price[:5, 0] = np.nan
    signal = rng.normal(0, 1, (days, instruments))
    signal[rng.random((days, instruments)) < 0.15] = np.nan
    locked = rng.random((days, instruments)) < 0.3
    locked[20 : 20 + run, 1] = True  # longer than what is filled elsewhere
    locked[:10, 2] = True
    locked[6, :] = True
    quota = np.where(rng.random((days, instruments)) < 0.7, rng.random((days, instruments)) * 0.2, 0.0)
    none = lambda x: None if math.isnan(x) else float(x)
    for d in range(days):
        for i in range(instruments):
            rows.append((d, i, none(signal[d, i]), none(price[d, i]), bool(locked[d, i]), float(quota[d, i])))
    return spark.createDataFrame(rows, "dti int, ii long, value double, price double, halt boolean, quota double"), signal, price, locked, quota


def limits_by_loop(signal, price, locked, book):
    sig, c = signal.copy(), price.copy()
    for i in range(sig.shape[1]):
        for d in range(1, len(c)):
            if math.isnan(c[d, i]):
                c[d, i] = c[d - 1, i]
    for d in range(len(sig)):
        before = sig[d - 1] if d else np.zeros(sig.shape[1])
        shares = before / c[d - 1] if d else before
        held = np.where(np.isfinite(before), shares, 0.0) * c[d]
        lock = locked[d]
        sig[d, lock] = held[lock]
        fixed, free = sig[d, lock], ~lock & np.isfinite(sig[d])
        up, down = free & (sig[d] > 0), free & (sig[d] < 0)
        with np.errstate(all="ignore"):
            pos = (1e5 - fixed[fixed > 0].sum()) / sig[d, up].sum()
            neg = (-1e5 - fixed[fixed < 0].sum()) / sig[d, down].sum()
        if pos > 0:
            sig[d, up] *= pos
        if neg:
            sig[d, down] *= neg
    scale = book / 1e5
    x = sig * scale / c / 100
    return np.sign(x) * np.floor(np.abs(x) + 0.5) * 100 * c / scale


@pytest.mark.parametrize("seed", [1, 2])
def test_limits_match_a_loop(spark, seed):
    df, signal, price, locked, _ = panel(spark, seed)
    df = df.withColumns({"limit_up_flag": F.lit(False), "limit_down_flag": F.lit(None).cast("boolean"), "extra": F.lit("x")})
    got = chain.apply_chain(df, "limit:limit_up_flag,limit_down_flag,price,1e8")
    assert got.columns == df.columns
    want = limits_by_loop(signal, price, locked, 1e8)
    for r in got.collect():
        w = want[r.dti, r.ii]
        assert (r.value is None and math.isnan(w)) or r.value == pytest.approx(w, abs=1e-6), (r, w)


def weights_by_loop(signal, locked, quota, lo, hi, similarity, step):
    sig = signal.copy()
    for d in range(len(sig)):
        s, q = sig[d].copy(), quota[d]
        lends, cap, low, high = (s < 0) & (q > 0), 0.0, lo, hi
        while high - low >= step:
            mid = (high + low) / 2
            if np.minimum(mid * -s[lends], q[lends]).sum() > similarity * mid:
                low = cap = mid
            else:
                high = mid
        if cap == 0:
            cap = min(q[lends].sum(), lo)
        fixed = locked[d]
        before = sig[d - 1] if d else np.zeros(len(s))
        sig[d, fixed] = np.where(np.isfinite(before), before, 0.0)[fixed]
        short = ~fixed & (s < 0)
        sig[d, short] = np.where(q > 0, np.maximum(s * cap, -q), 0.0)[short]
        rest, long = -(sig[d, short].sum() + sig[d, fixed].sum()), ~fixed & (s > 0)
        if rest >= 0 and long.any():
            sig[d, long] *= rest / s[long].sum()
    return sig


@pytest.mark.parametrize("seed,grid", [(3, (0.1, 2.0, 0.5, 0.01)), (4, (0.3, 0.9, 0.95, 0.05)), (5, (0.2, 0.4, 0.1, 0.5))])
def test_weights_match_a_loop(spark, seed, grid):
    df, signal, _, locked, quota = panel(spark, seed, 100)
    # shorts of a date sum to one, as the rule takes them
    total = np.where(signal < 0, -signal, 0.0).sum(1, keepdims=True)
    signal = signal / np.where(total > 0, total, 1.0)
    flat = {(d, i): None if math.isnan(v) else float(v) for (d, i), v in np.ndenumerate(signal)}
    own = spark.createDataFrame([(d, i, v) for (d, i), v in flat.items()], "dti int, ii long, value double")
    df = df.drop("value").join(own, ["dti", "ii"])
    want = weights_by_loop(signal, locked, quota, *grid)
    for r in chain.apply_chain(df, "adjwt:quota," + ",".join(map(str, grid))).collect():
        w = want[r.dti, r.ii]
        assert (r.value is None and math.isnan(w)) or r.value == pytest.approx(w, abs=1e-9), (r, w)


def test_empty_and_all_locked(spark):
    df, *_ = panel(spark, 1, 8, 3)
    df = df.withColumn("limit_up", F.lit(1e9)).withColumn("limit_down", F.lit(0.0))
    assert chain.apply_chain(df.limit(0), "limitrd").count() == 0
    held = chain.apply_chain(df.withColumn("halt", F.lit(True)), "limitadj").where("value <> 0")
    assert held.count() == 0


def test_no_window_over_all_instruments(spark):
    df, *_ = panel(spark, 1, 8, 3)
    plan = carry.limited(df.withColumn("_price", F.col("price")), F.col("halt"), 1e9, "_price")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(dti" not in plan and plan.count("windowspecdefinition(ii") > 0


@pytest.mark.parametrize("name", ["adjwtlimit", "adjwt"])
def test_no_frame_is_summed_anew_for_each_row_of_a_date(spark, name):
    df = panel(spark, 1, 8, 3)[0].withColumns({"close": F.col("price"), "limit_up": F.lit(1e9), "limit_down": F.lit(0.0)})
    plan = chain.apply_chain(df, f"{name}:quota,0.1,2,0.5,0.01")._jdf.queryExecution().analyzed().toString()
    assert "windowspecdefinition(dti" in plan and "currentrow$(), unboundedfollowing$()" not in plan
