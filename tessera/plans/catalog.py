"""Registered queries over the driver's tables, with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chain, pnl
from ..sources.panel import supplier_panel
from .compile import evaluate

PANEL = """cells AS (SELECT (year(l_shipdate) - 1995) * 12 + month(l_shipdate) AS dti, l_suppkey AS ii,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS cents, sum(CAST(l_quantity AS BIGINT)) AS qty,
        sum(CAST(round(l_extendedprice * 100) AS BIGINT)) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS fresh_cents,
        sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS fresh_qty,
        sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'R') AS back_qty FROM lineitem GROUP BY ALL),
    panel AS (SELECT CAST(d.dti AS INTEGER) AS dti, s.s_suppkey AS ii, CASE WHEN s_nationkey < 3 THEN -1 ELSE s_nationkey % 5 END AS g, s_acctbal > 0 AS univ,
        CAST(fresh_cents AS DOUBLE) / 100 / CAST(fresh_qty AS DOUBLE) / 1000.0123457::DOUBLE - 1.5 AS x,
        CAST(back_qty AS DOUBLE) / 100.0123457::DOUBLE - 0.75 AS y,
        CAST(cents AS DOUBLE) / 100 / CAST(qty AS DOUBLE) / 100000.123457::DOUBLE - 0.015 AS ret
        FROM (SELECT DISTINCT dti FROM cells) d CROSS JOIN supplier s LEFT JOIN cells c ON c.dti = d.dti AND c.ii = s.s_suppkey)"""
PLACES = 5


def _shown(c, places: int = PLACES):
    """Rounded as the SQL rounds: the product with the power of ten as a double, halves away from zero."""
    return F.round(c * 10.0**places) / 10.0**places + F.lit(0.0)


def _expr(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return evaluate(supplier_panel(spark, sf_dir), text).withColumn("value", _shown(F.col("value")))

    return run


def _sql(value: str, more: str = "", source: str = "panel") -> str:
    return f"WITH {PANEL}{more}, out AS (SELECT dti, ii, univ, CAST({value} AS DOUBLE) AS v FROM {source}) SELECT dti, ii, CASE WHEN univ AND isfinite(v) THEN round(v, {PLACES}) + 0.0 END AS value FROM out"


#: Element-wise: name -> (expression, SQL of panel cells x and y)
SCALAR = {
    "abs": ("(abs x)", "abs(x)"), "flip": ("(flip x)", "-x"), "neg": ("(neg x)", "-x"), "inverse": ("(inverse x)", "1 / nullif(x, 0)"), "log": ("(log x)", "CASE WHEN x > -1 THEN ln(x + 1) END"),
    "sigmoid": ("(sigmoid x)", "1 / (1 + exp(-x))"), "sign": ("(sign x)", "sign(x)"), "sinh": ("(sinh (tanh x))", "(exp((exp(2 * x) - 1) / (exp(2 * x) + 1)) - exp(-(exp(2 * x) - 1) / (exp(2 * x) + 1))) / 2"), "tanh": ("(tanh x)", "(exp(2 * x) - 1) / (exp(2 * x) + 1)"),
    "sin": ("(sin x)", "sin(x)"), "cos": ("(cos x)", "cos(x)"), "tan": ("(tan x)", "tan(x)"), "cot": ("(cot (add y 3))", "1 / tan(y + 3)"), "fill_na": ("(fill_na x)", "coalesce(x, 0)"),
    "is_valid": ("(is_valid x)", "x IS NOT NULL"), "const": ("(const 2.5)", "2.5"), "bound": ("(bound x y 0.5)", "coalesce(abs(x - y) <= 0.5, false)"), "pow": ("(pow x 2)", "x * x"),
    "spow": ("(spow x 0.5)", "sign(x) * sqrt(abs(x))"), "pow_int": ("(pow_int x 3)", "x * x * x"), "spow_int": ("(spow_int x 2)", "sign(x) * x * x"), "add": ("(add x y 1)", "x + y + 1"), "sub": ("(sub x y 1)", "x - y - 1"),
    "mul": ("(mul x y 2)", "x * y * 2"), "div": ("(div x y)", "x / nullif(y, 0)"), "plus": ("(+ x y)", "x + y"), "minus": ("(- x y)", "x - y"), "times": ("(* x y)", "x * y"), "over": ("(/ x (add y 9))", "x / (y + 9)"),
    "gt": ("(> x y)", "coalesce(x > y, false)"), "ge": ("(>= x y)", "coalesce(x >= y, false)"), "lt": ("(< x y)", "coalesce(x < y, false)"), "le": ("(<= x y)", "coalesce(x <= y, false)"), "eq": ("(== (sign x) (sign y))", "coalesce(sign(x) = sign(y), false)"), "ne": ("(!= x y)", "coalesce(x <> y, true)"),
    "and": ("(& (> x 0) (> y 0))", "coalesce(x > 0, false) AND coalesce(y > 0, false)"), "or": ("(| (> x 0) (> y 0))", "coalesce(x > 0, false) OR coalesce(y > 0, false)"), "filter_v": ("(filter_v x y)", "CASE WHEN y IS NOT NULL THEN x END"),
    "filter": ("(filter x (> y 0))", "CASE WHEN y > 0 THEN x END"), "max": ("(max x y)", "greatest(x, y)"), "min": ("(min x y)", "least(x, y)"), "diff_date": ("(diff_date (add (max (min dti 28) 1) 20240300) 20240115)", "45 + greatest(least(dti, 28), 1)"), "if": ("(if (> x y) x 7)", "CASE WHEN x > y THEN x ELSE 7 END"),
}

_Z = "(x - avg(x) OVER w) / nullif(stddev_pop(x) OVER w, 0)"
_RANK = "CASE WHEN x IS NOT NULL THEN CASE WHEN count(x) OVER w = 1 THEN 0.5 ELSE (2 * (rank() OVER (PARTITION BY {keys}, x IS NULL ORDER BY x) - 1) + count(x) OVER (PARTITION BY {keys}, x) - 1) / (2.0 * (count(x) OVER w - 1)) END END"
#: Across a date or group, with w as its window: name -> (scalars, SQL)
CROSS = {
    "zscore": ("", _Z), "truncate": ("1", "CASE WHEN x IS NOT NULL THEN least(greatest(x, avg(x) OVER w - stddev_pop(x) OVER w), avg(x) OVER w + stddev_pop(x) OVER w) END"),
    "truncate_u": ("1", "CASE WHEN x IS NOT NULL THEN least(x, avg(x) OVER w + stddev_pop(x) OVER w) END"), "sigwin": ("0.5 1.5", f"CASE WHEN abs({_Z}) > 1.5 THEN NULL WHEN abs({_Z}) > 0.5 THEN sign({_Z}) * 0.5 ELSE {_Z} END"),
    "sigwin_u": ("0.5 1.5", f"CASE WHEN {_Z} > 1.5 THEN NULL WHEN {_Z} > 0.5 THEN 0.5 ELSE {_Z} END"), "rank": ("", _RANK), "demean": ("", "x - avg(x) OVER w"), "scale": ("100", "x * 100 / sum(abs(x)) OVER w"),
    "rankpow": ("2", f"sign(({_RANK}) - 0.5) * (({_RANK}) - 0.5) ** 2"),
}

_LV = "list_filter(l, lambda e: e IS NOT NULL)"
_PAIR = "list_filter(list_zip({a}, {b}), lambda p: p[1] IS NOT NULL AND p[2] IS NOT NULL)"


def _corr(a: str, b: str) -> str:
    p = _PAIR.format(a=a, b=b)
    ma, mb = f"list_avg(list_transform({p}, lambda p: p[1]))", f"list_avg(list_transform({p}, lambda p: p[2]))"
    dot = lambda x, y: f"list_sum(list_transform({p}, lambda p: (p[{x}] - {ma if x == 1 else mb}) * (p[{y}] - {ma if y == 1 else mb})))"
    return f"CASE WHEN len({p}) > 1 AND {dot(1, 1)} > 1e-18 AND {dot(2, 2)} > 1e-18 THEN {dot(1, 2)} / sqrt({dot(1, 1)} * {dot(2, 2)}) END"


_POS = "list_transform(range(1, len(l) + 1), lambda k: CAST(k AS DOUBLE))"
_STD, _MEAN = f"list_stddev_pop({_LV})", f"list_avg({_LV})"
_EMA = "list_reduce(l, lambda a, e: CASE WHEN a IS NOT NULL AND e IS NOT NULL THEN {step} ELSE e END)"
_BELOW = f"len(list_filter({_LV}, lambda e: e < x)) * 2 + len(list_filter({_LV}, lambda e: e = x)) - 1"
#: Trailing, on the frame's cells l (of x) and m (of y): name -> (inputs, scalars, rows, SQL)
SERIES = {
    "ts_min": ("x", "7", 7, f"list_min({_LV})"), "ts_max": ("x", "7", 7, f"list_max({_LV})"), "ts_mean": ("x", "7", 7, _MEAN), "ts_std": ("x", "7", 7, _STD), "ts_sum": ("x", "7", 7, f"list_sum({_LV})"), "ts_prod": ("x", "7", 7, f"list_product({_LV})"),
    "ts_rmean": ("x", "7", 7, f"list_sum(list_transform(range(1, len(l) + 1), lambda k: coalesce(l[k], 0) * CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)) / len({_LV})"), "ts_mean_dev": ("x", "7", 7, f"list_sum(list_transform({_LV}, lambda e: abs(e - {_MEAN})))"),
    "ts_zscore": ("x", "7", 7, f"(x - {_MEAN}) / nullif({_STD}, 0)"), "ts_demean": ("x", "7", 7, f"x - {_MEAN}"), "ts_central_moment": ("x", "7 2", 7, f"CASE WHEN len({_LV}) = len(l) THEN list_sum(list_transform(l, lambda e: (e - {_MEAN}) ** 2)) END"),
    "ts_delay": ("x", "4", 5, "l[1]"), "ts_delta2": ("x", "4", 5, "x - l[1]"), "ts_delta": ("x", "5", 5, "x - l[1]"), "ts_corr_step": ("x", "7", 7, _corr("l", _POS)), "ts_corr": ("x y", "7", 7, _corr("l", "m")),
    "ts_auto_corr": ("x", "7 2", 9, _corr("l[:greatest(len(l) - 2, 0)]", "l[3:]")), "ts_ema": ("x", "7 0.3", 7, _EMA.format(step="e * 0.3 + a * 0.7")), "ts_sma": ("x", "7 4 1", 7, _EMA.format(step="e * 0.25 + a * 0.75")),
    "ts_wma": ("x", "7", 7, _EMA.format(step="e + a * 0.9")), "ts_decay_linear": ("x", "7", 7, "list_sum(list_transform(range(1, len(l) + 1), lambda k: coalesce(l[k], 0) * k)) / list_sum(list_transform(range(1, len(l) + 1), lambda k: CASE WHEN l[k] IS NULL THEN 0 ELSE k END))"),
    "ts_cov": ("x y", "7", 7, f"list_avg(list_transform({_PAIR.format(a='l', b='m')}, lambda p: p[1] * p[2])) - list_avg(list_transform({_PAIR.format(a='l', b='m')}, lambda p: p[1])) * list_avg(list_transform({_PAIR.format(a='l', b='m')}, lambda p: p[2]))"),
    "ts_sum_if": ("x (> y 0)", "7", 7, "coalesce(list_sum(list_transform(list_filter(list_zip(l, m), lambda p: coalesce(p[2] <> 0, true) AND p[1] IS NOT NULL), lambda p: p[1])), 0)"), "ts_argmax": ("x", "7", 7, "len(l) - list_position(l, list_max(l))"), "ts_high_day": ("x", "7", 7, "len(l) - list_position(l, list_max(l))"),
    "ts_argmin": ("x", "7", 7, "len(l) - list_position(l, list_min(l))"), "ts_low_day": ("x", "7", 7, "len(l) - list_position(l, list_min(l))"), "ts_rank": ("x", "7", 7, f"CASE WHEN len({_LV}) = 1 THEN 0.5 ELSE ({_BELOW}) / (2.0 * (len({_LV}) - 1)) END"),
}
RAW_ONLY = {"ts_count_v": ("x", "7", 7, f"len({_LV})"), "ts_count": ("(> x 0)", "7", 7, "len(list_filter(l, lambda e: coalesce(e <> 0, true)))"), "ts_idx": ("x (* (> y 0) 3)", "7", 7, "CASE WHEN y > 0 THEN CASE WHEN len(l) >= 4 THEN l[-4] END ELSE l[-1] END")}


def _series_sql(inputs: str, rows: int, value: str, raw: bool, always: bool = False) -> str:
    two = " " in inputs
    y = "coalesce(y > 0, false)::DOUBLE" if "(> y 0)" in inputs else "y"
    x = "coalesce(x > 0, false)::DOUBLE" if inputs == "(> x 0)" else "x"
    more = f""", base AS (SELECT dti, ii, univ, {x} AS x, {y} AS yy, y, row_number() OVER (PARTITION BY ii ORDER BY dti) AS t FROM panel)"""
    valid = "true" if always else "x IS NOT NULL" if raw or not two else "x IS NOT NULL AND yy IS NOT NULL"
    if raw:
        part, cells = "ii", "base"
        lx, ly = "x", "yy"
    else:
        ends = ", ".join(f"{f}({v} IGNORE NULLS) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN {r}) AS {n}" for c in ("x", "yy") for v, k in ((c, c), (f"CASE WHEN {c} IS NOT NULL THEN t END", f"t{c}")) for f, r, n in (("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", f"{k}0"), ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING", f"{k}1")))
        full = lambda c: f"coalesce({c}, CASE WHEN t{c}1 - t{c}0 - 1 <= 60 THEN {c}0 + ({c}1 - {c}0) * (t - t{c}0) / (t{c}1 - t{c}0) END)"
        more += f", ends AS (SELECT *, {ends} FROM base), filled AS (SELECT *, {full('x')} AS fx, {full('yy')} AS fy FROM ends), gaps AS (SELECT *, {'fx IS NULL OR fy IS NULL' if two else 'fx IS NULL'} AS brk FROM filled), cut AS (SELECT *, sum(brk::INT) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) AS seg FROM gaps)"
        part, cells, lx, ly = "ii, seg, brk", "cut", "fx", "fy"
    more += f", framed AS (SELECT *, list({lx}) OVER f AS l, list({ly}) OVER f AS m FROM {cells} WINDOW f AS (PARTITION BY {part} ORDER BY dti ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW))"
    return _sql(f"CASE WHEN {valid} THEN {value} END", more, "framed")


def _expressions() -> tuple[dict, dict]:
    run, sql = {}, {}
    for name, (text, value) in SCALAR.items():
        run[f"expr_{name}"], sql[f"expr_{name}"] = _expr(text), _sql(value)
    only = ", masked AS (SELECT dti, ii, g, univ, CASE WHEN univ THEN x END AS x FROM panel)"
    for name, (scalars, value) in CROSS.items():
        w = " WINDOW w AS (PARTITION BY {})"
        if name != "rankpow":
            for prefix in ("", "c_"):
                run[f"expr_{prefix}{name}"] = _expr(f"({prefix}{name} x {scalars})")
                sql[f"expr_{prefix}{name}"] = _sql(value.replace("{keys}", "dti"), only, "masked" + w.format("dti"))
        if name != "scale":
            run[f"expr_g_{name}"] = _expr(f"(g_{name} x {scalars} g)")
            own = only + ", own AS (SELECT * REPLACE (CASE WHEN g >= 0 THEN x END AS x) FROM masked)"
            sql[f"expr_g_{name}"] = _sql(value.replace("{keys}", "dti, g"), own, "own" + w.format("dti, g"))
    for name, (inputs, scalars, rows, value) in SERIES.items():
        run[f"expr_{name}"], sql[f"expr_{name}"] = _expr(f"({name} {inputs} {scalars})"), _series_sql(inputs, rows, value, False)
        raw = _STD if name in ("ts_zscore", "ts_demean") else value
        run[f"expr_{name}_raw"], sql[f"expr_{name}_raw"] = _expr(f"({name}_raw {inputs} {scalars})"), _series_sql(inputs, rows, raw, True)
    for name, (inputs, scalars, rows, value) in RAW_ONLY.items():
        run[f"expr_{name}"], sql[f"expr_{name}"] = _expr(f"({name} {inputs} {scalars})"), _series_sql(inputs, rows, value, True, name == "ts_count")
    both = "CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN {} END"
    run["expr_ts_reg"] = _expr("(ts_reg y x 7 1)")
    sql["expr_ts_reg"] = _sql(both.format(f"sum({both.format('x * y')}) OVER w / sum({both.format('x * x')}) OVER w"), "", "panel WINDOW w AS (PARTITION BY ii ORDER BY dti ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)")
    run["expr_c_reg"] = _expr("(c_reg y x 3 1)")
    day = ", days AS (SELECT dti, sum(x * y) AS xy, sum(CASE WHEN y IS NOT NULL THEN x * x END) AS xx FROM panel WHERE univ GROUP BY dti), fit AS (SELECT dti, sum(xy) OVER w / sum(xx) OVER w AS b FROM days WINDOW w AS (ORDER BY dti RANGE BETWEEN 2 PRECEDING AND CURRENT ROW))"
    sql["expr_c_reg"] = _sql("CASE WHEN y IS NOT NULL THEN b END", day, "panel JOIN fit USING (dti)")
    run["expr_ts_sum_max_pct"] = _expr("(ts_sum_max_pct x y 7 0.5)")
    run["expr_ts_sum_max_pct_raw"] = _expr("(ts_sum_max_pct_raw x y 7 0.5)")
    run["expr_let"] = _expr("(let m (ts_mean x 5)); (rank (sub x m))")
    return run, sql


def _chain(text: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = supplier_panel(spark, sf_dir).withColumn("value", F.col("x"))
        return chain.apply_chain(df, text).select("dti", "ii", _shown(F.col("value")).alias("value"))

    return run


def _chain_sql(value: str, more: str = "", source: str = "panel") -> str:
    return f"WITH {PANEL}{more}, out AS (SELECT dti, ii, CAST({value} AS DOUBLE) AS v FROM {source}) SELECT dti, ii, CASE WHEN isfinite(v) THEN round(v, {PLACES}) + 0.0 END AS value FROM out"


_D, _I = "panel WINDOW w AS (PARTITION BY dti)", "panel WINDOW w AS (PARTITION BY ii ORDER BY dti)"
_U = ", u AS (SELECT dti, ii, univ, g, CASE WHEN univ THEN x END AS x FROM panel)"
def _trailing_sql(value: str, rows: int, source: str = "panel") -> str:
    """``value`` over l, the last rows of the signal, its gaps of up to 60 rows filled, from the first present one on."""
    ends = ", ".join(f"{f}({v} IGNORE NULLS) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN {r}) AS {n}{k}" for v, n in (("x", "x"), ("CASE WHEN x IS NOT NULL THEN t END", "t")) for f, r, k in (("last_value", "UNBOUNDED PRECEDING AND CURRENT ROW", 0), ("first_value", "CURRENT ROW AND UNBOUNDED FOLLOWING", 1)))
    more = f""", base AS (SELECT dti, ii, x, row_number() OVER (PARTITION BY ii ORDER BY dti) AS t FROM {source}), ends AS (SELECT *, {ends} FROM base),
        filled AS (SELECT *, coalesce(x, CASE WHEN t1 - t0 - 1 <= 60 THEN x0 + (x1 - x0) * (t - t0) / (t1 - t0) END) AS fx FROM ends), runs AS (SELECT *, fx IS NULL AS gap, count(*) FILTER (fx IS NULL) OVER (PARTITION BY ii ORDER BY dti ROWS UNBOUNDED PRECEDING) AS run FROM filled),
        framed AS (SELECT * EXCLUDE (l0), l0[list_position(list_transform(l0, lambda e: e IS NOT NULL), true):] AS l FROM (SELECT *, list(fx) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN {rows - 1} PRECEDING AND CURRENT ROW) AS l0 FROM runs))"""
    return _chain_sql(f"CASE WHEN x IS NOT NULL THEN {value} END", more, "framed")


#: Trailing operations that are the function of that name on filled rows
_AS_SERIES = {"tsmin": "ts_min", "tsmax": "ts_max", "tssum": "ts_sum", "tsprod": "ts_prod", "tsmean": "ts_mean", "tsstd": "ts_std", "tsmeandev": "ts_mean_dev", "tsrmean": "ts_rmean", "tsargmin": "ts_argmin", "tsargmax": "ts_argmax", "tscorrstep": "ts_corr_step", "tsdecaylinear": "ts_decay_linear", "tsdemean": "ts_demean", "tszscore": "ts_zscore", "tsrank": "ts_rank", "tsema": "ts_ema"}
_TRAILING = {name: _trailing_sql(SERIES[same][3], 5) for name, same in _AS_SERIES.items()}
_TRAILING["tscount"] = _trailing_sql(RAW_ONLY["ts_count"][3], 5)
_TRAILING["tsdemean2"] = _trailing_sql(f"x - (list_sum({_LV}) - x) / nullif(len({_LV}) - 1, 0)", 5)
_TRAILING["tsdelta"] = _trailing_sql(SERIES["ts_delta"][3], 6)
_ROOM = """, w AS (SELECT dti, ii, x, CASE WHEN x > 1e-6 THEN x / sum(x) FILTER (x > 1e-6) OVER (PARTITION BY dti) END AS w, y * 0.04 AS b FROM panel),
    c AS (SELECT *, coalesce(w > b, false) AS above, w IS NOT NULL AND NOT coalesce(w > b, false) AS free, coalesce(b - w, 1e300) AS room, coalesce(sum(w - b) FILTER (w > b) OVER (PARTITION BY dti), 0) AS cut FROM w),
    k AS (SELECT *, count(*) OVER (PARTITION BY dti, free) - row_number() OVER (PARTITION BY dti, free ORDER BY room, ii) + 1 AS n FROM c),
    a AS (SELECT *, greatest(0, least(room, (cut - coalesce(sum(n * room) OVER (PARTITION BY dti, free ORDER BY room, ii ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / n)) AS more FROM k),
    r AS (SELECT *, w + sum(more) OVER (PARTITION BY dti, free ORDER BY room, ii ROWS UNBOUNDED PRECEDING) AS raised FROM a)"""
#: Operations: name -> (chain, SQL or None)
CHAINS = {
    "neg": ("neg", _chain_sql("-x")), "add": ("add:2", _chain_sql("x + 2")), "multiply": ("multiply:3", _chain_sql("x * 3")), "log": ("add:9|log", _chain_sql("ln(x + 9)")), "inverse": ("add:9|inverse", _chain_sql("1 / (x + 9)")), "pow": ("pow:2", _chain_sql("sign(x) * x * x")),
    "clip": ("clip:0.2", _chain_sql("CASE WHEN x IS NOT NULL THEN least(greatest(x, -0.2), 0.2) END")), "tozero": ("tozero:-0.1,0.2", _chain_sql("CASE WHEN x > -0.1 AND x < 0.2 THEN 0 ELSE x END")), "same": ("same:0.1", _chain_sql("CASE WHEN x > 0.1 THEN 1 END")), "fillna": ("fillna", _chain_sql("coalesce(x, 0)")),
    "ffillna": ("ffillna", _chain_sql("coalesce(x, CASE WHEN count(x) OVER (w ROWS UNBOUNDED PRECEDING) > 0 THEN 0 END)", "", _I)), "forwardfill": ("forwardfill:2", _chain_sql("coalesce(x, lag(x, 1) OVER w, lag(x, 2) OVER w)", "", _I)), "delay": ("delay:2", _chain_sql("lag(x, 2) OVER w", "", _I)), "delay_lead": ("delay:-1", _chain_sql("lead(x, 1) OVER w", "", _I)),
    "rank": ("rank", _chain_sql(_RANK.replace("{keys}", "dti"), _U, "u WINDOW w AS (PARTITION BY dti)")), "powrank": ("powrank:2", _chain_sql(CROSS["rankpow"][1].replace("{keys}", "dti"), _U, "u WINDOW w AS (PARTITION BY dti)")), "scale": ("scale:100", _chain_sql("x * 100 / sum(abs(x)) OVER w", _U, "u WINDOW w AS (PARTITION BY dti)")),
    "scaleraw": ("scaleraw:100", _chain_sql("x * 100 / sum(abs(x)) OVER w", "", _D)), "scalebound": ("scalebound:5", _chain_sql("CASE WHEN sum(abs(x)) OVER w > 5 THEN x * 5 / sum(abs(x)) OVER w ELSE x END", "", _D)), "neut": ("neut:g", _chain_sql("CASE WHEN g >= 0 THEN x - avg(x) OVER (PARTITION BY dti, g) END")), "gmom": ("gmom:g", _chain_sql("CASE WHEN g >= 0 AND x IS NOT NULL THEN avg(x) OVER (PARTITION BY dti, g) END")),
    "univ": ("univ", _chain_sql("CASE WHEN univ THEN x END")), "reject": ("reject:g", _chain_sql("CASE WHEN g = 0 THEN x END")), "best": ("best:5", _chain_sql("CASE WHEN row_number() OVER (PARTITION BY dti ORDER BY x DESC NULLS LAST, ii) <= 5 THEN x END")), "upbound": ("upbound:3", None), "hedge": ("hedge:0,50", _chain_sql("CASE WHEN ii = 50 THEN -sum(CASE WHEN ii < 50 THEN greatest(x, 0) END) OVER w WHEN ii < 50 AND x < 0 THEN 0 ELSE x END", "", _D)),
    "hedgeshort": ("hedgeshort:0,50", _chain_sql("CASE WHEN ii = 50 THEN sum(CASE WHEN ii < 50 THEN greatest(-x, 0) END) OVER w WHEN ii < 50 AND x > 0 THEN 0 ELSE x END", "", _D)), "hedgesig": ("hedgesig:3", _chain_sql("x - coalesce(max(CASE WHEN ii = 3 THEN x END) OVER w, 0)", "", _D)), "expdecay": ("expdecay:0.3", None), "sexpdecay": ("sexpdecay:0.3", None), "boundsize": ("boundsize:0.05", None), "neutidx": ("neutidx:y,g", None),
    "bounddvol": ("bounddvol:y,25,1", _chain_sql("CASE WHEN free THEN raised WHEN above THEN b WHEN isfinite(x) THEN 0 END", _ROOM, "r")),
    **{name: (f"{name}:5" + (",0.3" if name == "tsema" else ""), _TRAILING.get(name)) for name in chain.BUILD},
}


def _held(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = supplier_panel(spark, sf_dir).withColumn("value", F.col("x"))
    return chain.apply_chain(panel, "rank|add:-0.5|fillna|multiply:1000")


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.daily(_held(spark, sf_dir), 1000.0, 0.0001, 0.0011)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[_shown(F.col(c)).alias(c) if t == "double" else c for c, t in df.dtypes])


def pnl_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_days(spark, sf_dir))


_HELD = f"""held AS (SELECT dti, ii, ret AS r, coalesce(({_RANK.replace('{keys}', 'dti').replace('OVER w', 'OVER (PARTITION BY dti)')}) - 0.5, 0) * 1000 AS s FROM (SELECT dti, ii, ret, CASE WHEN univ THEN x END AS x FROM panel)),
    moved AS (SELECT dti, s, coalesce(r, 0) AS r, coalesce(lag(s) OVER o, 0) AS p, CASE WHEN lag(s) OVER o IS NULL THEN 0 ELSE s - lag(s) OVER o END AS trade FROM held WINDOW o AS (PARTITION BY ii ORDER BY dti)),
    days AS (SELECT dti, count(*) FILTER (s > 0) AS long_count, count(*) FILTER (s < 0) AS short_count, coalesce(sum(s) FILTER (s > 0), 0) AS long_val, coalesce(sum(s) FILTER (s < 0), 0) AS short_val, sum(abs(trade)) AS trade_val,
        sum(p * r) AS gross, coalesce(sum(p * r) FILTER (p > 0), 0) AS long_pnl, coalesce(sum(p * r) FILTER (p < 0), 0) AS short_pnl, -0.0001 * coalesce(sum(trade) FILTER (trade > 0), 0) + 0.0011 * coalesce(sum(trade) FILTER (trade < 0), 0) AS tcost,
        sum(p * r) / nullif(sqrt(sum(p * p) * sum(r * r)), 0) AS ic FROM moved GROUP BY dti),
    full_days AS (SELECT *, gross + tcost AS pnl, (gross + tcost) / 1000 AS ret, trade_val / 1000 AS tvr FROM days)"""


def _numbers(names: list[str]) -> str:
    return ", ".join(f"round({c}, {PLACES}) + 0.0 AS {c}" for c in names)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly profit and loss of a ranked signal, and the total."""
    days = _days(spark, sf_dir).withColumn("period", F.floor((F.col("dti") - 1) / 12).cast("int") + 1995)
    return _rounded(pnl.summary(days, 12, 1000.0))


_DRAW = "dd AS (SELECT *, cum - greatest(0, max(cum) OVER (ORDER BY dti ROWS UNBOUNDED PRECEDING)) AS dd FROM (SELECT *, sum(ret) OVER (ORDER BY dti ROWS UNBOUNDED PRECEDING) AS cum FROM full_days))"


def pnl_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pnl.stats(_days(spark, sf_dir), 12))


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.bars(spark.read.parquet(f"{sf_dir}/events.parquet")).select("user_id", F.col("bucket").cast("string").alias("bucket"), "last", "high", "low", "n", "n_day", "high_day", "low_day")


def top_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.universe(supplier_panel(spark, sf_dir).withColumn("dvol", F.coalesce("y", F.lit(0.0)) + 1), 30, 6, 0.6, 12).withColumn("in_univ", F.col("in_univ").cast("int"))


def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = supplier_panel(spark, sf_dir)
    a, b = (panel.select("dti", "ii", F.col(c).alias("value")) for c in ("x", "y"))
    return _rounded(pnl.combine([a, b], [2.0, 1.0], mean=True))


def queries() -> dict:
    out, _ = _expressions()
    out |= {f"op_{name}": _chain(text) for name, (text, _) in CHAINS.items()}
    return out | {f.__name__: f for f in (flagship, pnl_daily, pnl_stats, event_bars, top_universe, combined)}


def oracle_sql() -> dict[str, str]:
    _, out = _expressions()
    out |= {f"op_{name}": sql for name, (_, sql) in CHAINS.items() if sql}
    money = ["long_val", "short_val", "trade_val", "gross", "long_pnl", "short_pnl", "tcost", "ic", "pnl", "ret", "tvr"]
    out["pnl_daily"] = f"WITH {PANEL}, {_HELD} SELECT dti, long_count, short_count, {_numbers(money)} FROM full_days"
    out["flagship"] = f"""WITH {PANEL}, {_HELD}, {_DRAW}, y AS (SELECT CAST(floor((dti - 1) / 12) AS INTEGER) + 1995 AS period, * FROM dd),
        s AS (SELECT period, count(*) AS days, avg(long_count) AS long_count, avg(short_count) AS short_count, sum(pnl) AS pnl, avg(ret) * 12 AS ret_y, avg(tvr) AS tvr, avg(ic) AS ic, avg(ret) / nullif(stddev_samp(ret), 0) AS ir,
            count(*) FILTER (ret > 0) AS up_days, count(*) FILTER (ret < 0) AS down_days, min(dd) * 100 AS max_dd FROM y GROUP BY ROLLUP (period))
        SELECT period, days, up_days, down_days, {_numbers(['long_count', 'short_count', 'pnl', 'ret_y', 'tvr', 'ic', 'ir', 'max_dd'])} FROM s"""
    out["event_bars"] = """WITH b AS (SELECT user_id, time_bucket(INTERVAL 5 MINUTE, ts) AS bucket, max_by(value, (ts, event_id)) AS last, max(value) AS high, min(value) AS low, count(*) AS n FROM events GROUP BY ALL)
        SELECT user_id, strftime(bucket, '%Y-%m-%d %H:%M:%S') AS bucket, last, high, low, n, CAST(sum(n) OVER d AS BIGINT) AS n_day, max(high) OVER d AS high_day, min(low) OVER d AS low_day FROM b WINDOW d AS (PARTITION BY user_id, CAST(bucket AS DATE) ORDER BY bucket ROWS UNBOUNDED PRECEDING)"""
    out["combined"] = f"WITH {PANEL} SELECT dti, ii, round((coalesce(2 * x, 0) + coalesce(y, 0)) / nullif(CASE WHEN x IS NULL THEN 0 ELSE 2 END + CASE WHEN y IS NULL THEN 0 ELSE 1 END, 0), {PLACES}) + 0.0 AS value FROM panel"
    out["top_universe"] = f"""WITH {PANEL}, m AS (SELECT dti, ii, avg(coalesce(y, 0) + 1) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS m FROM panel),
        p AS (SELECT dti, ii, CASE WHEN row_number() OVER (PARTITION BY dti ORDER BY m DESC NULLS LAST, ii) <= 30 AND m > 0 THEN 1 ELSE 0 END AS ok FROM m)
        SELECT dti, ii, CAST(avg(ok) OVER (PARTITION BY ii ORDER BY dti ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 0.6 AS INTEGER) AS in_univ FROM p"""
    return out
