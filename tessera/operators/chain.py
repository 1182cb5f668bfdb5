"""Chains of signal operations, ``rank|neut:g|scale:100``: each takes and gives a signal column ``value``.

Operations on one date or one instrument are window expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import cross, series
from ..functions.guards import INF, div, fin, power
from ..plans.compile import Plan
from . import carry


def val() -> Column:
    return F.col("value")


def day():
    return Window.partitionBy("dti")


def history():
    return Window.partitionBy("ii").orderBy("dti")


OPS: dict[str, Callable[..., DataFrame]] = {}


def op(*names: str):
    def put(f):
        OPS.update(dict.fromkeys(names, f))
        return f

    return put


def cell(*names: str):
    """An operation that is an expression of the signal: (arguments) -> column."""

    def put(f):
        OPS.update(dict.fromkeys(names, lambda df, *a: df.withColumn("value", f(*a))))
        return f

    return put


def parse_chain(text: str) -> list[tuple[str, list[str]]]:
    out = []
    for part in filter(None, (p.strip() for p in text.split("|"))):
        name, *args = part.split(":")
        out.append((name, [a for x in args for a in x.split(",")]))
    return out


def apply_chain(signal: DataFrame, chain: str) -> DataFrame:
    """The operations in order on ``signal`` (dti, ii, value and what they read: g, univ, ...)."""
    df = signal.withColumn("value", fin(val().cast("double")))
    for name, args in parse_chain(chain):
        if name not in OPS:
            raise ValueError(f"unknown operation {name}")
        df = OPS[name](df, *args)
    return df


@cell("neg", "flip")
def _neg():
    return -val()


@cell("add")
def _add(v):
    return val() + float(v)


@cell("multiply")
def _multiply(v):
    return val() * float(v)


@cell("log")
def _log():
    return F.when(val() > 0, F.ln(F.when(val() > 0, val()))).when(val() == 0, -INF)


@cell("inverse")
def _inverse():
    return F.when(val() == 0, INF).otherwise(1 / F.when(val() != 0, val()))


@cell("pow")
def _pow(e):
    return F.signum(val()) * power(F.abs(val()), float(e))


def _bounds(lo, hi):
    return (-abs(float(lo)), abs(float(lo))) if hi is None else (float(lo), float(hi))


@cell("clip")
def _clip(lo, hi=None):
    lo, hi = _bounds(lo, hi)
    return F.when(val().isNotNull(), F.least(F.greatest(val(), F.lit(lo)), F.lit(hi)))


@cell("tozero")
def _tozero(lo, hi=None):
    lo, hi = _bounds(lo, hi)
    return F.when((val() > lo) & (val() < hi), 0.0).otherwise(val())


@cell("same")
def _same(least):
    return F.when(val() > float(least), 1.0)


@cell("fillna")
def _fillna():
    return F.coalesce(fin(val()), F.lit(0.0))


@cell("ffillna")
def _ffillna():
    seen = F.max(fin(val()).isNotNull()).over(history().rowsBetween(Window.unboundedPreceding, 0))
    return F.when(fin(val()).isNotNull(), val()).when(seen, 0.0)


@op("forwardfill")
def _forwardfill(df, n=100):
    t = F.row_number().over(history())
    df = df.withColumn("_t", t).withColumn("_at", F.when(fin(val()).isNotNull(), F.col("_t")))
    back = history().rowsBetween(Window.unboundedPreceding, 0)
    old = F.when(F.col("_t") - F.last("_at", True).over(back) <= int(n), F.last(fin(val()), True).over(back))
    return df.withColumn("value", F.coalesce(fin(val()), old)).drop("_t", "_at")


@cell("delay")
def _delay(n):
    return F.lag(val(), int(n)).over(history()) if int(n) >= 0 else F.lead(val(), -int(n)).over(history())


def _masked(df, mask="univ"):
    return df.withColumn("value", F.when(F.col(mask), fin(val())))


def _ranked(df, make, name="value"):
    plan = Plan(df, None)
    made = make(plan.keep)
    return plan.df.withColumn(name, made).select(*df.columns, *([name] if name not in df.columns else []))


@op("rank")
def _rank(df, tie=0.0):
    """Ranks from 0 to 1; equal values share one, and with a ``tie`` neighbours in order whose relative difference is at most that."""
    tie = float(tie)
    return _ranked(_masked(df), lambda keep: cross.rank_near(val(), [tie], ["dti"], keep) if tie else cross.rank(val(), [], ["dti"]))


@op("powrank")
def _powrank(df, e, tie=0.0):
    e, tie = float(e), float(tie)
    return _ranked(_masked(df), lambda keep: cross.rankpow_near(val(), [e, tie], ["dti"], keep) if tie else cross.rankpow(val(), [e], ["dti"]))


@op("scale")
def _scale(df, s=200000):
    return _masked(df).withColumn("value", cross.scale(val(), [float(s)], ["dti"]))


@cell("scaleraw")
def _scaleraw(s=200000):
    return cross.scale(fin(val()), [float(s)], ["dti"])


@cell("scalebound")
def _scalebound(b):
    total = F.sum(F.abs(fin(val()))).over(day())
    return F.when(total > float(b), val() * float(b) / total).otherwise(val())


def _grouped(df, group, make):
    g = F.col(group)
    own = Window.partitionBy("dti", group)
    some = F.coalesce(F.max(g).over(day()) >= 0, F.lit(False))
    return df.withColumn("value", F.when(some, F.when(g >= 0, make(fin(val()), own))).otherwise(val()))


@op("neut")
def _neut(df, group="g"):
    return _grouped(df, group, lambda x, w: x - F.avg(x).over(w))


@op("gmom")
def _gmom(df, group="g"):
    return _grouped(df, group, lambda x, w: F.when(x.isNotNull(), F.avg(x).over(w)))


@op("neutidx")
def _neutidx(df, weight, group="g"):
    """Weights of the groups become those of an index (column ``weight``); rows without a group are dropped from the signal."""
    own, g = Window.partitionBy("dti", group), F.col(group)
    mine, total = F.sum(F.abs(fin(val()))).over(own), F.sum(F.when(g >= 0, F.abs(fin(val())))).over(day())
    theirs, all_theirs = F.sum(F.when(g >= 0, F.col(weight))).over(own), F.sum(F.when(g >= 0, F.col(weight))).over(day())
    return df.withColumn("value", F.when((g >= 0) & (mine > 0) & (all_theirs > 0), val() * theirs / all_theirs * total / F.when(mine > 0, mine)))


@op("univ")
def _univ(df, name="univ"):
    return _masked(df, name)


@op("reject")
def _reject(df, state):
    return df.withColumn("value", F.when(F.coalesce(F.col(state) == 0, F.lit(True)), val()))


@op("best")
def _best(df, k):
    order = F.row_number().over(day().orderBy(fin(val()).desc_nulls_last(), "ii"))
    return df.withColumn("value", F.when(order <= int(k), fin(val())))


@op("upbound")
def _upbound(df, k):
    """Winsorized at the k-th value from each end, shifted to 0 and scaled to a mean of one half; with fewer than 2k values, ranks."""
    k = int(k)
    x = fin(val())
    df = df.withColumn("_n", F.count(x).over(day())).withColumn("_up", F.row_number().over(day().orderBy(x.asc_nulls_last(), "ii"))).withColumn("_down", F.row_number().over(day().orderBy(x.desc_nulls_last(), "ii")))
    lo, hi = F.max(F.when(F.col("_up") == k, x)).over(day()), F.max(F.when(F.col("_down") == k, x)).over(day())
    df = df.withColumn("_c", F.when(x.isNotNull(), F.least(F.greatest(x, lo), hi) - lo))
    df = _ranked(df, lambda keep: cross.rank(x, [], ["dti"], keep), "_r")
    mean = F.avg("_c").over(day())
    return df.withColumn("value", F.when(F.col("_n") < 2 * k, F.col("_r")).otherwise(F.when(mean > 0, F.col("_c") * 0.5 / F.when(mean > 0, mean)).otherwise(F.col("_c")))).drop("_n", "_up", "_down", "_c", "_r")


#: Columns of the index instruments by name, as offsets from the first.
#: Value of the book in signals, and steps of ``risk``.
SHOWN, MATCHING = 1e5, 200
INDEX = {"csi300": 1, "csi500": 0, "csi1000": 4, "csi2000": 5}


def _hedged(df, index, start, sign):
    k = int(start) + (INDEX[index] if index in INDEX else int(index))
    stock = F.col("ii") < int(start)
    kept = F.when(stock & (sign * val() < 0), 0.0).otherwise(val())
    total = F.sum(F.when(stock, F.greatest(sign * fin(val()), F.lit(0.0)))).over(day())
    return df.withColumn("value", F.when(F.col("ii") == k, -sign * F.coalesce(total, F.lit(0.0))).otherwise(kept))


@op("hedge")
def _hedge(df, index, start=5800):
    """Longs stay, shorts of stocks become 0, and the index instrument takes the negative sum."""
    return _hedged(df, index, start, 1)


@op("hedgeshort")
def _hedgeshort(df, index, start=5800):
    return _hedged(df, index, start, -1)


@op("hedgesig")
def _hedgesig(df, ii):
    by = F.max(F.when(F.col("ii") == int(ii), fin(val()))).over(day())
    return df.withColumn("value", F.when(by.isNotNull(), val() - by).otherwise(val()))


def _smoothed(plan: Plan, x: Column, segment: list, r: float) -> Column:
    """acc = x * r + acc * (1 - r) along a segment's rows, from its first row on.

    A running sum of x / (1 - r)^t gives it at the cost of one row, whatever r is.  The
    powers start again in each block of rows that they may reach 1e100 in; what a
    block takes over is the end of the one before, as the blocks before that one
    weigh less than a double holds.
    """
    own = Window.partitionBy("ii", *segment).orderBy("dti")
    if not 0 < r < 1:
        return x if r == 1 else F.first(x).over(own)
    q = 1 - r
    rows = max(1, int(100 * math.log(10) / -math.log(q)))
    t = plan.keep(F.row_number().over(own) - 1)
    block, at = plan.keep(F.floor(t / rows)), plan.keep(F.pmod(t, F.lit(rows)).cast("double"))
    scaled = F.when(t == 0, x / r).otherwise(x) * F.pow(F.lit(1 / q), at)
    line = Window.partitionBy("ii", *segment, block).orderBy("dti").rowsBetween(Window.unboundedPreceding, 0)
    here = plan.keep(F.sum(scaled).over(line) * r * F.pow(F.lit(q), at))
    before = F.last(F.when(at == rows - 1, here), True).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return here + F.coalesce(before * F.pow(F.lit(q), at + 1), F.lit(0.0))


@op("expdecay")
def _expdecay(df, r):
    """Starts again after each missing cell."""
    plan = Plan(df, None)
    x = plan.keep(fin(val()))
    run = plan.keep(F.count(F.when(x.isNull(), 1)).over(history().rowsBetween(Window.unboundedPreceding, 0)))
    out = _smoothed(plan, x, [run, plan.keep(x.isNull())], float(r))
    return plan.df.withColumn("value", F.when(x.isNotNull(), fin(out))).select(df.columns)


@op("sexpdecay")
def _sexpdecay(df, r):
    """Decay over gaps too: between two values the signal is taken to move along a line."""
    plan = Plan(df, None)
    x = plan.keep(fin(val()))
    t = plan.keep(F.row_number().over(history()))
    full = plan.keep(plan.filled(x, t, history(), math.inf))
    out = _smoothed(plan, full, [plan.keep(full.isNull())], float(r))
    return plan.df.withColumn("value", F.when(x.isNotNull(), fin(out))).select(df.columns)


@op("boundsize")
def _boundsize(df, b):
    """Positive weights capped at max(1/n, b) of their total; what is cut off goes to the others by weight, until none is above.

    In falling order the first k are capped, for the smallest k that leaves the
    next, once scaled, below the cap.
    """
    plan = Plan(df, None)
    x = plan.keep(F.when(fin(val()) > 0, fin(val())))
    own = Window.partitionBy("dti", x.isNotNull())
    line = own.orderBy(x.desc(), "ii")
    n, total = plan.keep(F.count(x).over(own)), plan.keep(F.sum(x).over(own))
    cap = F.greatest(1 / F.when(n > 0, n), F.lit(float(b))) * total
    k = plan.keep(F.row_number().over(line) - 1)
    left = plan.keep(total - F.coalesce(F.sum(x).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    below = x * (total - cap * k) <= cap * left * (1 + 1e-12)
    capped = plan.keep(F.coalesce(F.min(F.when(below, k)).over(own), n))
    rest = plan.keep(F.max(F.when(k == capped, left)).over(own))
    shared = F.when(k < capped, cap).otherwise(x * (total - cap * capped) / F.when(rest > 0, rest))
    return plan.df.withColumn("value", F.when(x.isNotNull(), shared).otherwise(val())).select(df.columns)


@op("bounddvol")
def _bounddvol(df, traded, booksize, share):
    """Weights of the positive values, capped at a share of the traded value; other finite values become 0.

    What is cut off goes to the rest in the order of their room (bound less
    weight, then ii): each in turn raises itself and all after it by its room, until
    what is left raises them evenly.  Without a traded value the room is unlimited.
    """
    x = fin(val())
    own = F.coalesce(x > 1e-6, F.lit(False))
    kept = df.columns
    df = df.withColumn("_w", F.when(own, x / F.sum(F.when(own, x)).over(day()))).withColumn("_b", fin(F.col(traded).cast("double")) * float(share) / float(booksize))
    over = F.coalesce(F.col("_w") > F.col("_b"), F.lit(False))
    df = df.withColumn("_cut", F.sum(F.when(over, F.col("_w") - F.col("_b"))).over(day())).withColumn("_free", own & ~over)
    df = df.withColumn("_room", F.coalesce(F.col("_b") - F.col("_w"), F.lit(1e300)))
    line = Window.partitionBy("dti", "_free").orderBy("_room", "ii")
    df = df.withColumn("_left", F.count("*").over(Window.partitionBy("dti", "_free")) - F.row_number().over(line) + 1)
    spent = F.coalesce(F.sum(F.col("_left") * F.col("_room")).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    df = df.withColumn("_add", F.greatest(F.lit(0.0), F.least("_room", (F.coalesce("_cut", F.lit(0.0)) - spent) / F.col("_left"))))
    raised = F.col("_w") + F.sum("_add").over(line.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("value", F.when(F.col("_free"), raised).when(own, F.col("_b")).when(x.isNotNull(), 0.0)).select(kept)


@op("rzrq")
def _rzrq(df, price, close, member, booksize, ratio=1, index=0, start=5800):
    """Shorts capped at the lots that an index quota lends; the index instrument takes the negative sum.

    A member (percentage weight in ``member``) may be short ``ratio`` of the book by
    its weight, in whole lots of 100 at the ``close`` of the day before; other shorts
    become 0.  A short without a price or an earlier close stays.  The first day is left as it is.
    """
    scale, size = float(booksize) / SHOWN, float(ratio) * float(booksize)
    k = int(start) + (INDEX[index] if index in INDEX else int(index))
    price, weight = fin(F.col(price)), fin(F.col(member))
    shares = div(val() * scale, price).try_cast("long")
    quota = div(size * (weight / 100), fin(F.lag(close).over(history())))
    quota = (quota / 100).try_cast("long") * 100
    short = F.when((shares < 0) & (shares < -quota), -quota / scale * price).otherwise(val())
    stock = F.col("ii") < int(start)
    kept = df.columns
    df = df.withColumn("_later", F.lag(F.lit(True), 1, False).over(history()))
    df = df.withColumn("_v", F.when(F.col("_later") & stock & (fin(val()) < 0), F.when(weight.isNotNull(), short).otherwise(0.0)).otherwise(val()))
    total = F.coalesce(F.sum(F.when(stock, fin(F.col("_v")))).over(day()), F.lit(0.0))
    return df.withColumn("value", F.when(F.col("_later") & (F.col("ii") == k), -total).otherwise(F.col("_v"))).select(kept)


def _at_limit(c: Column) -> Column:
    return F.col("halt") | (c >= F.col("limit_up")) | (c <= F.col("limit_down"))


@op("limit")
def _limit(df, up="limit_up_flag", down="limit_down_flag", price="price", booksize=1e9):
    """Halted cells and those flagged at a limit keep their shares; the rest fills the book, in lots."""
    df, kept = carry.carried_price(df, price, "_price"), df.columns
    return carry.limited(df, F.col("halt") | F.col(up) | F.col(down), float(booksize), "_price").select(kept)


@op("limitrd")
def _limitrd(df, booksize=SHOWN, price="price"):
    """As ``limit``, with the limits told from the price, limit_up and limit_down."""
    df, kept = carry.carried_price(df, price, "_price"), df.columns
    return carry.limited(df, _at_limit(F.col("_price")), float(booksize), "_price").select(kept)


@op("limitadj")
def _limitadj(df, price="price"):
    return _limitrd(df, 1e9, price)


@op("adjwt")
def _adjwt(df, quota, least, most, similarity, step):
    """Shorts within a quota (column ``quota``) by a factor of the date, longs to offset them; halted cells keep their weight."""
    return carry.adjusted_weights(df, F.col("halt"), F.col(quota), *map(float, (least, most, similarity, step)))


@op("adjwtlimit")
def _adjwtlimit(df, quota, least, most, similarity, step):
    """As ``adjwt``, and cells that closed at a limit the day before keep their weight too."""
    was = lambda c: F.lag(c).over(history())
    df, kept = df.withColumn("_stuck", (was("close") > was("limit_up") * 0.999) | (was("close") < was("limit_down") * 1.001)), df.columns
    locked = F.coalesce("halt", F.lit(False)) | F.coalesce("_stuck", F.lit(False))
    return carry.adjusted_weights(df, locked, F.col(quota), *map(float, (least, most, similarity, step))).select(kept)


def _matched(sig: np.ndarray, member: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """Weights of one date whose exposures to the rows of ``factors`` move towards those of ``member``."""
    with np.errstate(all="ignore"):
        w = np.where(sig > 0, sig, 0.0)
        w = w / w.sum()
        known = np.isfinite(factors)
        x = np.where(known, factors, 0.0)
        n = known.sum(1, keepdims=True)
        z = np.where(known, (factors - x.sum(1, keepdims=True) / n) / np.sqrt((x * x).sum(1, keepdims=True) / n), np.nan)
        both = np.isfinite(member) & np.isfinite(z)
        m = np.where(both, member, 0.0)
        target = (m * np.where(both, z, 0.0)).sum(1) / m.sum(1)
        for _ in range(MATCHING):
            move = np.zeros_like(w)
            for row, t in zip(z, target):
                own = (w > 0) & np.isfinite(row)
                a, s = w[own] / w[own].sum(), row[own]
                lam = (s @ a - t) / (t * s.sum() - s @ s) / (2 * 20)
                move[own] += (a + lam * s) / (1 + lam * s.sum()) - w[own]
            w = np.where(w > 0, w + move / len(z), np.nan)
            w[w <= 0] = np.nan
    return w


@op("risk")
def _risk(df, member, *factors):
    """Positive values as weights that take the factor exposures of the weights ``member``, in small steps; all others become missing.

    Factors are shifted by their mean and divided by their root mean square over
    the date.  The steps depend on one another, so a date is one numpy call;
    its rows are the instruments.
    """
    names = list(factors)
    if not names:
        raise ValueError("risk needs a factor")

    def match(rows: pd.DataFrame) -> pd.DataFrame:
        cells = rows[["value", member, *names]].astype("float64").to_numpy().T
        return rows.assign(value=_matched(cells[0], cells[1], cells[2:]))

    return df.groupBy("dti").applyInPandas(match, df.schema)


def _trailing(name: str, more: int = 0):
    """A trailing operation: gaps of up to 60 rows filled, then the last rows from the first present one on, later missing ones skipped."""

    def run(df, n, *rest):
        plan = Plan(df, None)
        x = plan.keep(fin(val()))
        t = plan.keep(F.row_number().over(history()))
        full = plan.keep(plan.filled(x, t, history()))
        rows = history().rowsBetween(1 - int(n) - more, 0)
        begin = plan.keep(F.min(F.when(full.isNotNull(), t)).over(rows))
        got = BUILD[name](series.Frame(full, None, t, rows, False, begin), [float(n), *map(float, rest)])
        return plan.df.withColumn("value", F.when(x.isNotNull(), fin(got))).select(df.columns)

    return run


def _count(f, s):
    """Rows from the frame's first present one on that are not 0, missing ones included."""
    return (f.t - f.start + 1 - f.agg(F.count(F.when(f.x == 0, 1)))).cast("double")


def _demean2(f, s):
    """Today less the mean of the rows before it."""
    before = f.agg(F.sum(f.x)) - f.x
    return f.x - before / F.when(f.n > 1, f.n - 1)


BUILD: dict[str, Callable[..., Column]] = {
    "tsmin": series.SERIES["ts_min"][3], "tsmax": series.SERIES["ts_max"][3], "tssum": series.SERIES["ts_sum"][3], "tsprod": series.prod, "tsmean": series.SERIES["ts_mean"][3],
    "tsstd": series.SERIES["ts_std"][3], "tsmeandev": series.mean_dev, "tsrmean": series.rmean, "tsargmin": series.argmin, "tsargmax": series.argmax, "tscorrstep": series.corr_step,
    "tsdecaylinear": series.decay_linear, "tscount": _count, "tsdemean": series.demean, "tsdemean2": _demean2, "tszscore": series.zscore, "tsrank": series.rank, "tsdelta": lambda f, s: f.x - f.agg(F.first(f.x, True)), "tsema": series.ema,
}
OPS |= {name: _trailing(name, int(name == "tsdelta")) for name in BUILD}
