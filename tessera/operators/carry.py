"""Signals of instruments that cannot always be traded: a locked one keeps its position.

A locked cell is its instrument's last free cell, moved by the price.  So all that
hangs together over days and instruments is one scale a date and side: what locked
positions take of the book.  The free cells of a date and what later dates still
hold of them are summed by (date, date of the free cell, side) in one shuffle, the
scales follow from these sums date by date, and each row takes the scale of its free
cell's date.  No window holds more than one instrument.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin
from ..plans.compile import Plan

#: Value of the book in signals; rows over which a price is carried on; shares in a lot.
SHOWN, CARRIED, LOT = 1e5, 1000, 100

Scales = Callable[[dict, dict], tuple[float, float]]


def history():
    return Window.partitionBy("ii").orderBy("dti")


def up_to_now():
    return history().rowsBetween(Window.unboundedPreceding, 0)


def carried_price(df: DataFrame, price: str, out: str) -> DataFrame:
    """``price``, and where it is missing the last one of at most CARRIED rows before."""
    t, x = F.row_number().over(history()), fin(F.col(price).cast("double"))
    df = df.withColumn("_t", t).withColumn("_at", F.when(x.isNotNull(), F.col("_t")))
    old = F.when(F.col("_t") - F.last("_at", True).over(up_to_now()) <= CARRIED, F.last(x, True).over(up_to_now()))
    return df.withColumn(out, F.coalesce(x, old)).drop("_t", "_at")


def scales(cells: DataFrame, rule: Scales) -> DataFrame:
    """(_from, _side, _scale) from cells (dti, _from, _side, _amount).

    ``rule`` gives a date's scales of the sides 1 and -1 from what is free and what is
    held on that date, by side.  The sums have a row per date, date of the free cell
    and side, however many instruments there are: one task takes them in the order
    of dates and keeps two scales a date.
    """
    sums = cells.where("_amount <> 0").groupBy("dti", "_from", "_side").agg(F.sum("_amount").alias("_sum"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        date, free, held, out = None, {1: 0.0, -1: 0.0}, {1: 0.0, -1: 0.0}, []

        def close():
            known[date] = rule(free, held)
            out.extend((date, side, scale) for side, scale in zip((1, -1), known[date]))

        for batch in batches:
            for d, origin, side, amount in batch.itertuples(index=False):
                if d != date:
                    if date is not None:
                        close()
                    date, free, held = d, {1: 0.0, -1: 0.0}, {1: 0.0, -1: 0.0}
                if origin == d:
                    free[side] += amount
                else:
                    now = amount * known[origin][0 if side > 0 else 1]
                    held[1 if now > 0 else -1] += now
            yield pd.DataFrame(out, columns=["_from", "_side", "_scale"])
            out.clear()
        if date is not None:
            close()
            yield pd.DataFrame(out, columns=["_from", "_side", "_scale"])

    kind = cells.schema["dti"].dataType.simpleString()
    return sums.repartition(1).sortWithinPartitions("dti", "_from", "_side").mapInPandas(solve, f"_from {kind}, _side int, _scale double")


def rescaled(cells: DataFrame, rule: Scales, kept: list[str]) -> DataFrame:
    """``cells`` (dti, _from, _side, _amount) with the amounts times their scales as value."""
    out = cells.join(scales(cells, rule), ["_from", "_side"], "left")
    return out.withColumn("value", F.col("_amount") * F.coalesce("_scale", F.lit(1.0))).select(kept)


def with_origin(df: DataFrame, locked: Column, **more: Column) -> DataFrame:
    """``df`` with _locked and _free, a struct of the last free row's dti and ``more``; NULL before the first."""
    df = df.withColumn("_locked", F.coalesce(locked, F.lit(False)))
    own = F.when(~F.col("_locked"), F.struct(F.col("dti").alias("dti"), *(c.alias(n) for n, c in more.items())))
    return df.withColumn("_free", F.last(own, True).over(up_to_now()))


def _book(free: dict, held: dict) -> tuple[float, float]:
    """Scales that bring each side to the book, next to what is held; without room the longs stay as they are."""
    longs = (SHOWN - held[1]) / free[1] if free[1] else 1.0
    shorts = (-SHOWN - held[-1]) / free[-1] if free[-1] else 1.0
    return longs if longs > 0 else 1.0, shorts if shorts != 0 else 1.0


def limited(df: DataFrame, locked: Column, booksize: float, price: str) -> DataFrame:
    """``df`` (dti, ii, value and what is read) with positions that can be held: locked cells keep the shares of the day before, free ones take the rest of the book on each side, all in lots.

    ``price`` has been carried on already.  A position without a price counts for one
    day as missing, then as none; an instrument that was never free holds none.
    """
    kept, c, s = df.columns, F.col(price), fin(F.col("value"))
    df = df.withColumn("_blank", F.count(F.when(c.isNull(), 1)).over(history().rowsBetween(Window.unboundedPreceding, -1)))
    df = with_origin(df, locked, s=s, c=c, blank=F.col("_blank")).withColumn("_next", ~F.lag("_locked").over(history()))
    f = F.col("_free")
    lost = F.when(F.col("_next") & f["s"].isNotNull(), None).otherwise(0.0)
    moved = F.when(f.isNull() | (f["s"].isNull() & (F.col("_blank") == f["blank"])), 0.0).when(F.col("_blank") > f["blank"], lost).otherwise(f["s"] * c / F.when(f["c"] != 0, f["c"]))
    df = df.withColumn("_amount", F.when(F.col("_locked"), F.when(c.isNotNull(), moved)).otherwise(s))
    df = df.withColumn("_from", F.when(F.col("_locked"), f["dti"]).otherwise(F.col("dti"))).withColumn("_side", F.signum(f["s"]).cast("int"))
    scale = booksize / SHOWN
    lots = F.round(F.col("value") * scale / F.when(c != 0, c) / LOT) * LOT
    return rescaled(df, _book, kept).withColumn("value", fin(lots * c / scale))


def nearest_cap(short: Column, quota: Column, least: float, most: float, similarity: float, step: float, keep: Callable[[Column], Column]) -> Column:
    """A date's factor of its shorts (weights ``short`` > 0 with a ``quota`` > 0, NULL elsewhere): the largest of a grid such that min(factor * short, quota) still sums to more than similarity * factor.

    The grid halves [least, most] until it is finer than ``step``; without such a
    factor it is the smaller of ``least`` and all quotas.  The sum is concave in the
    factor and bends where a quota is reached, so the first bend at which it no longer
    suffices has the crossing before it.  What is left at a bend is summed from the
    other end: a frame that runs to the end of a date is summed anew for each row.
    """
    day = Window.partitionBy("dti")
    line, back = day.orderBy((quota / short).asc_nulls_last(), "ii"), day.orderBy((quota / short).desc_nulls_first(), F.col("ii").desc())
    spent = keep(F.coalesce(F.sum(quota).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rest = keep(F.coalesce(F.sum(short).over(back.rangeBetween(Window.unboundedPreceding, 0)), F.lit(0.0)))
    every = keep(F.coalesce(F.sum(quota).over(day), F.lit(0.0)))
    bend = quota / short
    over = spent + bend * rest - similarity * bend
    at = keep(F.when(over <= 0, F.when(similarity > rest, spent / F.when(similarity > rest, similarity - rest)).otherwise(0.0)))
    beyond = every / similarity if similarity > 0 else F.lit(2 * most)
    crossing = keep(F.coalesce(F.first(at, True).over(line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), beyond))
    width, halvings = most - least, 0
    while width >= step:
        width, halvings = width / 2, halvings + 1
    if not halvings:
        return F.least(every, F.lit(least))
    k = F.least(F.ceil((crossing - least) / width) - 1, F.lit(2**halvings - 1))
    return F.when(k >= 1, least + k * width).otherwise(F.least(every, F.lit(least)))


def _balanced(free: dict, held: dict) -> tuple[float, float]:
    """Longs that offset all the rest; where the rest is above zero they stay as they are."""
    rest = -(free[-1] + held[1] + held[-1])
    return (rest / free[1] if rest >= 0 and free[1] else 1.0), 1.0


def adjusted_weights(df: DataFrame, locked: Column, quota: Column, least: float, most: float, similarity: float, step: float) -> DataFrame:
    """``df`` with shorts times the date's factor but within their quotas, and longs scaled to offset shorts and locked cells, which keep the weight of the day before.

    Shorts without a quota become 0; so do locked cells without an earlier weight.
    """
    kept, plan = df.columns, Plan(df, None)
    s, q = plan.keep(fin(F.col("value"))), plan.keep(fin(quota.cast("double")))
    lends = plan.keep((s < 0) & (q > 0))
    cap = plan.keep(nearest_cap(plan.keep(F.when(lends, -s)), plan.keep(F.when(lends, q)), least, most, similarity, step, plan.keep))
    w = plan.keep(F.when(s < 0, F.when(q > 0, F.greatest(s * cap, -q)).otherwise(0.0)).otherwise(s))
    df = with_origin(plan.df, locked, w=w)
    f = F.col("_free")
    df = df.withColumn("_amount", F.when(F.col("_locked"), F.coalesce(f["w"], F.lit(0.0))).otherwise(w))
    df = df.withColumn("_from", F.when(F.col("_locked"), f["dti"]).otherwise(F.col("dti"))).withColumn("_side", F.when(f["w"] > 0, 1).otherwise(-1))
    return rescaled(df, _balanced, kept)
