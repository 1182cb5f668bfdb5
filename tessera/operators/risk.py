"""Covariances in blocks of dates and groups, and the variance of a signal that they imply."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin
from ..sources.shared import settled
from .market import ratio

#: Least variance that counts; instruments whose histories a task holds at once.
LEAST, HELD = 1e-18, 4096


def with_block(dates: DataFrame, blocks: DataFrame) -> DataFrame:
    """(dti, block): the last date of ``blocks`` (block) at or before each date of ``dates`` (dti); none before the first.

    Dates and block dates are one row each, so the one window holds a calendar.
    """
    marks = blocks.select(F.col("block").alias("dti"), "block").distinct()
    both = dates.select("dti").distinct().join(marks, "dti", "full")
    known = both.withColumn("block", F.last("block", True).over(Window.orderBy("dti").rowsBetween(Window.unboundedPreceding, 0)))
    return known.join(dates.select("dti").distinct(), "dti", "left_semi")


def group_correlations(panel: DataFrame, field: str, group: str, every: int) -> DataFrame:
    """(block, ii, jj, v): for each block of ``every`` dates, named by its last, the correlations of ``field`` between instruments of one group; v of an instrument with itself is its deviation.

    Pairs meet by (date, group), both finite; the deviation is the population's.  Only
    pairs with both deviations above zero have a row.
    """
    cells = panel.select("dti", "ii", F.col(group).alias("g"), fin(F.col(field)).alias("x")).where("x is not null")
    cells = cells.withColumn("block", (F.floor((F.col("dti") - 1) / every) + 1).cast("long") * every)
    other = cells.select("dti", "g", F.col("ii").alias("jj"), F.col("x").alias("y"))
    stats = cells.join(other, ["dti", "g"]).groupBy("block", "ii", "jj").agg(F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("c"))
    some = stats.where((F.col("vx") > LEAST) & (F.col("vy") > LEAST))
    v = F.when(F.col("ii") == F.col("jj"), F.sqrt("vx")).otherwise(F.col("c") / F.sqrt(F.col("vx") * F.col("vy")))
    return some.select("block", "ii", "jj", v.alias("v"))


def covariances(matrices: DataFrame) -> DataFrame:
    """(block, ii, jj, cov) from matrices (block, ii, jj, v) that hold deviations on the diagonal and correlations beside it.

    The product deviation * matrix * deviation leaves cubes on the diagonal, of which the power 2/3 makes variances.
    """
    spread = matrices.where("ii = jj").select("block", F.col("ii").alias("k"), F.col("v").alias("d"))
    left = spread.withColumnsRenamed({"k": "ii", "d": "di"})
    right = spread.withColumnsRenamed({"k": "jj", "d": "dj"})
    out = matrices.join(left, ["block", "ii"]).join(right, ["block", "jj"])
    product = F.col("di") * F.col("v") * F.col("dj")
    return out.select("block", "ii", "jj", F.when(F.col("ii") == F.col("jj"), F.pow(product, F.lit(2 / 3))).otherwise(product).alias("cov"))


def implied_variance(signal: DataFrame, matrices: DataFrame, scaled: bool = False) -> DataFrame:
    """(dti, variance): the quadratic form of each date's signal (dti, ii, value) with the last matrix at or before it.

    Missing weights count as 0, instruments outside the matrix as if they were not
    there; ``scaled`` divides weights by their absolute sum inside it.  Dates before
    the first matrix have NULL.  The matrix is joined on its rows, summed by (date,
    column) before the weights of the columns are joined: no task holds a matrix.
    """
    cov = covariances(matrices)
    dates = with_block(signal, matrices)
    members = matrices.where("ii = jj").select("block", "ii")
    weights = signal.select("dti", "ii", F.coalesce(fin(F.col("value")), F.lit(0.0)).alias("a")).join(dates.where("block is not null"), "dti").join(members, ["block", "ii"])
    if scaled:
        size = weights.groupBy("dti").agg(F.sum(F.abs("a")).alias("size"))
        weights = weights.join(size, "dti").withColumn("a", ratio(F.col("a"), F.col("size")))
    weights = weights.where("a <> 0").select("dti", "block", "ii", "a")
    columns = weights.join(cov, ["block", "ii"]).groupBy("dti", "jj").agg(F.sum(F.col("a") * F.col("cov")).alias("y"))
    found = columns.join(weights.select("dti", F.col("ii").alias("jj"), "a"), ["dti", "jj"]).groupBy("dti").agg(F.sum(F.col("y") * F.col("a")).alias("found"))
    out = dates.join(found, "dti", "left")
    return out.select("dti", F.when(F.col("block").isNotNull(), F.coalesce("found", F.lit(0.0))).alias("variance"))


def _total(items: Column, of) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda s, e: s + of(e))


def _halves(own: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
    """Of instruments with one pattern (n rows a slot, with mean m and scatter q), by date and the rows r of another pattern in these slots: the weighted sums u of their standardised rows.

    A pair has n * r rows a slot, of which its means and deviations are.  Where r is
    NULL, u is what the pairs of an instrument with itself lack, as its own variance
    counts whole, and the sum of the weights' sizes.
    """
    names, out = ["block", "k", "dti", "r", "u"], []
    if own.empty or others.empty:
        return pd.DataFrame(out, columns=names)
    m, q, a, size = (np.stack(own[c].tolist()) for c in ("m", "q", "a", "size"))
    n, days, d = np.asarray(own["n"].iloc[0], float), own["days"].iloc[0].tolist(), own["d"].to_numpy()[:, None]
    for found in others["rs"].iloc[0]:
        r = np.asarray(found, float)
        rows, on = n * r, r > 0
        off = m - (m @ rows / rows.sum())[:, None]
        var = (q @ r + off**2 @ rows) / rows.sum()
        some = var > LEAST
        z = (a * d)[some] / np.sqrt(var[some])[:, None]
        out.extend(zip(days, [list(found)] * len(days), (z.T @ (off[some][:, on] * n[on])).tolist()))
        if (r == n).all():
            lack = ((a * d) ** 2)[some].T @ (1 - ((off[some] * n) ** 2).sum(1) / rows.sum() / var[some])
            out.extend(zip(days, [None] * len(days), np.stack([lack, size.sum(0)], 1).tolist()))
    return pd.DataFrame([(own["block"].iloc[0], own["k"].iloc[0], *row) for row in out], columns=names)


def panel_variance(signal: DataFrame, panel: DataFrame, field: str, group: str, every: int, scaled: bool = False) -> DataFrame:
    """(dti, variance): as ``implied_variance`` of ``group_correlations``, without their pairs.

    Instruments of a block that have ``field`` in the same slots (date and group) share
    a pattern.  Two patterns meet in their common slots, where the quadratic form is a
    product of two sums, one a pattern.  So there is a row for each two patterns of a
    block that meet, not for each two instruments; with no gaps, a group is one pattern.
    """
    cells = panel.select("dti", "ii", F.col(group).alias("g"), fin(F.col(field)).alias("x")).where("x is not null and g is not null")
    slots = cells.groupBy("ii", "dti", "g").agg(F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("q"))
    slots = slots.withColumn("block", (F.floor((F.col("dti") - 1) / every) + 1).cast("long") * every)
    lines = slots.groupBy("block", "ii").agg(F.sort_array(F.collect_list(F.struct("dti", "g", "n", "m", "q"))).alias("c"))
    rows = _total(F.col("c"), lambda e: e["n"] * e["n"])
    lines = lines.withColumn("_mean", _total(F.col("c"), lambda e: e["n"] * e["n"] * e["m"]) / rows)
    lines = lines.withColumn("_var", _total(F.col("c"), lambda e: e["n"] * (e["q"] + e["n"] * (e["m"] - F.col("_mean")) * (e["m"] - F.col("_mean")))) / rows).where(F.col("_var") > LEAST)
    pattern = F.transform("c", lambda e: F.struct(e["dti"], e["g"], e["n"]))
    lines = settled(lines.select("block", "ii", F.sqrt("_var").alias("d"), pattern.alias("p"), F.to_json(pattern).alias("k"), "c.m", "c.q"))

    patterns = lines.groupBy("block", "k").agg(F.first("p").alias("p"), F.ceil(F.count("*") / HELD).cast("int").alias("parts"))
    at = patterns.select("block", "k", "p", F.explode("p").alias("_s")).select("block", "k", "p", F.col("_s.dti").alias("_d"), F.col("_s.g").alias("_g"))
    met = at.join(at.withColumnsRenamed({"k": "k2", "p": "p2"}), ["block", "_d", "_g"]).drop("_d", "_g").dropDuplicates(["block", "k", "k2"])
    shared = lambda p, q: F.transform(p, lambda e: F.coalesce(F.get(F.filter(q, lambda f: (f["dti"] == e["dti"]) & (f["g"] == e["g"])), F.lit(0))["n"], F.lit(0).cast("long")))
    met = met.withColumn("r", shared(F.col("p"), F.col("p2"))).withColumn("r2", shared(F.col("p2"), F.col("p")))
    met = met.select("block", "k", "k2", "r", "r2", _total(F.zip_with("p", "r", lambda e, r: e["n"] * r), lambda x: x).alias("rows"))
    others = met.groupBy("block", "k").agg(F.collect_set("r").alias("rs"))

    dates = with_block(signal, lines)
    known, a = dates.where("block is not null"), F.coalesce(fin(F.col("value")), F.lit(0.0))
    weights = signal.select("dti", "ii", a.alias("a")).groupBy("dti", "ii").agg(F.sum("a").alias("a"), F.sum(F.abs("a")).alias("size")).join(known, "dti")
    held = weights.groupBy("block", "ii").agg(F.map_from_entries(F.collect_list(F.struct("dti", "a"))).alias("_a"), F.map_from_entries(F.collect_list(F.struct("dti", "size"))).alias("_size"))
    days = known.groupBy("block").agg(F.sort_array(F.collect_list("dti")).alias("days"))
    own = lines.join(held, ["block", "ii"]).join(days, "block").join(patterns.select("block", "k", "parts"), ["block", "k"])
    by_day = lambda values: F.transform("days", lambda d: F.coalesce(F.try_element_at(values, d), F.lit(0.0)))
    own = own.select("block", "k", F.pmod(F.hash("ii"), "parts").alias("part"), F.transform("p", lambda e: e["n"]).alias("n"), "m", "q", "d", "days", by_day("_a").alias("a"), by_day("_size").alias("size"))
    others = others.join(patterns.select("block", "k", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")), ["block", "k"])
    others = others.select(*(F.col(c).alias(c) for c in others.columns))  # columns of their own, as both sides come from ``lines``

    keys = ["block", "k", "part"]
    kind = signal.schema["dti"].dataType.simpleString()
    halves = own.groupBy(keys).cogroup(others.groupBy(keys)).applyInPandas(_halves, f"block long, k string, dti {kind}, r array<long>, u array<double>")
    halves = halves.groupBy("block", "k", "dti", "r").agg(F.collect_list("u").alias("us"))
    halves = settled(halves.select("block", "k", "dti", "r", F.transform(F.sequence(F.lit(0), F.size(F.col("us")[0]) - 1), lambda i: _total(F.col("us"), lambda u: F.get(u, i))).alias("u")))
    both = met.join(halves, ["block", "k", "r"]).join(halves.select("block", "dti", F.col("k").alias("k2"), F.col("r").alias("r2"), F.col("u").alias("v")), ["block", "dti", "k2", "r2"])
    both = both.select("dti", (_total(F.zip_with("u", "v", lambda u, v: u * v), lambda x: x) / F.col("rows")).alias("found"), F.lit(0.0).alias("size"))
    alone = halves.where("r is null").select("dti", F.col("u")[0].alias("found"), F.col("u")[1].alias("size"))
    found = both.union(alone).groupBy("dti").agg(F.sum("found").alias("found"), F.sum("size").alias("size"))
    if scaled:
        found = found.withColumn("found", ratio(F.col("found"), F.col("size") * F.col("size")))
    out = dates.join(found, "dti", "left")
    return out.select("dti", F.when(F.col("block").isNotNull(), F.coalesce("found", F.lit(0.0))).alias("variance"))
