"""Linear models without intercept over rolls of dates, from one pass over the rows."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import date, timedelta

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin
from .market import ratio


def _pairs(xs: list[str]) -> list[tuple[int, int]]:
    return [(i, j) for i in range(len(xs)) for j in range(i, len(xs))]


def grams(rows: DataFrame, xs: list[str], y: str, weight: str | None = None, day: str = "dti") -> DataFrame:
    """(day, n, products): per date the sums of x_i x_j for i <= j, then of x_i y, over rows whose cells are all finite; times ``weight``."""
    cells = {c: fin(F.col(c).cast("double")) for c in (*xs, y, *([weight] if weight else []))}
    full = rows.select(day, *(v.alias(c) for c, v in cells.items())).dropna()
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(w * F.col(xs[i]) * F.col(xs[j])) for i, j in _pairs(xs)] + [F.sum(w * F.col(x) * F.col(y)) for x in xs]
    return full.groupBy(day).agg(F.count("*").alias("n"), F.array(*sums).alias("products"))


def in_rolls(day: Column, spans: list[tuple]) -> Column:
    """The numbers of the spans [from, to) that hold a day; the list of rolls is a parameter, not data."""
    return F.array_compact(F.array(*(F.when((day >= F.lit(a)) & (day < F.lit(b)), F.lit(k)) for k, (a, b) in enumerate(spans))))


def fitted(daily: DataFrame, xs: list[str], spans: list[tuple], ridge: float = 0.0, day: str = "dti") -> DataFrame:
    """(roll, n, weights): least squares of each roll's dates from ``grams``, with ``ridge`` added to the diagonal; NULL weights if singular.

    A date counts in every roll that has it, but only its sums travel there.
    """
    k, pairs = len(xs), _pairs(xs)
    size = len(pairs) + k
    held = daily.withColumn("roll", F.explode(in_rolls(F.col(day), spans)))
    sums = held.groupBy("roll").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("products")[i]) for i in range(size))).alias("products"))

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for products in batch["products"]:
                left, right = np.zeros((k, k)), np.asarray(products[len(pairs) :], float)
                for (i, j), v in zip(pairs, products):
                    left[i, j] = left[j, i] = v
                left += ridge * np.eye(k)
                out.append(np.linalg.solve(left, right).tolist() if abs(np.linalg.det(left)) > 1e-100 else None)
            yield pd.DataFrame({"roll": batch["roll"], "n": batch["n"], "weights": out})

    return sums.mapInPandas(solve, "roll int, n long, weights array<double>")


def predicted(rows: DataFrame, weights: DataFrame, xs: list[str], spans: list[tuple], day: str = "dti") -> DataFrame:
    """``rows`` with roll and prediction: the roll whose span holds the day, the last one for later days; NULL where a cell is missing or no roll fits."""
    last = len(spans) - 1
    roll = F.coalesce(F.try_element_at(in_rolls(F.col(day), spans), F.lit(1)), F.when(F.col(day) >= F.lit(spans[last][1]), F.lit(last)))
    out = rows.withColumn("roll", roll).join(weights.select("roll", "weights"), "roll", "left")
    value = sum((fin(F.col(x).cast("double")) * F.col("weights")[i] for i, x in enumerate(xs)), F.lit(0.0))
    return out.withColumn("prediction", value).drop("weights")


def roll_scores(rows: DataFrame, y: str) -> DataFrame:
    """(roll, n, ic, mse) of predictions with a target."""
    both = rows.where(F.col("prediction").isNotNull() & fin(F.col(y)).isNotNull())
    p, t = F.col("prediction"), F.col(y)
    sums = both.groupBy("roll").agg(F.count("*").alias("n"), F.sum(p * t).alias("pt"), F.sum(p * p).alias("pp"), F.sum(t * t).alias("tt"), F.avg((p - t) * (p - t)).alias("mse"))
    return sums.select("roll", "n", ratio(F.col("pt"), F.sqrt(F.col("pp") * F.col("tt"))).alias("ic"), "mse")


def expanding(first: int, train: int, step: int, last: int) -> tuple[list[tuple], list[tuple]]:
    """(training spans, prediction spans) of day numbers: training starts at ``first`` and grows by ``step``, prediction covers the next ``step`` days."""
    cuts = list(range(first + train, last, step))
    return [(first, c) for c in cuts], [(c, min(c + step, last)) for c in cuts]


def spans_of(splits: list[dict]) -> tuple[list[tuple[date, date]], list[tuple[date, date]]]:
    """The spans of prep.rolling_splits as half-open ones."""
    after = lambda span: (span[0], span[1] + timedelta(days=1))
    return [after(s["train"]) for s in splits], [after(s["predict"]) for s in splits]


def rolling_slope(panel: DataFrame, x: str, y: str, rows: int, mask: str = "univ") -> DataFrame:
    """(dti, ii, value): the slope without intercept of y on x over the last ``rows`` rows of an instrument, where at least half of them have both, from its row number ``rows`` on."""
    own = Window.partitionBy("ii").orderBy("dti")
    frame = own.rowsBetween(1 - rows, 0)
    a, b = fin(F.col(x)), fin(F.col(y))
    both = a.isNotNull() & b.isNotNull()
    slope = ratio(F.sum(F.when(both, a * b)).over(frame), F.sum(F.when(both, a * a)).over(frame))
    enough = (F.count(F.when(both, 1)).over(frame) >= rows // 2) & (F.row_number().over(own) > rows)
    return panel.select("dti", "ii", F.when(F.col(mask) & enough, slope).alias("value"))
