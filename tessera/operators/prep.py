"""Features, targets and universes as training rows: scans, scaling, filling, sequences, splits and weights."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.guards import fin


def day(block: str = "dti"):
    return Window.partitionBy(block)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b != 0, a / F.when(b != 0, b))


def feature_rows(panel: DataFrame, features: list[str], target: str | None, universe: str | None, start: int, end: int, least_valid: int = 1) -> DataFrame:
    """Rows (dti, ii, features, target) of [start, end) inside ``universe`` with a finite target and at least ``least_valid`` finite features.

    The date range, the universe and the column choice reach the scan.
    """
    df = panel.where((F.col("dti") >= start) & (F.col("dti") < end))
    if universe:
        df = df.where(universe)
    valid = sum((fin(F.col(c)).isNotNull().cast("int") for c in features), F.lit(0))
    df = df.where(valid >= least_valid)
    if target:
        df = df.where(fin(F.col(target)).isNotNull())
    return df.select("dti", "ii", *features, *([target] if target else []))


def merged_features(stores: list[DataFrame]) -> DataFrame:
    """One table (dti, ii, all features) of several stores; a cell that one lacks is NULL."""
    df = stores[0]
    for s in stores[1:]:
        df = df.join(s, ["dti", "ii"], "full")
    return df


def scale_by_date(df: DataFrame, features: list[str], centre: bool = False, block: str = "dti") -> DataFrame:
    """Features over their date's (or block's) population deviation; with ``centre``, less the mean of the scaled ones."""
    for c in features:
        df = df.withColumn(c, ratio(fin(F.col(c)), F.stddev_pop(fin(F.col(c))).over(day(block))))
    return df.withColumns({c: F.col(c) - F.avg(c).over(day(block)) for c in features}) if centre else df


def demean_by_date(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({c: fin(F.col(c)) - F.avg(fin(F.col(c))).over(day()) for c in features})


def fill_missing(df: DataFrame, features: list[str], value: float = 0.0) -> DataFrame:
    return df.withColumns({c: F.coalesce(fin(F.col(c)), F.lit(value)) for c in features})


def smooth_forward(df: DataFrame, features: list[str], horizon: int = -1) -> DataFrame:
    """Missing cells repeat the last valid one; with a ``horizon`` above 1 they are 0 instead, but for an instrument's first row.

    A cell less than ``horizon`` rows after a valid one becomes 0, and later ones
    repeat the cell before, which is that 0.
    """
    line = Window.partitionBy("ii").orderBy("dti")
    own = line.rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_t", F.row_number().over(line))
    zeroed = F.lit(horizon > 1) & (F.col("_t") > 1)
    return df.withColumns({c: F.coalesce(fin(F.col(c)), F.when(zeroed, 0.0).otherwise(F.last(fin(F.col(c)), True).over(own))) for c in features}).drop("_t")


def fit_scaler(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: mean and sample deviation of each feature."""
    return df.agg(*(f(fin(F.col(c))).alias(f"{c}_{name}") for c in features for name, f in (("mean", F.avg), ("std", F.stddev_samp))))


def apply_scaler(df: DataFrame, fitted: DataFrame, features: list[str], inverse: bool = False) -> DataFrame:
    """Standardised features by a fitted row, or back again."""
    df = df.crossJoin(F.broadcast(fitted.limit(1)))  # one row
    for c in features:
        mean, std = F.col(f"{c}_mean"), F.col(f"{c}_std")
        df = df.withColumn(c, F.col(c) * std + mean if inverse else ratio(F.col(c) - mean, std))
    return df.drop(*fitted.columns)


def valid_ends(df: DataFrame, features: list[str], target: str, rows: int, share: float = 0.999) -> DataFrame:
    """(dti, ii) where the last ``rows`` rows each have that share of finite features and the target is finite."""
    valid = sum((fin(F.col(c)).isNotNull().cast("int") for c in features), F.lit(0)) / len(features) >= share
    own = Window.partitionBy("ii").orderBy("dti").rowsBetween(1 - rows, 0)
    df = df.withColumn("_n", F.sum(valid.cast("int")).over(own))
    return df.where((F.col("_n") == rows) & fin(F.col(target)).isNotNull()).select("dti", "ii")


def sequences(df: DataFrame, features: list[str], rows: int) -> DataFrame:
    """(dti, ii, sequence): the features of the last ``rows`` rows, oldest first, where there are so many."""
    own = Window.partitionBy("ii").orderBy("dti").rowsBetween(1 - rows, 0)
    return df.withColumn("sequence", F.collect_list(F.struct(*features)).over(own)).where(F.size("sequence") == rows).select("dti", "ii", "sequence")


def sample_weight(df: DataFrame, steps: list[tuple[int, float]]) -> DataFrame:
    """``df`` with weight by how many dates before the last a row is: that of the first step (dates, weight) it falls into, else 1."""
    # one row per date, numbered from the end
    dates = df.select("dti").distinct().withColumn("_back", F.row_number().over(Window.orderBy(F.col("dti").desc())))
    weight = F.lit(1.0)
    for n, w in sorted(steps, reverse=True):
        weight = F.when(F.col("_back") <= n, w).otherwise(weight)
    return df.join(dates.withColumn("weight", weight).drop("_back"), "dti")


def rolling_splits(start: date, end: date, train: float, valid: float, predict: float, gap: int = 0, most_train: float | None = None) -> list[dict[str, tuple[date, date]]]:
    """Train, valid and predict ranges, in years of 365 days, rolled forward by ``predict``; training grows unless ``most_train`` bounds it."""
    years = lambda n: timedelta(days=int(365 * n))
    one, out = timedelta(days=1), []
    at = start + years(train) + years(valid)
    while at <= end + one:
        valid_start = at - years(valid) - timedelta(days=gap)
        first = start if most_train is None else max(start, valid_start - years(most_train))
        out.append({"train": (first, valid_start - one), "valid": (valid_start, at - one - timedelta(days=gap)), "predict": (at, at + years(predict) - one)})
        at += years(predict)
    return out


def with_split(df: DataFrame, splits: list[dict[str, tuple[date, date]]], at: str = "day") -> DataFrame:
    """``df`` with roll, the number of the split to predict each row with: the one whose range holds it, the last one after all."""
    roll = F.lit(None).cast("int")
    for k, s in enumerate(splits):
        roll = F.when(F.col(at) >= F.lit(s["predict"][0]), k).otherwise(roll)
    return df.withColumn("roll", roll)
