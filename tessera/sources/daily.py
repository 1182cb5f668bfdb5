"""The base panel from delimited price files, one a day, for stocks and for indices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.market import ratio
from .panel import read_templated

#: Names of exchanges and their codes; groups by the files' column.
EXCHANGES = {"SH": 0, "SZ": 1}
GROUPS = {"sector": "sector", "ind": "industry", "subind": "subindustry"}
PRICES = ("open", "close", "high", "low", "vol", "dvol")


def cell(df: DataFrame, name: str, kind: str = "double", fallback: float | int | None = None) -> Column:
    """A cell as a number; what does not parse, or a column that the files lack, is ``fallback``."""
    if name not in df.columns:
        return F.lit(fallback).cast(kind)
    return F.coalesce(F.expr(f"try_cast(trim(`{name}`) as {kind})"), F.lit(fallback).cast(kind))


def group_ids(rows: DataFrame, name: str) -> DataFrame:
    """(name, id) of the names in ``rows`` (dti, ii, name): numbers in the order in which they first come, 0 for an empty one.

    One row per name of a group, so the ordered window holds a dictionary.
    """
    first = rows.where(F.col(name) != "").groupBy(name).agg(F.min(F.struct("dti", "ii")).alias("_at"))
    return first.select(name, F.row_number().over(Window.orderBy("_at", name)).alias("_id"))


def _one(rows: DataFrame) -> DataFrame:
    """A row per cell; of rows that repeat one, the largest."""
    rest = [c for c in rows.columns if c not in ("dti", "ii")]
    return rows.groupBy("dti", "ii").agg(F.max(F.struct(*rest)).alias("_r")).select("dti", "ii", "_r.*")


def _named(spark: SparkSession, template: str, calendar: dict[str, int], instruments: DataFrame) -> DataFrame:
    """Rows of the files with dti and ii; symbols that are not known are left out."""
    dates = spark.createDataFrame(list(calendar.items()), "day string, dti int")
    rows = read_templated(spark, template, list(calendar), sep="|")
    return rows.join(dates, "day").join(instruments.select("ii", "sid"), "sid").drop("day")


def base_from_files(spark: SparkSession, prices: str, indices: str | None, days: list[str], instruments: DataFrame, listed: DataFrame, exchanges: dict[str, int] = EXCHANGES) -> DataFrame:
    """(dti, ii, open, close, high, low, vol, dvol, vwap, cty, sector, industry, subindustry, sharesout, sharesfloat, cap, adj, st, exch, halt, limit_up, limit_down, univ_all) for every day and instrument.

    ``prices`` and ``indices`` are templates of files by day (yyyymmdd, in order; dti is a day's
    place), ``instruments`` has (ii, sid), ``listed`` (dt, ii).  A cell without a row has no
    prices, no volume, groups, flag and exchange -1, and adj 1.  vwap is 0 without volume, cap
    takes the close before, a name with ST is flagged, and rows that are not active are halted if
    the files have no halt.  univ_all holds listed cells that are not halted, and all rows of indices.
    """
    calendar = {d: k for k, d in enumerate(days)}
    named = _named(spark, prices, calendar, instruments)
    vol, dvol = cell(named, "vol"), cell(named, "dvol")
    halt = cell(named, "halt", "int", 0) != 0 if "halt" in named.columns else cell(named, "active", "int", 1) != 1
    codes = F.create_map(*(F.lit(x) for pair in exchanges.items() for x in pair))
    stocks = _one(
        named.select(
            "dti", "ii", *(cell(named, c).alias(c) for c in PRICES), F.when(vol == 0, 0.0).otherwise(ratio(dvol, vol)).alias("vwap"), *(F.coalesce(F.trim(F.col(c)), F.lit("")).alias(f"_{c}") for c in GROUPS),
            cell(named, "sho").alias("sharesout"), cell(named, "flo").alias("sharesfloat"), (cell(named, "sho") * cell(named, "pclose")).alias("cap"), cell(named, "adj", "double", 1.0).alias("adj"),
            F.coalesce(F.contains(F.col("name"), F.lit("ST")), F.lit(False)).cast("int").alias("st"), halt.alias("halt"), cell(named, "up").alias("limit_up"), cell(named, "down").alias("limit_down"),
            F.coalesce(codes[F.coalesce("exch", F.lit(""))], F.lit(-1)).alias("exch"),
        )
    )
    for column, group in GROUPS.items():
        stocks = stocks.join(group_ids(stocks, f"_{column}"), f"_{column}", "left").withColumn(group, F.coalesce("_id", F.lit(0))).drop("_id", f"_{column}")
    stocks = stocks.withColumn("cty", F.lit(1)).withColumn("_index", F.lit(False))
    if indices:
        own = _named(spark, indices, calendar, instruments)
        vol, dvol = cell(own, "vol"), cell(own, "dvol")
        rows = own.select("dti", "ii", *(cell(own, c).alias(c) for c in PRICES), F.when(vol == 0, 0.0).otherwise(ratio(dvol, vol)).alias("vwap"), F.lit(1.0).alias("adj"), (cell(own, "high") * 2).alias("limit_up"), F.lit(0.0).alias("limit_down"))
        rows = _one(rows).withColumn("_index", F.lit(True))
        # an index row counts where both files have one
        stocks = stocks.join(rows.select("dti", "ii"), ["dti", "ii"], "left_anti").unionByName(rows, allowMissingColumns=True)
    dates = spark.createDataFrame([(k, int(d)) for d, k in calendar.items()], "dti int, dt int")
    grid = dates.join(instruments.select("ii"), how="cross").join(listed.withColumn("_listed", F.lit(True)), ["dt", "ii"], "left").drop("dt")
    out = grid.join(stocks, ["dti", "ii"], "left")
    fill = lambda c, v: F.coalesce(c, F.lit(v)).alias(c)
    inside = F.coalesce("_index", F.lit(False)) | (F.coalesce("_listed", F.lit(False)) & ~F.coalesce("halt", F.lit(False)))
    return out.select(
        "dti", "ii", "open", "close", "high", "low", fill("vol", 0.0), fill("dvol", 0.0), "vwap", *(fill(c, -1) for c in ("cty", *GROUPS.values())), *(fill(c, 0.0) for c in ("sharesout", "sharesfloat", "cap")),
        fill("adj", 1.0), fill("st", -1), fill("exch", -1), fill("halt", False), "limit_up", "limit_down", inside.alias("univ_all"),
    )


def wrong_adjustments(panel: DataFrame, closes: DataFrame, most: float = 1e-5) -> DataFrame:
    """(dti, ii, adj, found) where adj is not the last close over the close before as the day's file has it (``closes``: dti, ii, pclose)."""
    before = F.lag("close").over(Window.partitionBy("ii").orderBy("dti"))
    df = panel.select("dti", "ii", "adj", before.alias("_before")).join(closes, ["dti", "ii"])
    return df.select("dti", "ii", "adj", ratio(F.col("_before"), F.col("pclose")).alias("found")).where(F.abs(F.col("adj") - F.col("found")) > most)


def in_sample(panel: DataFrame, end: int) -> DataFrame:
    """``panel`` with all cells from the date ``end`` on missing: what a model may see."""
    return panel.select(*(c if c in ("dti", "ii") else F.when(F.col("dti") < end, F.col(c)).alias(c) for c in panel.columns))


def empty_columns(features: DataFrame, date: str = "dti") -> DataFrame:
    """(dti, feature): columns of a wide feature table that have no finite cell on a date."""
    names = [c for c in features.columns if c not in (date, "ii")]
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf"))
    counts = features.groupBy(date).agg(*(F.count(F.when(ok(c), 1)).alias(c) for c in names))
    return counts.unpivot(date, names, "feature", "_n").where("_n = 0").select(date, "feature")
