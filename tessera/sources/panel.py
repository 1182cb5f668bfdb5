"""Dense panels (date x instrument) from relational tables, and readers of panel files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def densify(cells: DataFrame, instruments: DataFrame, date: str = "dti", key: str = "ii") -> DataFrame:
    """Every date of ``cells`` with every instrument; missing cells are NULL.

    Trailing windows count rows, so days without an observation must have one.
    Dates and instruments are dimensions; their grid is the panel itself.
    """
    dates = cells.select(date).distinct()
    return dates.join(instruments, how="cross").join(cells, [date, key], "left")


def supplier_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dti, ii, g, univ, x, y, ret): months by suppliers, from ``lineitem`` and ``supplier``.

    x is the scaled mean price of open lines without a return (flag N, status O), y the
    scaled quantity of returned lines (flag R), ret the scaled mean price of all; a month
    without such lines is a gap.  g is a group, -1 for some; univ is the universe mask.
    Sums are of whole numbers, so they do not depend on their order.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    cents, qty = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")
    fresh = (F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "O")
    cells = items.groupBy(month.alias("dti"), F.col("l_suppkey").alias("ii")).agg(
        F.sum(cents).alias("cents"), F.sum(qty).alias("qty"), F.sum(F.when(fresh, cents)).alias("fresh_cents"), F.sum(F.when(fresh, qty)).alias("fresh_qty"),
        F.sum(F.when(F.col("l_returnflag") == "R", qty)).alias("back_qty"),
    )
    inst = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ii"), F.when(F.col("s_nationkey") < 3, -1).otherwise(F.col("s_nationkey") % 5).alias("g"), (F.col("s_acctbal") > 0).alias("univ"))
    grid = densify(cells, inst)
    price = F.col("cents").cast("double") / 100 / F.col("qty")
    x = F.col("fresh_cents").cast("double") / 100 / F.col("fresh_qty") / 1000.0123457 - 1.5
    y = F.col("back_qty").cast("double") / 100.0123457 - 0.75
    return grid.select("dti", "ii", "g", "univ", x.alias("x"), y.alias("y"), (price / 100000.123457 - 0.015).alias("ret"))


def supplier_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dti, ii, g, close, high, low, vol, dvol, shares, adj, listed, st): months by suppliers as quotes, from ``lineitem`` and ``supplier``.

    Scaled unit prices are the quotes and quantities the volume; adj is a split every
    24 months, st a flag that is unknown for some.
    """
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    month = (F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")
    cents = F.round(F.col("l_extendedprice") * 100).cast("long")
    price = cents.cast("double") / 100 / F.col("l_quantity") / 1.0123457
    cells = items.groupBy(month.alias("dti"), F.col("l_suppkey").alias("ii")).agg(
        F.max_by(price, F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey")).alias("close"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.sum(F.col("l_quantity").cast("long")).cast("double").alias("vol"), (F.sum(cents).cast("double") / 101.23457).alias("dvol"),
    )
    inst = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("ii"), F.when(F.col("s_nationkey") < 3, -1).otherwise(F.col("s_nationkey") % 5).alias("g"))
    at = F.col("dti") + F.col("ii")
    grid = densify(cells, inst).withColumn("shares", (F.lit(10) + F.col("ii") % 7).cast("double") / 10.123457).withColumn("adj", F.when(at % 24 == 0, 2.0))
    return grid.withColumn("listed", F.col("dti") >= 1 + F.col("ii") % 5).withColumn("st", F.when(at % 17 == 0, 1).when(at % 5 != 0, 0))


def filled_in(template: str, day: str) -> str:
    return template.format(yyyy=day[:4], mm=day[4:6], dd=day[6:])


def day_of(path: Column, template: str) -> Column:
    """The yyyymmdd that a path has where ``template`` has {yyyy}, {mm} and {dd}; each may come more than once."""
    kinds, places = {"{yyyy}": 4, "{mm}": 2, "{dd}": 2}, []
    pattern = ""
    for part in re.split(r"(\{yyyy\}|\{mm\}|\{dd\})", template):
        if part in kinds:
            places.append(part)
            pattern += f"(\\d{{{kinds[part]}}})"
        else:
            pattern += re.escape(part)
    return F.concat(*(F.regexp_extract(path, pattern + "$", places.index(k) + 1) for k in kinds))


def read_templated(spark: SparkSession, template: str, days: list[str], **options) -> DataFrame:
    """Delimited files of some days, with ``day``; ``template`` holds {yyyy}, {mm} and {dd}, and days are yyyymmdd.

    One scan over all paths, of which each row's says its day; columns go by the first
    file's header.  Days without a file have no rows.
    """
    paths = []
    for d in days:
        path = spark._jvm.org.apache.hadoop.fs.Path(filled_in(template, d))
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            paths.append(path.toString())
    if not paths:
        raise FileNotFoundError(f"no day of {template}")
    df = spark.read.options(header=True, **options).csv(paths)
    return df.select("*", day_of(F.col("_metadata.file_path"), template.rsplit("/", 1)[-1] if "{" in template.rsplit("/", 1)[-1] else template).alias("day"))


def read_positions(spark: SparkSession, path: str, instruments: DataFrame, date: str = "dti") -> DataFrame:
    """Positions as write_positions leaves them, for known instruments (ii) only."""
    rows = spark.read.option("sep", "|").option("header", True).csv(path)
    return rows.select(F.col(date).cast("int"), F.expr("try_cast(ii as long)").alias("ii"), F.expr("try_cast(value as double)").alias("value")).join(instruments.select("ii"), "ii", "left_semi").select(date, "ii", "value")


def read_delimited(spark: SparkSession, path: str, sep: str = "|") -> DataFrame:
    """Text with a header, plain or gzip by suffix; every cell is text until a lenient cast."""
    return spark.read.option("header", True).option("sep", sep).csv(path)


def lenient(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Cells as numbers: what does not parse is NULL for doubles, 0 for integers, false for Booleans."""
    fallback = {"double": None, "float": None, "int": 0, "bigint": 0, "boolean": False}
    return df.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as {kind})"), F.lit(fallback[kind]).cast(kind)) for c, kind in kinds.items()})


def trade_calendar(spark: SparkSession, path: str) -> DataFrame:
    """(dt) from text: the first comma-separated token of each line."""
    return spark.read.text(path).select(F.expr("try_cast(split(value, ',')[0] as int)").alias("dt")).where("dt is not null").distinct()


def listing(instruments: DataFrame, calendar: DataFrame, parts: int = 64) -> DataFrame:
    """(dt, ii): instruments (ii, list, delist) on the dates of [list, delist); a NULL delist never ends.

    The calendar is cut into ``parts`` stretches; an instrument has a row for each
    stretch it is listed in, which meet the dates by an equal join.
    """
    first, last = calendar.agg(F.min("dt"), F.max("dt")).first()
    if first is None:
        return calendar.select("dt").join(instruments.select("ii").limit(0), how="cross")
    width = max(1, -(-(last - first + 1) // parts))
    part = lambda c: F.floor((c - F.lit(first)) / width).cast("int")
    begin, end = F.greatest("list", F.lit(first)), F.least(F.coalesce("delist", F.lit(last + 1)) - 1, F.lit(last))
    spans = instruments.where((F.col("list").isNotNull()) & (begin <= end)).withColumn("_part", F.explode(F.sequence(part(begin), part(end))))
    found = calendar.withColumn("_part", part(F.col("dt"))).join(spans, "_part")
    return found.where((F.col("dt") >= F.col("list")) & (F.col("dt") < F.coalesce("delist", F.lit(last + 1)))).select("dt", "ii")


def write_range(panel: DataFrame, path: str, date: str = "dti") -> None:
    """Overwrite only the dates that ``panel`` has, in a table partitioned by date."""
    panel.write.option("partitionOverwriteMode", "dynamic").partitionBy(date).mode("overwrite").parquet(path)


def write_positions(signal: DataFrame, path: str, date: str = "dti") -> None:
    """One folder of pipe-separated positions per date; missing weights are left out."""
    signal.where("value is not null").write.partitionBy(date).option("sep", "|").option("header", True).mode("overwrite").csv(path)
