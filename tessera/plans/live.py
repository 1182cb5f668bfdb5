"""How far back an expression reads, reruns of a range of dates, and values of a day that is still open.

Dates ``dti`` are positions in a calendar, so a panel has a row for each of them.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cross import CROSS, GROUP
from ..functions.guards import fin
from ..functions.scalar import SCALAR
from ..functions.series import RAW_ONLY, SERIES
from ..sources.panel import write_range
from .compile import FILL, Plan, number
from .parse import Node, parse

#: Apart from each other, the dates of two open days are so many numbers.
APART = 1 << 32


def reach(node: Node | str) -> int:
    """Rows before a date that its value depends on.

    A trailing function reads its frame, and one that fills gaps the longest gap
    before the frame too; functions inside each other add up.
    """
    if isinstance(node, str):
        node = parse(node)
    name, parts = node.value, node.children
    inner = max((reach(p) for p in parts), default=0)
    if not parts or name in SCALAR or name in CROSS or name in GROUP or name == "let":
        return inner
    if name in ("c_reg", "ts_reg"):
        return inner + int(number(parts[-2])) - 1
    raw = name.endswith("_raw") or name in RAW_ONLY
    inputs, _, more, _ = SERIES.get(name.removesuffix("_raw")) or RAW_ONLY[name]
    rows = number(parts[inputs]) + (number(parts[inputs + 1]) if more == math.inf else more)
    return inner + int(rows) - 1 + (0 if raw else FILL + 1)


def evaluate_range(panel: DataFrame, expression: str, start: int, end: int, mask: str | None = "univ") -> DataFrame:
    """(dti, ii, value) on the dates of [start, end), from no more of ``panel`` than they depend on; a panel partitioned by date is read in part."""
    node = parse(expression)
    plan = Plan(panel.where((F.col("dti") >= start - reach(node)) & (F.col("dti") < end)), mask)
    c = plan.build(node)
    return plan.df.where(F.col("dti") >= start).select("dti", "ii", plan.masked(fin(c)).alias("value"))


def rerun(spark: SparkSession, source: str, target: str, expression: str, start: int, end: int, mask: str | None = "univ") -> None:
    """Compute the dates of [start, end) of a stored panel anew, after its late revision, and overwrite only them in the stored values."""
    write_range(evaluate_range(spark.read.parquet(source), expression, start, end, mask), target)


def evaluate_live(closed: DataFrame, live: DataFrame, expression: str, mask: str | None = "univ") -> DataFrame:
    """(dti, ii, value) on the dates of ``live`` (as ``closed``: dti, ii, fields): each as if its rows came after the closed rows of earlier dates.

    History is what has closed; only a date's own rows are live, whether or not they
    have closed by now.  Every live date takes the closed rows that it depends on and
    its own as a panel of its own, side by side with the others', so functions inside
    functions see closed values on earlier dates and live ones on the last.  The live
    table is read once, apart from its dates.
    """
    node = parse(expression)
    back = reach(node)
    first, last = live.agg(F.min("dti"), F.max("dti")).first()
    if first is None:
        first, last = 0, -1
    days = live.select(F.col("dti").cast("long").alias("_day")).distinct()
    old = closed.where((F.col("dti") >= first - back) & (F.col("dti") < last))
    ahead = F.sequence(F.greatest(F.col("dti") + 1, F.lit(first)).cast("long"), F.least(F.col("dti") + back, F.lit(last)).cast("long"))
    some = F.greatest(F.col("dti") + 1, F.lit(first)) <= F.least(F.col("dti") + back, F.lit(last))
    old = old.where(some).withColumn("_day", F.explode(ahead)).join(days, "_day", "left_semi")
    rows = live.withColumn("_day", F.col("dti").cast("long")).unionByName(old, allowMissingColumns=True)
    rows = rows.withColumn("_at", F.col("_day") * APART + F.col("dti")).withColumn("_key", F.struct("ii", "_day"))
    plan = Plan(rows, mask, "_at", "_key")
    c = plan.build(node)
    return plan.df.where(F.col("dti") == F.col("_day")).select("dti", "ii", plan.masked(fin(c)).alias("value"))
