"""Missing values and IEEE arithmetic on nullable doubles.

Inside the engine a missing cell is NULL, never NaN; infinities stay, and
functions that ask for a valid cell take only finite ones.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def real(x: Column) -> Column:
    """A double with NaN as NULL."""
    x = x.cast("double")
    return F.when(~F.isnan(x), x)


def fin(x: Column) -> Column:
    """The value where it is finite."""
    return F.when(F.abs(x) < INF, x)


def div(x: Column, y: Column) -> Column:
    """IEEE division: a zero divisor gives an infinity, 0/0 NULL."""
    return F.when(y != 0, real(x / F.when(y != 0, y))).when(x > 0, INF).when(x < 0, -INF)


def flag(condition: Column, missing: bool = False) -> Column:
    """1 or 0; ``missing`` is what a NULL condition counts as."""
    return F.coalesce(condition, F.lit(missing)).cast("double")


def power(x: Column, e: float) -> Column:
    return F.when((x == 0) & F.lit(e < 0), INF).when((x < 0) & F.lit(e != int(e)), None).otherwise(F.pow(x, F.lit(float(e))))


def day(x: Column) -> Column:
    """A yyyymmdd number as a date."""
    return F.try_to_date(x.cast("long").cast("string"), "yyyyMMdd")
