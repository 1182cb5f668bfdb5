"""Dates as yyyymmdd numbers, and times behind them as hhmm or hhmmss."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .guards import day


def number(d: Column) -> Column:
    """A date as yyyymmdd."""
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def shifted(x: Column, days: int) -> Column:
    """The yyyymmdd some days later; NULL if x is no date."""
    return number(F.date_add(day(x), days))


def iso_week(x: Column) -> Column:
    """(year, week, weekday) of the ISO calendar, weekdays 1 to 7 from Monday; the year is that of the week's Thursday."""
    d = day(x)
    weekday = F.weekday(d) + 1
    return F.struct(F.year(F.date_add(d, 4 - weekday)).alias("year"), F.weekofyear(d).alias("week"), weekday.alias("weekday"))


def combined(date: Column, time: Column) -> Column:
    """yyyymmddhhmm, or yyyymmddhhmmss where the time has seconds (10000 and above)."""
    date, time = date.cast("long"), time.cast("long")
    return F.when(time < 10000, date * 10000 + time).otherwise(date * 1000000 + time)


def split_time(x: Column) -> Column:
    """(date, time) of a number that ``combined`` gives, or of a date alone."""
    x = x.cast("long")
    by = F.when(x < 100_000_000, 1).when(x < 1_000_000_000_000, 10000).otherwise(1000000).cast("long")
    return F.struct(F.floor(x / by).cast("long").alias("date"), F.pmod(x, by).alias("time"))


def hours(first: Column, last: Column) -> Column:
    """yyyymmddhh of every hour from one to another, both included."""
    stamp = lambda c: F.to_timestamp_ntz(c.cast("long").cast("string"), F.lit("yyyyMMddHH"))
    found = F.sequence(stamp(first), stamp(last), F.expr("interval 1 hour"))
    return F.transform(found, lambda t: F.date_format(t, "yyyyMMddHH").cast("long"))


def month_of(x: Column) -> Column:
    """The first and the last day of a date's month."""
    first = F.trunc(day(x), "month")
    return F.struct(number(first).alias("first"), number(F.last_day(first)).alias("last"))
