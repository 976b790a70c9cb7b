"""Time buckets of epoch seconds, all in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _date(seconds: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(seconds / 86400).cast("int"))


def day_key(seconds: Column) -> Column:
    return F.date_format(_date(seconds), "yyyy-MM-dd")


def sunday_key(seconds: Column) -> Column:
    """The Sunday on or before the day."""
    d = _date(seconds)
    return F.date_format(F.date_sub(d, F.dayofweek(d) - 1), "yyyy-MM-dd")


def month_key(seconds: Column) -> Column:
    return F.date_format(_date(seconds), "yyyy-MM")


def iso_week_key(seconds: Column) -> Column:
    """ISO week-year and week, as 2025-W01."""
    d = _date(seconds)
    return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), d).cast("string"), 2, "0"))
