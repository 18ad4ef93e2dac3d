"""Dates in a fixed zone: month starts, day keys, coming days, ISO form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(at: Column) -> Column:
    """SC71: the first moment of a month."""
    return F.date_trunc("month", at)


def month_label(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM")


def day_key(at: Column, zone: str = "UTC") -> Column:
    """SC72: MM-dd of a moment given in UTC, in a zone."""
    return F.date_format(F.from_utc_timestamp(at, zone), "MM-dd")


def next_days(at: Column, n: int, zone: str = "UTC") -> Column:
    """SC72: the keys of this and the next n - 1 days."""
    day = F.to_date(F.from_utc_timestamp(at, zone))
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.date_format(F.date_add(day, i), "MM-dd"))


def iso(at: Column) -> Column:
    """SC73."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
