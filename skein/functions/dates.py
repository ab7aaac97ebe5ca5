"""Date functions on timestamps in the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_date(c: Column) -> Column:
    """A timestamp from an ISO text, a date or milliseconds since 1970; null for other texts."""
    return c.try_cast("timestamp")


def from_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def date_add(c: Column, unit: str, n: int) -> Column:
    """unit: second, minute, hour or day."""
    return F.timestamp_add(unit.upper(), F.lit(n), c)


def date_diff(c: Column, other: Column) -> Column:
    """Whole seconds from other to c."""
    return F.unix_timestamp(c) - F.unix_timestamp(other)
