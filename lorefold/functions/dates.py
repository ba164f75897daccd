"""Dates and instants as column expressions; the session's time zone is UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PRECISIONS = ("exact", "day", "month", "quarter", "year", "relative_unresolved")


def days_between(earlier: Column, later: Column) -> Column:
    """Days with fraction, negative if ``later`` is the earlier one."""
    return (F.unix_millis(later) - F.unix_millis(earlier)) / F.lit(86_400_000.0)


def within_days(at: Column, now: Column, days: float) -> Column:
    return days_between(now, at).between(0, days)


def within_past_days(at: Column, now: Column, days: float) -> Column:
    return days_between(at, now).between(0, days)


def discard_expiry(decided_at: Column) -> Column:
    return decided_at + F.expr("INTERVAL 30 DAYS")


def local_date(at: Column, zone: str) -> Column:
    return F.date_format(F.from_utc_timestamp(at, zone), "yyyy-MM-dd")


def resolve_date(timestamp: Column, precision: Column, phrase: Column) -> Column:
    """struct<ts, precision, phrase>; null without a phrase or a known precision.

    Without a readable timestamp the precision is relative_unresolved; a date alone is midnight.
    """
    known = F.array_contains(F.array(*map(F.lit, PRECISIONS)), precision) & phrase.isNotNull()
    ts = F.try_to_timestamp(timestamp)
    return F.when(known, F.struct(ts.alias("ts"), F.when(ts.isNull(), F.lit(PRECISIONS[-1])).otherwise(precision).alias("precision"), phrase.alias("phrase")))


def is_time_ordered(precision: Column, timestamp: Column) -> Column:
    return (precision != PRECISIONS[-1]) & timestamp.isNotNull()
