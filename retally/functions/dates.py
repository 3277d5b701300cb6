"""Dates kept as ``YYYYMMDD`` integers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIVE_DAYS = 7


def to_day(ymd: Column) -> Column:
    """Integer ``YYYYMMDD`` to a date; an impossible date raises (ANSI mode)."""
    return F.make_date(
        (ymd / F.lit(10000)).cast("int"),
        (ymd % F.lit(10000) / F.lit(100)).cast("int"),
        ymd % F.lit(100),
    )


def to_ymd(moment: Column) -> Column:
    """Date or timestamp to an integer ``YYYYMMDD``, as plain arithmetic."""
    return F.year(moment) * F.lit(10000) + F.month(moment) * F.lit(100) + F.dayofmonth(moment)


def is_live(latest_day: Column, as_of: Column) -> Column:
    """True while the latest event day is at most a week before ``as_of``."""
    return F.datediff(as_of, latest_day) <= F.lit(LIVE_DAYS)


def in_date_range(df: DataFrame, start: int, end: int) -> DataFrame:
    """Rows with ``event_date`` between two integers, both included.

    On a table stored by month the same bounds are put on the partition column, so whole
    months are skipped; elsewhere the file statistics of ``event_date`` do the skipping.
    """
    kept = df.filter(F.col("event_date").between(start, end))
    if "event_month" in df.columns:
        kept = kept.filter(F.col("event_month").between(start // 100, end // 100))
    return kept
