"""Time expressions. The clock is always the ``as_of`` argument."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from agora.functions.scores import ColumnOrName, _c


def moment(as_of: datetime | str | Column) -> Column:
    """Literal timestamp for the moment a job is run for."""
    if isinstance(as_of, Column):
        return as_of
    text = as_of if isinstance(as_of, str) else as_of.strftime("%Y-%m-%d %H:%M:%S.%f")
    return F.lit(text).cast("timestamp")


def age_in_days(created_at: ColumnOrName, as_of: datetime | str | Column) -> Column:
    return F.datediff(moment(as_of), _c(created_at))


def is_recent(created_at: ColumnOrName, as_of: datetime | str | Column, days: int = 7) -> Column:
    return F.coalesce(age_in_days(created_at, as_of) <= days, F.lit(False))


def days_before(as_of: datetime | str | Column, days: int) -> Column:
    """Midnight ``days`` days before the date of ``as_of``."""
    return F.date_sub(moment(as_of).cast("date"), days).cast("timestamp")


def hours_before(as_of: datetime | str | Column, hours: int) -> Column:
    return moment(as_of) - F.expr(f"INTERVAL {int(hours)} HOURS")


def week_label(created_at: ColumnOrName, as_of: datetime | str | Column) -> Column:
    return F.when(_c(created_at) >= days_before(as_of, 7), "current").otherwise("previous")


def hour_fraction(ts: ColumnOrName) -> Column:
    """Hour of day with minutes and seconds as a fraction, e.g. 6.5."""
    return F.pmod(F.unix_timestamp(_c(ts).cast("timestamp")), F.lit(86400)) / F.lit(3600.0)


def weekday(ts: ColumnOrName) -> Column:
    """Monday is 0."""
    return F.weekday(_c(ts))


def is_weekend(ts: ColumnOrName) -> Column:
    return weekday(ts).isin(5, 6)


def seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Seconds with their fraction."""
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(1e6)


def whole_seconds_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    """Whole seconds, never negative; null while the end is open."""
    span = F.floor(seconds_between(start, end))
    return F.when(span.isNotNull(), F.greatest(span, F.lit(0)))


def days_between(start: ColumnOrName, end: ColumnOrName) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / F.lit(8.64e10)
