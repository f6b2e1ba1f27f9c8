"""Naive IST wall clock and UTC seconds.

``ts`` columns are ``timestamp_ntz`` holding Indian wall clock at bar open. Everything here is
arithmetic on that local value, so no result depends on ``spark.sql.session.timeZone``.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

IST_OFFSET_SECONDS = 19800
SECONDS_PER_DAY = 86400
EPOCH_DATE = date(1970, 1, 1)


def ntz(value: str | datetime | Column) -> Column:
    """A ``timestamp_ntz`` column from ISO text, a datetime or a column."""
    if isinstance(value, Column):
        return value.cast("timestamp_ntz")
    if isinstance(value, datetime):
        value = value.isoformat(sep=" ")
    return F.lit(value).cast("timestamp_ntz")


def day(value: str | date | Column) -> Column:
    """A ``date`` column from ISO text, a date or a column."""
    if isinstance(value, Column):
        return value.cast("date")
    return F.lit(str(value)).cast("date")


def local_seconds(ts: Column) -> Column:
    """Whole seconds from 1970-01-01 00:00 to the wall clock value, as bigint."""
    whole_days = F.datediff(ts.cast("date"), F.lit(EPOCH_DATE)).cast("bigint")
    return whole_days * SECONDS_PER_DAY + (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts))


def utc_seconds(ts: Column) -> Column:
    """UTC epoch seconds of an IST wall clock value."""
    return local_seconds(ts) - F.lit(IST_OFFSET_SECONDS)


def ist_from_utc_seconds(seconds: Column) -> Column:
    """IST wall clock of a UTC epoch second."""
    return F.timestamp_add(
        "SECOND", seconds.cast("bigint") + F.lit(IST_OFFSET_SECONDS), ntz("1970-01-01 00:00:00")
    )


def midnight(d: Column) -> Column:
    """00:00 of a date, as ``timestamp_ntz``."""
    return d.cast("timestamp_ntz")


def window_end(range_to: Column) -> Column:
    """Exclusive right edge of an inclusive calendar range."""
    return midnight(F.date_add(range_to, 1))


def iso_weekday(d: Column) -> Column:
    """Monday = 1 .. Sunday = 7."""
    return F.weekday(d) + 1


def date_from_utc_seconds(seconds: Column) -> Column:
    """IST calendar date of a UTC epoch second."""
    days = F.floor((seconds + F.lit(IST_OFFSET_SECONDS)) / F.lit(SECONDS_PER_DAY)).cast("int")
    return F.date_add(F.lit(EPOCH_DATE), days)


def span_days(start: Column, end: Column) -> Column:
    """Inclusive day count of [start, end]."""
    return F.datediff(end, start) + 1
