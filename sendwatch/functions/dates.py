"""Calendar expressions (zone independent).

Event times are ``TIMESTAMP_NTZ`` holding UTC wall time. Everything here keeps
them NTZ, so results never depend on the session time zone:
  * week start is ISO Monday (``trunc(date, 'week')``), emitted as 'yyyy-MM-dd'
  * Pacific wall time uses ``convert_timezone`` (NTZ in, NTZ out)
  * complete months between two dates use ``floor(months_between)``
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

PACIFIC = "America/Los_Angeles"


def ts_lit(value) -> Column:
    """A TIMESTAMP_NTZ literal from a date, datetime or ISO string."""
    if isinstance(value, dt.datetime):
        value = value.isoformat(sep=" ")
    elif isinstance(value, dt.date):
        value = f"{value.isoformat()} 00:00:00"
    return F.lit(value).cast("timestamp_ntz")


def date_lit(value) -> Column:
    if isinstance(value, (dt.date, dt.datetime)):
        value = value.isoformat()[:10]
    return F.lit(value).cast("date")


def week_start(ts: Column) -> Column:
    """Monday of the ISO week containing ``ts`` (DATE)."""
    return F.trunc(F.to_date(ts), "week")


def week_key(ts: Column) -> Column:
    return F.date_format(week_start(ts), "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def pacific(ts: Column) -> Column:
    """UTC wall time -> US/Pacific wall time."""
    return F.convert_timezone(F.lit("UTC"), F.lit(PACIFIC), ts)


def complete_months(start: Column, end: Column) -> Column:
    """Whole months from ``start`` to ``end`` (dates)."""
    return F.floor(F.months_between(end, start, roundOff=False)).cast("int")


def monday_of(day: dt.date) -> dt.date:
    return day - dt.timedelta(days=day.weekday())
