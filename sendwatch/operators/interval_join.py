"""Equi-key + day-range join.

Joins rows carrying a day (``day_col``) to the one event row per key whose
window ``[event_day - before_days, event_day]`` contains that day. The
equality key makes it a plain hash/sort-merge join with a residual range
predicate (no band or nested-loop join); callers aggregate the day side first
so it has at most one row per key and day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def within_days_before(days: DataFrame, events: DataFrame, key: str, day_col: str,
                       event_day_col: str, before_days: int) -> DataFrame:
    events = events.withColumnRenamed(key, "_event_key")
    cond = ((F.col(key) == F.col("_event_key"))
            & (F.col(day_col) >= F.date_sub(event_day_col, before_days))
            & (F.col(day_col) <= F.col(event_day_col)))
    return days.join(events, cond, "inner").drop("_event_key")
