"""Rate columns. Counts are aggregated as integers and divided last, in DOUBLE.

``frac`` is a count-over-count fraction (NULL when the denominator is 0, where
ANSI division would raise); ``pct`` is the percent form used by the weekly and
account-level wide tables.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def frac(num, den) -> Column:
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def pct(num, den) -> Column:
    return F.try_divide(F.lit(100.0) * _c(num).cast("double"), _c(den).cast("double"))
