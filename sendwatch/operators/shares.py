"""Frequency tables with each group's share of the total.

The total is a one-row global aggregate attached as a scalar subquery: it is
computed once, partially per map task, and shipped to executors as a literal.
No single-partition window, no cross join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency_with_share(df: DataFrame, keys: Sequence[str], count_name: str,
                         share_name: str) -> DataFrame:
    freq = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    # summed from the (small) frequency table: the aggregate's shuffle is
    # shared with the main plan instead of rescanning the input
    total = freq.agg(F.sum(count_name).cast("double"))
    return freq.withColumn(share_name, F.col(count_name).cast("double") / total.scalar())
