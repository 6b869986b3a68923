"""Top-1 row per group as an aggregate, not a window.

``row_number() over (partition by k order by ...) = 1`` sorts every row of a
group inside one task; a sender holding a third of all traffic would land in a
single task. Picking the extreme of a struct is an ordinary aggregate: Spark
runs it partial (map side) then final, so a hot key is reduced to one row per
map task before the shuffle. Ties are made deterministic by putting the tie
breakers into the struct.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def latest_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                     carry: Sequence[str]) -> DataFrame:
    """Row with the greatest ``order`` tuple per ``keys`` (ORDER BY ... DESC,
    NULLS LAST); returns keys + order + carry columns."""
    fields = list(dict.fromkeys([*order, *carry]))
    picked = F.max(F.struct(*[_col(c).alias(c) for c in fields])).alias("_pick")
    return df.groupBy(*keys).agg(picked).select(*keys, *[F.col(f"_pick.{c}").alias(c) for c in fields])


def mode_per_group(df: DataFrame, keys: Sequence[str], value: str, count_col: str = "ct") -> DataFrame:
    """Most frequent value per group from a (keys, value, count) frequency
    table. Ties go to the smallest value, NULL values last."""
    ranked = F.min(F.struct(
        (-F.col(count_col)).alias("neg_ct"),
        F.col(value).isNull().alias("is_null"),
        F.col(value).alias("v"),
        F.col(count_col).alias("ct"),
    )).alias("_pick")
    return (df.groupBy(*keys).agg(ranked)
            .select(*keys, F.col("_pick.v").alias(value), F.col("_pick.ct").alias(count_col)))
