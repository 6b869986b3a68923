"""Exact ``ntile(N) over (order by v)`` membership without a global sort.

A global ``ntile`` window moves every row into one partition. Tile membership
only depends on each row's rank, and all rows sharing a value occupy a
contiguous rank range, so it is enough to know, per distinct value, its rank
range [start, end] (``operators/ranks.py``: value frequencies, bucketed
running counts, broadcast offsets — no single-partition step), and to keep a
value when that range overlaps a wanted tile.

With n rows, q = n div N and r = n mod N, tiles 1..r hold q+1 rows and the rest
q rows; rank i falls in tile ``(i-1) div (q+1) + 1`` when i <= r(q+1), else
``r + (i - r(q+1) - 1) div q + 1``. NULLs sort last, as in the reference
engine.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.operators.ranks import value_ranks


def _tile_of(i: Column, n: Column, n_tiles: int) -> Column:
    q = F.floor(n / n_tiles).cast("bigint")
    r = (n % n_tiles).cast("bigint")
    big = r * (q + 1)
    return (F.when(i <= big, F.floor((i - 1) / (q + 1)) + 1)
            .otherwise(r + F.floor((i - big - 1) / q) + 1)).cast("bigint")


def tile_cutpoints(df: DataFrame, value: str, tiles: Iterable[int], n_tiles: int = 100) -> DataFrame:
    """Distinct values of ``value`` whose rows fall into any of ``tiles``
    (NULLs sort last and count as rows)."""
    r = value_ranks(df, [], value)
    total = F.col("n") + F.col("n_null")

    def hit(start, end):
        t_lo, t_hi = _tile_of(start, total, n_tiles), _tile_of(end, total, n_tiles)
        cond = None
        for t in tiles:
            c = (F.lit(t) >= t_lo) & (F.lit(t) <= t_hi)
            cond = c if cond is None else cond | c
        return cond

    values = r.where(hit(F.col("start"), F.col("end"))).select(value)
    null_rows = (r.groupBy().agg(F.max("n").alias("n"), F.max("n_null").alias("n_null"))
                 .where((F.col("n_null") > 0) & hit(F.col("n") + 1, total))
                 .select(F.lit(None).cast(df.schema[value].dataType).alias(value)))
    return values.unionByName(null_rows)
