"""Exact row ranks of distinct values, without a global sort in one task.

Exact quantiles and ``ntile`` membership only depend on where each distinct
value's rows sit in the sorted order. This module computes, per group key
and distinct value, the 1-based rank range [start, end] of its rows:

  1. aggregate to (key, value) -> count: a value held by a third of all rows
     becomes one row (partial aggregation before the shuffle);
  2. split each key's distinct values into ``buckets`` ranges using
     approximate-quantile boundaries over the distinct values (one small
     array per key, written once: a sketch recomputed in another order may give
     other boundaries); there are more buckets for more distinct values, so a
     bucket stays bounded;
  3. running count inside each (key, bucket) — a bounded window, since a
     bucket holds about 1/``buckets`` of the key's distinct values;
  4. per-bucket totals -> offsets (key x buckets rows) added to the local
     running count. The small tables are joined without a hint: Spark
     broadcasts them by their size.

NULL values are excluded from the ranks; ``n_null`` per key is reported so
callers can place NULLs last.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendwatch.session import materialize

DEFAULT_BUCKETS = 64
BUCKET_VALUES = 100_000   # distinct values that a bucket should hold at most


def _bucket_count(freq: DataFrame, least: int) -> int:
    return max(least, -(-freq.count() // BUCKET_VALUES))


def value_ranks(df: DataFrame, keys: Sequence[str], value: str, buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(keys..., value, cnt, start, end, n, n_null) for every non-NULL
    distinct value; ``n`` counts the key's non-NULL rows."""
    keys = list(keys)
    if not keys:
        return _single_group_ranks(df, value, buckets)
    v = F.col(value)
    freq = materialize(df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("cnt")))
    buckets = _bucket_count(freq, buckets)
    nulls = freq.where(v.isNull()).select(*keys, F.col("cnt").alias("n_null"))
    freq = freq.where(v.isNotNull())
    qs = [i / buckets for i in range(1, buckets)]
    bounds = materialize(freq.groupBy(*keys).agg(
        F.percentile_approx(v, qs, max(10_000, 100 * buckets)).alias("_bounds")))
    bucket = F.size(F.filter(F.col("_bounds"), lambda b: b < v))
    tagged = freq.join(bounds, keys).withColumn("_bk", bucket).drop("_bounds")
    local_w = Window.partitionBy(*keys, "_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_lend", F.sum("cnt").over(local_w))
    totals = tagged.groupBy(*keys, "_bk").agg(F.sum("cnt").alias("_bt"))
    by_key = Window.partitionBy(*keys)
    offsets = (totals
               .withColumn("_off", F.coalesce(F.sum("_bt").over(
                   by_key.orderBy("_bk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
               .withColumn("n", F.sum("_bt").over(by_key))
               .select(*keys, "_bk", "_off", "n"))
    ranked = (local.join(offsets, [*keys, "_bk"])
              .withColumn("end", F.col("_off") + F.col("_lend"))
              .withColumn("start", F.col("end") - F.col("cnt") + 1))
    ranked = ranked.join(nulls, keys, "left")
    return ranked.select(*keys, value, "cnt", "start", "end", "n",
                         F.coalesce("n_null", F.lit(0)).alias("n_null"))


def _single_group_ranks(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """value_ranks for one group. The bucket boundaries (buckets - 1 values)
    and the bucket totals (at most ``buckets`` rows) are bounded summaries,
    read once and inlined as literals, so no join is needed."""
    v = F.col(value)
    freq = materialize(df.groupBy(value).agg(F.count(F.lit(1)).alias("cnt")))
    buckets = _bucket_count(freq, buckets)
    qs = [i / buckets for i in range(1, buckets)]
    head = freq.agg(F.percentile_approx(v, qs, max(10_000, 100 * buckets)).alias("b"),
                    F.sum(F.when(v.isNull(), F.col("cnt"))).alias("n_null")).first()
    bounds, n_null = head["b"] or [], head["n_null"] or 0
    bucket = (F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda x: x < v))
              if bounds else F.lit(0))
    tagged = freq.where(v.isNotNull()).withColumn("_bk", bucket)
    local = tagged.withColumn("_lend", F.sum("cnt").over(
        Window.partitionBy("_bk").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)))
    totals = sorted((r["_bk"], r["t"]) for r in tagged.groupBy("_bk").agg(F.sum("cnt").alias("t")).collect())
    off, run = None, 0
    for bk, t in totals:
        off = F.when(F.col("_bk") == bk, F.lit(run)) if off is None else off.when(F.col("_bk") == bk, F.lit(run))
        run += t
    off = off.otherwise(F.lit(0)) if off is not None else F.lit(0)
    return (local.withColumn("end", off + F.col("_lend"))
            .withColumn("start", F.col("end") - F.col("cnt") + 1)
            .select(value, "cnt", "start", "end", F.lit(run).cast("bigint").alias("n"),
                    F.lit(n_null).cast("bigint").alias("n_null")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, qs: Sequence[float],
                    buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """(keys..., q_0, q_1, ...): linear-interpolation quantiles (position
    (n-1)q between order statistics), NULLs ignored."""
    keys = list(keys)
    r = value_ranks(df, keys, value, buckets)
    aggs = []
    for i, q in enumerate(qs):
        pos = (F.col("n") - 1) * F.lit(float(q))
        lo, hi = F.floor(pos) + 1, F.ceil(pos) + 1            # 1-based ranks
        at = lambda k: (F.col("start") <= k) & (k <= F.col("end"))
        aggs += [F.max(F.when(at(lo), F.col(value))).alias(f"_lo{i}"),
                 F.max(F.when(at(hi), F.col(value))).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_fr{i}")]
    got = r.groupBy(*keys).agg(*aggs)
    return got.select(*keys, *[
        (F.col(f"_lo{i}") + F.col(f"_fr{i}") * (F.col(f"_hi{i}") - F.col(f"_lo{i}"))).alias(f"q_{i}")
        for i in range(len(qs))])
