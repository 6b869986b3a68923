"""Profiling statistics as single-pass aggregates.

Every statistic is an aggregate over the (account-level) frame: one scan,
partial aggregation per task, results unpivoted to long tables. Floating
results are rounded to 6 decimals so that order-dependent sums are stable.
Exact quantiles come from distributed ranks (``operators/ranks.py``) rather
than ``percentile``, whose buffer would hold every distinct value of a column
in one task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.operators.ranks import exact_quantiles

DIGITS = 6
SEP = "|"


def r6(c: Column) -> Column:
    return F.round(c, DIGITS)


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], list(columns), "column_name", "value")


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, quartiles, max per column (long form).
    Quartiles are exact (linear interpolation) from distributed ranks."""
    long = _long(df, columns)
    basic = long.groupBy("column_name").agg(
        F.count("value").alias("count"), r6(F.avg("value")).alias("mean"),
        r6(F.stddev_samp("value")).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    q = exact_quantiles(long, ["column_name"], "value", [0.25, 0.5, 0.75])
    return (basic.join(q, "column_name", "left")
            .select("column_name", "count", "mean", "std", "min", r6(F.col("q_0")).alias("p25"),
                    r6(F.col("q_1")).alias("p50"), r6(F.col("q_2")).alias("p75"), "max"))


def non_null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    return (row.unpivot(["_n"], list(columns), "column_name", "non_null")
            .select("column_name", "non_null", F.col("_n").alias("n_rows")))


def corr_long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair (a <= b in list order).

    Two passes, both plain aggregates: column means and constant flags come
    back as one summary row (bounded: two values per column), then a single
    pass sums the centred
    cross products (numerically as stable as an online update, and far
    cheaper to generate code for than hundreds of ``corr`` buffers). A
    constant column gives NULL (``corr`` would raise a division by zero
    under ANSI)."""
    cols = list(columns)
    x = {c: F.col(c).cast("double") for c in cols}
    # one summary row (2 values per column) -> literals for the second pass
    summary = df.agg(*[F.avg(x[c]).alias(f"mean_{c}") for c in cols],
                     *[(F.min(x[c]) == F.max(x[c])).alias(f"const_{c}") for c in cols]).first()
    mean = {c: summary[f"mean_{c}"] for c in cols}
    const_of = {c: summary[f"const_{c}"] is not False for c in cols}
    centred = df.select(*[(x[c] - F.lit(mean[c] if mean[c] is not None else 0.0)).alias(c) for c in cols])
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    sums = centred.agg(*[F.sum(F.col(a) * F.col(b)).alias(f"{a}{SEP}{b}") for a, b in pairs])
    out = []
    for a, b in pairs:
        r = F.try_divide(F.col(f"{a}{SEP}{b}"),
                         F.sqrt(F.col(f"{a}{SEP}{a}") * F.col(f"{b}{SEP}{b}")))
        value = F.lit(None).cast("double") if const_of[a] or const_of[b] else r6(r)
        out.append(value.alias(f"{a}{SEP}{b}"))
    names = [f"{a}{SEP}{b}" for a, b in pairs]
    return (sums.select(*out).unpivot([], names, "pair", "corr")
            .select(F.split_part("pair", F.lit(SEP), F.lit(1)).alias("col_a"),
                    F.split_part("pair", F.lit(SEP), F.lit(2)).alias("col_b"), "corr"))


def automatic_bins(df: DataFrame, column: str) -> int:
    """Bins for a column's values: the larger of the Sturges count,
    log2(n) + 1, and the Freedman-Diaconis count, whose width is twice the
    distance of the exact quartiles over the cube root of n (left out where the
    quartiles agree). One summary row reaches the driver."""
    v = F.col(column).cast("double")
    base = df.where(v.isNotNull()).select(v.alias("value"))
    quartiles = exact_quantiles(base, [], "value", [0.25, 0.75])
    row = base.agg(F.count("value").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi")).first()
    if not row["n"] or row["lo"] == row["hi"]:
        return 1
    q1, q3 = quartiles.first()
    sturges = math.ceil(round(math.log2(row["n"]) + 1, 9))
    if q1 == q3:
        return sturges
    width = 2 * (q3 - q1) / row["n"] ** (1 / 3)
    return max(sturges, math.ceil(round((row["hi"] - row["lo"]) / width, 9)))


def histogram(df: DataFrame, column: str, bins: int | None = None, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width histogram (non-empty bins); without ``bins`` their number
    follows the data (``automatic_bins``). Without a range the bins span
    [min, max] (one summary row read first) and the maximum falls into the
    last bin; with a range, values outside it are dropped."""
    v = F.col(column).cast("double")
    bins = automatic_bins(df, column) if bins is None else bins
    base = df.where(v.isNotNull())
    if lo is None or hi is None:
        # the range is one summary row (two values), fetched once and inlined
        rng = base.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        if rng["lo"] is None:
            return base.select(F.lit(1).cast("bigint").alias("bin"), F.lit(None).cast("double").alias("bin_lo"),
                               F.lit(None).cast("double").alias("bin_hi"), F.lit(0).cast("bigint").alias("n")).limit(0)
        lo_c, hi_c = F.lit(float(rng["lo"])), F.lit(float(rng["hi"]))
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
        base = base.where((v >= lo_c) & (v <= hi_c))
    width = hi_c - lo_c
    raw = F.floor((v - lo_c) * F.lit(float(bins)) / width).cast("bigint") + 1
    b = F.when(width == 0, F.lit(1).cast("bigint")).otherwise(F.least(raw, F.lit(bins).cast("bigint")))
    counted = base.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edge = lambda k: lo_c + width * (k - F.lit(1.0)) / F.lit(float(bins))
    return counted.select("bin", r6(edge(F.col("bin"))).alias("bin_lo"),
                          r6(edge(F.col("bin") + 1)).alias("bin_hi"), "n")


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return (df.select(*[F.col(c).cast("string").alias(c) for c in columns])
            .unpivot([], list(columns), "feature", "value")
            .groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n")))


def group_sums(df: DataFrame, keys: Sequence[Column], columns: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"),
                                 *[r6(F.sum(F.col(c).cast("double"))).alias(f"sum_{c}") for c in columns])


def column_totals(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = df.agg(*[r6(F.sum(F.col(c).cast("double"))).alias(c) for c in columns])
    return row.unpivot([], list(columns), "column_name", "total")


def mean_by_flag(df: DataFrame, flags: Sequence[str], values: Sequence[str]) -> DataFrame:
    long = (df.select(*[F.col(f).cast("string").alias(f) for f in flags], *values)
            .unpivot(list(values), list(flags), "flag", "flag_value"))
    return long.groupBy("flag", "flag_value").agg(*[r6(F.avg(v)).alias(f"mean_{v}") for v in values])


def quantile_summary(df: DataFrame, column: str, q: float, above: float) -> DataFrame:
    """describe() of one column plus its q-quantile and the count above a
    threshold (one row). The four exact quantiles are one bounded summary
    row, inlined as literals into the aggregate."""
    v = F.col(column).cast("double")
    one = df.select(v.alias("_v"))
    qrow = exact_quantiles(one, [], "_v", [0.25, 0.5, 0.75, q]).first()
    lit = lambda i: F.lit(qrow[f"q_{i}"] if qrow else None).cast("double")
    return one.agg(F.count("_v").alias("n"), r6(F.avg("_v")).alias("mean"),
                   r6(F.stddev_samp("_v")).alias("std"), F.min("_v").alias("min"),
                   r6(lit(0)).alias("p25"), r6(lit(1)).alias("p50"), r6(lit(2)).alias("p75"),
                   F.max("_v").alias("max"), r6(lit(3)).alias("p_q"),
                   F.count_if(F.col("_v") > above).alias("n_above"))
