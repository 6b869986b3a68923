"""Profile of the assembled feature tables (summary statistics, non-null
counts, correlations, histograms, cohort sums and flag means)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.operators import stats
from sendwatch.plans.assemble import COUNT_COLUMNS, OUTPUT_COLUMNS, RATE_COLUMNS

NUMERIC = [*COUNT_COLUMNS, *RATE_COLUMNS]
FLAGS = ["parent", "isv", "cannabis"]
# --- fixed values: cohort thresholds and histogram settings -----------------
YOUNG_MONTHS = 12
SMALL_FAMILY = 50
BINS_21610 = 20
RISK_BINS, RISK_RANGE = 10, (0.0, 10.0)
RISK_SCALE = 100.0
# ---------------------------------------------------------------------------


def describe_features(features: DataFrame) -> DataFrame:
    return stats.describe(features, NUMERIC)


def null_counts(merged: DataFrame) -> DataFrame:
    cols = [c for c in merged.columns if c != "account_id"]
    return stats.non_null_counts(merged, cols)


def corr_features(features: DataFrame) -> DataFrame:
    return stats.corr_long(features, NUMERIC)


def hist_age(features: DataFrame) -> DataFrame:
    return stats.histogram(features, "age")


def hist_unreachable(features: DataFrame) -> DataFrame:
    return stats.histogram(features, "unreachable_frac")


def hist_21610(features: DataFrame) -> DataFrame:
    return stats.histogram(features, "frac_21610", BINS_21610)


def risk_frame(predicted: DataFrame, prediction: str = "optout_pred") -> DataFrame:
    """Risk score = 100 x predicted opt-out rate."""
    return predicted.withColumn("risk", F.lit(RISK_SCALE) * F.col(prediction))


def hist_risk(predicted: DataFrame) -> DataFrame:
    lo, hi = RISK_RANGE
    return stats.histogram(risk_frame(predicted), "risk", RISK_BINS, lo, hi)


def category_counts(features: DataFrame) -> DataFrame:
    return stats.category_counts(features, FLAGS)


def _cohorts(features: DataFrame):
    return [(F.col("age") < YOUNG_MONTHS).alias("under_1_yr"),
            (F.col("fam_size") < SMALL_FAMILY).alias("under_50_fam")]


def cohort_sums(features: DataFrame) -> DataFrame:
    return stats.group_sums(features, _cohorts(features), NUMERIC)


def cohort_counts(features: DataFrame) -> DataFrame:
    return features.groupBy(*_cohorts(features)).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.count(c).alias(f"cnt_{c}") for c in NUMERIC])


def column_totals(features: DataFrame) -> DataFrame:
    return stats.column_totals(features, NUMERIC)


def sorted_column(features: DataFrame, column: str = "frac_21610") -> DataFrame:
    """One feature in ascending order (NULLs last), with its account."""
    return features.select("account_id", column).orderBy(F.col(column).asc_nulls_last(), "account_id")


def mean_by_flag(features: DataFrame) -> DataFrame:
    return stats.mean_by_flag(features, FLAGS, ["frac_7726", "optout_frac"])


assert set(NUMERIC) < set(OUTPUT_COLUMNS)
