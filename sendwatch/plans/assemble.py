"""Account feature tables for the training period and the scored period.

Merges the per-account counts (rates, error classes, pre-suspension traffic),
family size, age / parent / ISV and the default-name marker; fills missing
counts with 0, applies the volume gate, derives the rate features and drops
accounts whose pre-suspension share exceeds 1. All inputs are one row per
account, so every join here is account-keyed and skew free.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions.rates import frac
from sendwatch.plans import rates, suspension, traits
from sendwatch.sources import Sources

FEATURES = ["age", "isv", "parent", "unreachable_frac", "frac_30007", "frac_21610", "frac_30008",
            "aup_frac", "fraud_frac", "cannabis", "fam_size", "default_name"]
TARGETS = {"optout": "optout_frac", "spam": "frac_7726"}

COUNT_COLUMNS = ["attempted", "delivered", "optouts", "n_7726", "unreachable", "n_30007", "n_30008",
                 "n_21610", "is_LC", "is_SC", "is_AL", "aup", "cannabis", "fraud", "fam_size", "age",
                 "parent", "isv", "default_name"]
RATE_COLUMNS = ["optout_frac", "frac_7726", "frac_30008", "frac_30007", "frac_21610",
                "unreachable_frac", "aup_frac", "fraud_frac"]
OUTPUT_COLUMNS = ["account_id", *COUNT_COLUMNS, *RATE_COLUMNS]


def _rates(df: DataFrame) -> DataFrame:
    return df.select(
        "*",
        frac("optouts", "delivered").alias("optout_frac"),
        frac("n_7726", "delivered").alias("frac_7726"),
        frac("n_30008", "attempted").alias("frac_30008"),
        frac("n_30007", "attempted").alias("frac_30007"),
        frac("n_21610", "attempted").alias("frac_21610"),
        frac("unreachable", "attempted").alias("unreachable_frac"),
        frac("aup", "attempted").alias("aup_frac"),
        frac("fraud", "attempted").alias("fraud_frac"))


def _side_tables(src: Sources, params: Params):
    tr = traits.account_traits(src, params)
    # family size and age in one table: the traits are computed once
    own = tr.select(F.col("sid").alias("account_id"), (F.coalesce("num_sub", F.lit(0)) + 1).alias("fam_size"),
                    "age", "parent", "isv").distinct()
    # one row per account even if an account carried two names
    names = (traits.default_name_flags(src, params).groupBy(F.col("sid").alias("account_id"))
             .agg(F.max("default_name").alias("default_name")))
    return own, names


def _traffic(src: Sources, period: Period, suspensions: Period, params: Params) -> DataFrame:
    """Rates, error classes and pre-suspension traffic: one pass over the messages."""
    counts = suspension.rates_and_suspensions(src, period, suspensions, params)
    extra = [*rates.ERROR_COLUMNS, "aup", "fraud"]
    base = counts.select("account_id", "attempted", "delivered", *extra)
    return (base.join(rates.optouts(src, period), "account_id", "left")
            .join(rates.spam_reports(src, period), "account_id", "left")
            .join(suspension.listed_accounts(src), "account_id", "left")
            .select("account_id", "attempted", "delivered", "optouts", "n_7726", *rates.ERROR_COLUMNS, "aup",
                    F.when(F.col("fraud").isNotNull(), F.when(F.col("_hit").isNotNull(), 1).otherwise(0))
                    .alias("cannabis"), "fraud"))


def _gate(df: DataFrame, params: Params) -> DataFrame:
    return df.where((F.col("attempted") > params.min_attempted) & (F.col("delivered") > params.min_delivered))


def _fill(df: DataFrame) -> DataFrame:
    return df.na.fill(0, subset=[c for c in COUNT_COLUMNS if c in df.columns])


def merged_period1(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Period-1 merge before filling (what the profile's non-null counts see)."""
    own, names = _side_tables(src, params)
    return (_traffic(src, params.period1, params.suspensions_p1, params)
            .join(own, "account_id", "inner")
            .join(names, "account_id", "left"))


def features_p1(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    df = _rates(_gate(_fill(merged_period1(src, params)), params))
    return df.where((F.col("aup_frac") <= 1) & (F.col("fraud_frac") <= 1)).select(*OUTPUT_COLUMNS)


def features_p2(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Scored period: gate before the rates (no division by zero), then the
    age / family joins are inner."""
    own, names = _side_tables(src, params)
    june = (_traffic(src, params.period2, params.suspensions_p2, params)
            .join(names, "account_id", "left"))
    june = _rates(_gate(_fill(june), params))
    june = june.where((F.col("aup_frac") <= 1) & (F.col("fraud_frac") <= 1))
    return june.join(own, "account_id", "inner").select(*OUTPUT_COLUMNS)


def split_flag(params: Params = DEFAULT_PARAMS):
    """True for the training split: a hash of the account id (its MD5 prefix),
    stable, independent of partitions and of how ids are given out."""
    prefix = F.substring(F.md5(F.col("account_id").cast("string")), 1, 4)
    return F.conv(prefix, 16, 10).cast("int") % params.split_buckets < params.train_buckets
