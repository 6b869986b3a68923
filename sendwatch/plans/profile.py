"""Message column profiles, top error codes and data-quality checks.

Profiles are frequency tables over the period snapshot with each value's
share of all rows; the total is a scalar subquery, so no single-partition
window touches message rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions import predicates as P
from sendwatch.functions.dates import week_key
from sendwatch.operators.shares import frequency_with_share
from sendwatch.plans.rates import message_snapshot
from sendwatch.plans.traits import weighted_crosswalk, week_wide
from sendwatch.sources import Sources

FAILED_STATUS = "FAILED"


def _snap(src: Sources, period: Period | None, params: Params, snapshot: DataFrame | None = None) -> DataFrame:
    return snapshot if snapshot is not None else message_snapshot(src, period or params.month)


def share_of(src: Sources, column: str, period: Period | None = None,
             params: Params = DEFAULT_PARAMS, snapshot: DataFrame | None = None) -> DataFrame:
    f = frequency_with_share(_snap(src, period, params, snapshot), [column], f"ct_{column}", f"perc_{column}")
    return f.orderBy(F.col(f"ct_{column}").desc(), F.col(column).asc_nulls_last())


def share_cc_pair(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS,
                  snapshot: DataFrame | None = None) -> DataFrame:
    f = frequency_with_share(_snap(src, period, params, snapshot), ["from_cc", "to_cc"], "ct_pair", "perc_pair")
    return f.orderBy(F.col("ct_pair").desc(), F.col("from_cc").asc_nulls_last(), F.col("to_cc").asc_nulls_last())


def share_error_code(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS,
                     snapshot: DataFrame | None = None) -> DataFrame:
    """Share of each non-zero error code among messages that failed."""
    snap = _snap(src, period, params, snapshot).where(F.col("error_code") != 0)
    f = frequency_with_share(snap, ["error_code"], "ct_error_code", "perc_error_code")
    return f.orderBy(F.col("ct_error_code").desc(), F.col("error_code").asc())


def top_error_codes(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS,
                    k: int = 25) -> DataFrame:
    """The k most frequent error codes among messages updated in the period
    (top-k report; ties by code)."""
    period = period or params.month
    m = src.messages.where(P.ts_closed("date_updated", period.first, period.last))
    return (m.groupBy("error_code").agg(F.count(F.lit(1)).alias("ct"))
            .orderBy(F.col("ct").desc(), F.col("error_code").asc()).limit(k))


def top_failed_codes(src: Sources, k: int = 20) -> DataFrame:
    """The k most frequent error codes of failed messages, whole table."""
    m = src.messages.where(F.col("status") == FAILED_STATUS)
    return (m.groupBy("error_code").agg(F.count(F.lit(1)).alias("ct"))
            .orderBy(F.col("ct").desc(), F.col("error_code").asc()).limit(k))


# --- data-quality checks ----------------------------------------------------

def dq_duplicates(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """(customer, account) pairs listed more than once in the ISV crosswalk."""
    return (weighted_crosswalk(src, params).groupBy("customer_id", "account_id")
            .agg(F.sum("weight").alias("n")).where(F.col("n") > 1))


def dq_null_keys(src: Sources) -> DataFrame:
    return src.accounts.where(F.col("sid").isNull()).select("parent_sid", "sid")


def dq_key_containment(src: Sources) -> DataFrame:
    """Distinct linked customers that appear on the ISV list."""
    listed = src.isv_list.select(F.col("id").alias("customer_id")).distinct()
    return (src.customer_link.join(listed, "customer_id", "left_semi")
            .agg(F.countDistinct("customer_id").alias("n_customers")))


def dq_weeks_per_account(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Weeks per account in the dominant-sender-type table (at most 5)."""
    weeks = (_snap(src, period, params).where(F.col("from_type").isNotNull())
             .select("account_id", week_key(F.col("sent_date")).alias("wk")).distinct())
    return weeks.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_weeks"))


def dq_week_duplicates(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Account-weeks appearing more than once in the weekly wide table."""
    return (week_wide(src, params).groupBy("account_id", "wk").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))
