"""Account-, account-week- and account-period rate tables.

Scale notes. Each job reads the message table once and computes all of its
counts as conditional aggregates in that single pass (the reference scans it
once per count). The only shuffle over message rows is the group-by on the
account key, preceded by map-side partial aggregation, so a sender holding a
third of all traffic leaves one row per map task. Side tables (spam reports,
opt-outs) are aggregated to the same key before the joins; the joins then see
one row per key on each side. Account lists (internal accounts left out)
filter the aggregates, never the raw rows: a semi-join below the aggregate
would shuffle raw rows on the account key once the list is too large to
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions import predicates as P
from sendwatch.functions.dates import week_key
from sendwatch.functions.rates import pct
from sendwatch.sources import Sources

# --- fixed values: error-code classes and traits counted per account --------
UNREACHABLE_RANGE = (30003, 30006)
UNREACHABLE_EXTRA = 21614
FROM_COUNTRIES = ["US", "CA", "GB", "AU", "FR"]
TO_COUNTRIES = ["US", "CA", "GB", "AU", "IN"]
SENDER_TYPES = ["LC", "SC", "AL"]
COUNTED_STATUSES = {"delivered": "DELIVERED", "undelivered": "UNDELIVERED", "sent": "SENT"}
EXCLUDED_STATUS = "RECEIVED"
# ---------------------------------------------------------------------------


def _count_if(cond: Column, name: str) -> Column:
    return F.count_if(cond).alias(name)


def unreachable(code: Column | None = None) -> Column:
    code = F.col("error_code") if code is None else code
    lo, hi = UNREACHABLE_RANGE
    return ((code >= lo) & (code <= hi)) | (code == UNREACHABLE_EXTRA)


def _error_counts(*codes: int) -> list[Column]:
    out = [_count_if(unreachable(), "unreachable")]
    out += [_count_if(F.col("error_code") == c, f"n_{c}") for c in codes]
    return out


def _sender_type_counts() -> list[Column]:
    return [_count_if(F.col("from_type") == t, f"is_{t}") for t in SENDER_TYPES]


def month_messages(src: Sources, period: Period) -> DataFrame:
    """Messages created in the period (closed timestamp range, the last day
    counted from midnight only), loaded since the first day, excluding
    flagged traffic. The load-day lower bound prunes load-day partitions."""
    m = src.messages
    return m.where(P.ts_closed("date_created", period.first, period.last)
                   & P.load_day_from("data_load_date", period.first)
                   & P.not_flagged("flags"))


def spam_reports(src: Sources, period: Period, internal_free: bool = True) -> DataFrame:
    c = src.complaints.where(P.day_closed("processed_ts", period.first, period.last))
    c = c.groupBy("account_id").agg(F.count(F.lit(1)).alias("n_7726"))
    return c.join(src.internal_free, "account_id", "left_semi") if internal_free else c


def optouts(src: Sources, period: Period, internal_free: bool = True) -> DataFrame:
    o = src.optout_log.where((F.col("allowed") == 0) & P.phone_number_sender("sender")
                             & P.ts_closed("updated_ts", period.first, period.last))
    o = o.groupBy("account_id").agg(F.count(F.lit(1)).alias("optouts"))
    return o.join(src.internal_free, "account_id", "left_semi") if internal_free else o


def count_columns() -> dict[str, Column]:
    """Name and condition of every per-account count of a month."""
    code = F.col("error_code")
    return {"attempted": F.lit(True), "delivered": code == 0, "unreachable": unreachable(),
            **{f"n_{c}": code == c for c in (30007, 30008, 21610)},
            **{f"is_{t}": F.col("from_type") == t for t in SENDER_TYPES}}


def month_counts(src: Sources, period: Period) -> DataFrame:
    """Every per-account count of a month in one pass over the messages:
    attempted, delivered (NULL, not 0, when none), error classes, sender
    types. Jobs that select a subset get the unused aggregates pruned."""
    counts = {n: F.count_if(c) for n, c in count_columns().items()}
    counts["delivered"] = F.nullif(counts["delivered"], F.lit(0))
    return month_messages(src, period).groupBy("account_id").agg(*[c.alias(n) for n, c in counts.items()])


ERROR_COLUMNS = ["unreachable", "n_30007", "n_30008", "n_21610", "is_LC", "is_SC", "is_AL"]


def account_rates(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS,
                  with_errors: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Attempted / delivered sends, opt-outs and spam reports per sending
    account (``with_errors`` adds the error-class counts from the same pass).
    ``delivered`` stays NULL (not 0) for an account without any delivered
    message, as with the separate left-joined count."""
    period = period or params.month
    extra = ERROR_COLUMNS if with_errors else []
    sends = (counts if counts is not None else month_counts(src, period)).select(
        "account_id", "attempted", "delivered", *extra)
    return (sends.join(optouts(src, period), "account_id", "left")
            .join(spam_reports(src, period), "account_id", "left")
            .select("account_id", "attempted", "delivered", "optouts", "n_7726", *extra))


def account_error_counts(src: Sources, period: Period | None = None,
                         params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Error-class and sender-type counts per account."""
    period = period or params.month
    return month_counts(src, period).select("account_id", *ERROR_COLUMNS)


SNAPSHOT_COLUMNS = ["account_id", "sid", "status", "sent_date", "error_code", "from_type",
                    "from_cc", "to_cc"]


def message_snapshot(src: Sources, period: Period | None = None,
                     params: Params = DEFAULT_PARAMS) -> DataFrame:
    """The trimmed per-period message table: 8 columns, send day strictly
    after the period's second day and strictly before its last day."""
    period = period or params.month
    return (src.messages.where(P.day_open("sent_date", period.shift_first(1), period.last))
            .select(*SNAPSHOT_COLUMNS))


def write_snapshot(df: DataFrame, path: str) -> None:
    """Persist a snapshot partitioned by send day, so later period filters
    prune whole directories."""
    (df.withColumn("send_day", F.to_date("sent_date"))
       .write.mode("overwrite").partitionBy("send_day").parquet(path))


WEEK_TRAITS = ["from_cc", "to_cc", "from_type", "status"]
WEEK_ERRORS = ["unreachable", "n_30007", "n_30002", "n_21610"]


def week_trait_counts(snap: DataFrame) -> DataFrame:
    """One row per account, week and combination of the four traits: messages
    and error-class counts. Every weekly table sums from these, so the
    messages are read and shuffled once however many weekly tables are made."""
    return (snap.groupBy("account_id", week_key(F.col("sent_date")).alias("wk"), *WEEK_TRAITS)
            .agg(F.count(F.lit(1)).alias("ct"), *_error_counts(30007, 30002, 21610)))


def week_unwanted_rates(src: Sources, period: Period | None = None,
                        params: Params = DEFAULT_PARAMS, snapshot: DataFrame | None = None,
                        counts: DataFrame | None = None) -> DataFrame:
    """Per account and ISO week (Monday, 'yyyy-MM-dd'): volume, error-class
    counts, spam reports and opt-outs, and each as a percent of volume.
    ``counts``: the weekly counts, if they are there already."""
    period = period or params.month
    lo = period.shift_first(1)
    if counts is not None:
        weekly = counts.groupBy("account_id", "wk").agg(
            F.sum("ct").alias("total"), *[F.sum(c).alias(c) for c in WEEK_ERRORS])
    else:
        snap = snapshot if snapshot is not None else message_snapshot(src, period)
        weekly = (snap.groupBy("account_id", week_key(F.col("sent_date")).alias("wk"))
                  .agg(F.count(F.lit(1)).alias("total"), *_error_counts(30007, 30002, 21610)))
    spam = (src.complaints.where(P.day_open("processed_ts", lo, period.last))
            .groupBy("account_id", week_key(F.col("processed_ts")).alias("wk"))
            .agg(F.count(F.lit(1)).alias("n_7726")))
    outs = (src.optout_log.where((F.col("allowed") == 0) & P.phone_number_sender("sender")
                                 & P.ts_open("updated_ts", lo, period.last))
            .groupBy("account_id", week_key(F.col("updated_ts")).alias("wk"))
            .agg(F.count(F.lit(1)).alias("optouts")))
    j = (weekly.join(spam, ["account_id", "wk"], "left")
         .join(outs, ["account_id", "wk"], "left")
         .withColumn("n_7726", F.coalesce("n_7726", F.lit(0)))
         .withColumn("optouts", F.coalesce("optouts", F.lit(0))))
    counts = ["unreachable", "n_30007", "n_30002", "n_21610", "n_7726", "optouts"]
    return j.select("account_id", "wk", "total", *counts,
                    *[pct(c, "total").alias(f"{c}_pct") for c in counts])


WIDE_COUNTS = (["unreachable", "n_30007", "n_30008", "n_21610"]
               + [f"from_{c}" for c in FROM_COUNTRIES] + [f"to_{c}" for c in TO_COUNTRIES]
               + [f"is_{t}" for t in SENDER_TYPES] + list(COUNTED_STATUSES))


def account_period_rates(src: Sources, period: Period, snapshot: DataFrame | None = None) -> DataFrame:
    """Account-level wide table for one period: 22 counts over the period's
    trimmed messages (received messages and internal accounts excluded),
    spam reports and opt-outs in the period's open range, and every count as
    a percent of the account's volume."""
    snap = snapshot if snapshot is not None else message_snapshot(src, period)
    lo = period.shift_first(1)
    per_account = (snap.where(F.col("status") != EXCLUDED_STATUS)
                   .groupBy("account_id")
                   .agg(F.count(F.lit(1)).alias("total"),
                        *_error_counts(30007, 30008, 21610),
                        *[_count_if(F.col("from_cc") == c, f"from_{c}") for c in FROM_COUNTRIES],
                        *[_count_if(F.col("to_cc") == c, f"to_{c}") for c in TO_COUNTRIES],
                        *_sender_type_counts(),
                        *[_count_if(F.col("status") == s, n) for n, s in COUNTED_STATUSES.items()])
                   .join(src.internal_free, "account_id", "left_semi"))
    spam = (src.complaints.where(P.day_open("processed_ts", lo, period.last))
            .groupBy("account_id").agg(F.count(F.lit(1)).alias("n_7726")))
    outs = (src.optout_log.where((F.col("allowed") == 0) & P.phone_number_sender("sender")
                                 & P.ts_open("updated_ts", lo, period.last))
            .groupBy("account_id").agg(F.count(F.lit(1)).alias("optouts")))
    j = (per_account.join(spam, "account_id", "left").join(outs, "account_id", "left")
         .withColumn("n_7726", F.coalesce("n_7726", F.lit(0)))
         .withColumn("optouts", F.coalesce("optouts", F.lit(0))))
    rated = WIDE_COUNTS[:4] + ["n_7726", "optouts"] + WIDE_COUNTS[4:]
    return j.select("account_id", "total", *WIDE_COUNTS, "n_7726", "optouts",
                    *[pct(c, "total").alias(f"{c}_pct") for c in rated])


def account_wide(src: Sources, period: Period, traits: DataFrame) -> DataFrame:
    """Period table (without internal accounts) joined to account traits."""
    u = account_period_rates(src, period)
    return u.join(traits, u["account_id"] == traits["sid"], "inner")
