"""Messages sent in the week before an AUP / FRAUD suspension.

Plan: (1) latest suspension per account as a struct-max aggregate, filtered
to the category and the suspension period; (2) delivered, unflagged messages
aggregated to account-day *before* any join (partial aggregation absorbs hot
senders); (3) equi-join on account with the day-range residual; (4) sum.

The message read is bounded by the range the join can match,
``[max(lookback, first - 7d), last]``: a day outside it can never fall into
``[suspension_day - 7, suspension_day]`` for a suspension inside the period,
so the bound is implied by the join and prunes load-day partitions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions import predicates as P
from sendwatch.functions.dates import date_lit, ts_lit
from sendwatch.operators.interval_join import within_days_before
from sendwatch.operators.top1 import latest_per_group
from sendwatch.plans import rates
from sendwatch.session import materialize
from sendwatch.sources import Sources

SUSPENDED_EVENT = "Account suspended"


def latest_suspensions(src: Sources) -> DataFrame:
    ev = src.audit_events.where(F.col("event_name") == SUSPENDED_EVENT)
    return latest_per_group(ev, ["account_id"], ["date_created", "event_id"], ["details"])


def suspensions_in(src: Sources, period: Period, category: str) -> DataFrame:
    """Accounts whose latest suspension falls in ``period`` with a detail of
    ``category`` ('aup' or 'fraud'); one row per account with its day."""
    pred = P.aup_suspension("details") if category == "aup" else P.fraud_suspension("details")
    last = latest_suspensions(src)
    s = (last.where(P.ts_closed("date_created", period.first, period.last) & pred)
         .select("account_id", F.to_date("date_created").alias("suspension_day")))
    return s.where((F.col("suspension_day") >= date_lit(period.first))
                   & (F.col("suspension_day") <= date_lit(period.last)))


# a list of suspended accounts up to this length is sent to the scan (8 MB of ids)
BROADCAST_ACCOUNTS = 1_000_000


def only_accounts(messages: DataFrame, accounts: DataFrame, most: int = BROADCAST_ACCOUNTS) -> DataFrame:
    """``messages`` of ``accounts`` if these are few enough to broadcast, else
    all of them (the join after the aggregate then selects): raw messages are
    never shuffled for the list. Pass ``accounts`` materialised."""
    listed = accounts.select("account_id").distinct()
    if listed.limit(most + 1).count() > most:
        return messages
    return messages.join(F.broadcast(listed), "account_id", "left_semi")


def suspension_day_counts(src: Sources, period: Period, params: Params = DEFAULT_PARAMS,
                          accounts: DataFrame | None = None) -> DataFrame:
    """Delivered, unflagged messages per account and creation day, with one
    count per category lookback. ``accounts``: those whose days are wanted."""
    window = params.suspension_window_days
    lookbacks = {"aup": period.first - dt.timedelta(days=params.aup_lookback_days),
                 "fraud": period.first - dt.timedelta(days=params.fraud_lookback_days)}
    read_from = max(min(lookbacks.values()), period.first - dt.timedelta(days=window))
    read_to = period.last + dt.timedelta(days=1)
    m = src.messages.where(
        P.not_flagged("flags") & (F.col("error_code") == 0)
        & (F.col("date_created") >= ts_lit(read_from)) & (F.col("date_created") < ts_lit(read_to))
        & P.load_day_from("data_load_date", min(lookbacks.values())))
    counts = [F.count_if(P.ts_from("date_created", lb) & P.load_day_from("data_load_date", lb)).alias(f"ct_{c}")
              for c, lb in lookbacks.items()]
    if accounts is not None:
        m = only_accounts(m, accounts)
    return m.groupBy("account_id", F.to_date("date_created").alias("d")).agg(*counts)


def messages_before_suspension(src: Sources, period: Period, category: str,
                               params: Params = DEFAULT_PARAMS,
                               per_day: DataFrame | None = None) -> DataFrame:
    s = suspensions_in(src, period, category)
    if per_day is None:
        s = materialize(s)
        per_day = suspension_day_counts(src, period, params, accounts=s)
    j = within_days_before(per_day.select("account_id", "d", F.col(f"ct_{category}").alias("ct")),
                           s, "account_id", "d", "suspension_day", params.suspension_window_days)
    return j.groupBy("account_id").agg(F.sum("ct").alias(category))


def _suspensions_of_both(src: Sources, period: Period) -> DataFrame:
    """Accounts whose latest suspension falls in ``period``, with its day and categories."""
    last = latest_suspensions(src).where(P.ts_closed("date_created", period.first, period.last))
    day = F.to_date("date_created")
    return (last.where((day >= date_lit(period.first)) & (day <= date_lit(period.last)))
            .select("account_id", day.alias("suspension_day"), P.aup_suspension("details").alias("is_aup"),
                    P.fraud_suspension("details").alias("is_fraud")).where("is_aup OR is_fraud"))


def rates_and_suspensions(src: Sources, period: Period, suspensions: Period,
                          params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per account the counts of ``rates.month_counts`` over ``period``, and
    its messages before an AUP / FRAUD suspension in ``suspensions`` (NULL
    without one), all from one pass over the messages: they are counted per
    account and day, the account's suspension is joined to those rows, and
    the days are summed."""
    window = params.suspension_window_days
    lookbacks = {"aup": suspensions.first - dt.timedelta(days=params.aup_lookback_days),
                 "fraud": suspensions.first - dt.timedelta(days=params.fraud_lookback_days)}
    read_from = max(min(lookbacks.values()), suspensions.first - dt.timedelta(days=window))
    read_to = suspensions.last + dt.timedelta(days=1)
    in_month = P.ts_closed("date_created", period.first, period.last) & P.load_day_from("data_load_date", period.first)
    in_window = ((F.col("error_code") == 0) & (F.col("date_created") >= ts_lit(read_from))
                 & (F.col("date_created") < ts_lit(read_to))
                 & P.load_day_from("data_load_date", min(lookbacks.values())))
    # bounds that reach the scan; the two parts' own conditions follow
    m = src.messages.where(
        P.not_flagged("flags") & (F.col("date_created") >= ts_lit(min(read_from, period.first)))
        & (F.col("date_created") < ts_lit(max(read_to, period.last + dt.timedelta(days=1))))
        & (in_month | in_window))
    month_counts = rates.count_columns()
    daily = m.groupBy("account_id", F.to_date("date_created").alias("d")).agg(
        *[F.count_if(in_month & c).alias(n) for n, c in month_counts.items()],
        F.count_if(in_window).alias("n_window"),
        *[F.count_if(in_window & P.ts_from("date_created", lb) & P.load_day_from("data_load_date", lb)).alias(f"ct_{c}")
          for c, lb in lookbacks.items()])
    near = ((F.col("n_window") > 0) & (F.col("d") >= F.date_sub("suspension_day", window))
            & (F.col("d") <= F.col("suspension_day")))
    per_account = (daily.join(_suspensions_of_both(src, suspensions), "account_id", "left")
                   .groupBy("account_id").agg(
                       *[F.sum(n).alias(n) for n in month_counts],
                       *[F.sum(F.when(near & F.col(f"is_{c}"), F.col(f"ct_{c}"))).alias(c) for c in lookbacks]))
    return per_account.where(F.col("attempted") > 0).withColumn("delivered", F.nullif("delivered", F.lit(0)))


def listed_accounts(src: Sources) -> DataFrame:
    return src.cannabis_list.select(F.col("sid").alias("account_id")).distinct().withColumn("_hit", F.lit(1))


def aup_messages(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS) -> DataFrame:
    period = period or params.suspensions_month
    return messages_before_suspension(src, period, "aup", params)


def fraud_messages(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Messages before a FRAUD suspension, with the cannabis-list marker."""
    period = period or params.suspensions_month
    f = messages_before_suspension(src, period, "fraud", params)
    return (f.join(listed_accounts(src), "account_id", "left")
            .select("account_id", F.when(F.col("_hit").isNotNull(), 1).otherwise(0).alias("cannabis"),
                    "fraud"))
