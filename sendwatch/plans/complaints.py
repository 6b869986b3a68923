"""Complaint rates: spam reports plus carrier / consumer abuse tickets over
attempted sends, per account and per month.

Ticket times are compared and bucketed on US/Pacific wall time; the rolling
ticket window is anchored on a given ``as_of`` day instead of the wall clock
so a rerun gives the same answer. The ticket-group join is kept: it adds no
column but repeats a ticket once per matching group row, exactly like the
reference count.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions import predicates as P
from sendwatch.functions.dates import monday_of, month_key, pacific, ts_lit
from sendwatch.sources import Sources

CARRIER = "Carrier Complaint"
CONSUMER = "Consumer Complaint"


def ticket_window(params: Params) -> tuple[dt.date, dt.date]:
    lo = monday_of(params.tickets_as_of) - dt.timedelta(weeks=params.ticket_weeks_back)
    return lo, lo + dt.timedelta(weeks=params.ticket_weeks_span)


def complaint_tickets(src: Sources, created_from: dt.date, created_to: dt.date | None,
                      params: Params) -> DataFrame:
    """Abuse tickets (with their Pacific creation time and issue type) that
    were created in range and updated inside the rolling window."""
    lo, hi = ticket_window(params)
    t = src.tickets.join(src.ticket_groups, src.tickets["group_id"] == src.ticket_groups["id"], "left")
    created = pacific(F.col("created_at"))
    updated = pacific(F.col("updated_at"))
    joined = P.joined_tags("tags")
    cond = (created >= ts_lit(created_from)) & (updated >= ts_lit(lo)) & (updated < ts_lit(hi))
    if created_to is not None:
        cond = cond & (created <= ts_lit(created_to))
    return (t.where(cond & P.is_complaint_ticket(joined))
            .select(src.tickets["account_id"], created.alias("created_pt"),
                    P.issue_type(joined).alias("issuetype")))


def _class_sums(df: DataFrame, key: str) -> DataFrame:
    return df.groupBy(key).agg(
        F.sum(F.when(F.col("issuetype") == CARRIER, 1)).alias("complaints_carrier"),
        F.sum(F.when(F.col("issuetype") == CONSUMER, 1)).alias("complaints_consumer"))


def _rate(df: DataFrame) -> DataFrame:
    num = (F.coalesce("n_7726", F.lit(0)) + F.coalesce("complaints_carrier", F.lit(0))
           + F.coalesce("complaints_consumer", F.lit(0)))
    return df.withColumn("complaint_rate", F.try_divide(num.cast("double"), F.col("denom").cast("double")))


def complaint_rate_account(src: Sources, period: Period | None = None,
                           params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per account with attempts in the period: spam reports since the
    period start, carrier and consumer tickets created in the period, and
    their sum over all attempts."""
    period = period or params.month
    spam = (src.complaints.where(F.col("processed_ts") >= ts_lit(period.first))
            .groupBy("account_id").agg(F.count(F.lit(1)).alias("n_7726")))
    tickets = _class_sums(complaint_tickets(src, period.first, period.last, params), "account_id")
    attempts = (src.messages.where(P.not_flagged("flags")
                                   & P.ts_closed("date_created", period.first, period.last)
                                   & P.load_day_closed("data_load_date", period.first, period.last))
                .groupBy("account_id").agg(F.count(F.lit(1)).alias("denom")))
    j = (attempts.join(tickets, "account_id", "left").join(spam, "account_id", "left"))
    return _rate(j).select("account_id", "n_7726", "complaints_carrier", "complaints_consumer",
                           "complaint_rate")


def complaint_rate_month(src: Sources, period: Period | None = None,
                         params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per calendar month since the period start: spam reports, carrier and
    consumer tickets (Pacific month) over delivered messages."""
    period = period or params.month
    spam = (src.complaints.where(F.col("processed_ts") >= ts_lit(period.first))
            .groupBy(month_key(F.col("processed_ts")).alias("month"))
            .agg(F.count(F.lit(1)).alias("n_7726")))
    t = complaint_tickets(src, period.first, None, params).withColumn("month", month_key(F.col("created_pt")))
    tickets = _class_sums(t, "month")
    delivered = (src.messages.where(P.not_flagged("flags") & P.ts_from("date_created", period.first)
                                    & P.load_day_from("data_load_date", period.first)
                                    & (F.col("error_code") == 0))
                 .groupBy(month_key(F.col("date_created")).alias("month"))
                 .agg(F.count(F.lit(1)).alias("denom")))
    j = delivered.join(tickets, "month", "left").join(spam, "month", "left")
    return _rate(j).select("month", "n_7726", "complaints_carrier", "complaints_consumer",
                           "complaint_rate")
