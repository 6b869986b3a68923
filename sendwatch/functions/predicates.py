"""Row predicates of the reference queries, as Column expressions.

Range helpers are written on the raw timestamp column (never ``to_date(col)``)
so the comparison reaches the Parquet scan as a pushed filter and row groups
are skipped by min/max statistics; the date-based boundary styles are
rewritten into the equivalent timestamp bounds.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from sendwatch.functions.dates import date_lit, ts_lit

ONE_DAY = dt.timedelta(days=1)


def not_flagged(flags: Column | str = "flags") -> Column:
    """Bit 0 of ``flags`` marks traffic to exclude; NULL flags are kept."""
    flags = F.col(flags) if isinstance(flags, str) else flags
    return ~F.coalesce(flags.bitwiseAND(F.lit(1)) == 1, F.lit(False))


def phone_number_sender(sender: Column | str = "sender") -> Column:
    """Sender is a phone number, i.e. not a messaging service ('MG...').
    A NULL sender falls to the phone-number branch, as in the CASE form."""
    sender = F.col(sender) if isinstance(sender, str) else sender
    return ~F.coalesce(sender.startswith("MG"), F.lit(False))


def ts_closed(col: str, first: dt.date, last: dt.date) -> Column:
    """``col >= first 00:00 AND col <= last 00:00`` (last day all but lost)."""
    return (F.col(col) >= ts_lit(first)) & (F.col(col) <= ts_lit(last))


def ts_open(col: str, lo: dt.date, hi: dt.date) -> Column:
    """``col > lo 00:00 AND col < hi 00:00``."""
    return (F.col(col) > ts_lit(lo)) & (F.col(col) < ts_lit(hi))


def day_open(col: str, lo: dt.date, hi: dt.date) -> Column:
    """``date(col) > lo AND date(col) < hi`` as timestamp bounds."""
    return (F.col(col) >= ts_lit(lo + ONE_DAY)) & (F.col(col) < ts_lit(hi))


def day_closed(col: str, first: dt.date, last: dt.date) -> Column:
    """``date(col) >= first AND date(col) <= last`` as timestamp bounds."""
    return (F.col(col) >= ts_lit(first)) & (F.col(col) < ts_lit(last + ONE_DAY))


def ts_from(col: str, first: dt.date) -> Column:
    return F.col(col) >= ts_lit(first)


def ts_half_open(col: str, first: dt.date, end: dt.date) -> Column:
    return (F.col(col) >= ts_lit(first)) & (F.col(col) < ts_lit(end))


def load_day_from(col: str, first: dt.date) -> Column:
    return F.col(col) >= date_lit(first)


def load_day_closed(col: str, first: dt.date, last: dt.date) -> Column:
    return (F.col(col) >= date_lit(first)) & (F.col(col) <= date_lit(last))


# --- fixed values: suspension detail categories -----------------------------
AUP_MARK = "category: AUP"
FRAUD_MARK = "category: FRAUD"
OTHER_SUSPENSION_MARKS = ["parent_suspended", "suspended_by_parent",
                          "Account suspended VIA suspension trigger",
                          "category: CUSTOMER REQUEST"]
BARE_SUSPENSION_DETAIL = "Account suspended"
# ---------------------------------------------------------------------------


def _suspension_category(details: Column, mark: str, other_mark: str) -> Column:
    """Detail text is tagged with ``mark``, or carries no known tag at all.

    An untagged detail matches both categories; NULL details match neither
    (the second disjunct is NULL, the first FALSE)."""
    tagged = details.contains(mark)
    untagged = details != F.lit(BARE_SUSPENSION_DETAIL)
    for m in [other_mark, *OTHER_SUSPENSION_MARKS]:
        untagged = untagged & ~details.contains(m)
    return (details.isNotNull() & tagged) | untagged


def aup_suspension(details: Column | str = "details") -> Column:
    details = F.col(details) if isinstance(details, str) else details
    return _suspension_category(details, AUP_MARK, FRAUD_MARK)


def fraud_suspension(details: Column | str = "details") -> Column:
    details = F.col(details) if isinstance(details, str) else details
    return _suspension_category(details, FRAUD_MARK, AUP_MARK)


# --- fixed values: support-ticket complaint tags ----------------------------
COMPLAINT_TAGS = [
    "carrier_complaint__sms/voice__cannabis_abo",
    "carrier_complaint__sms/voice__harassment_abo",
    "carrier_complaint__sms/voice__other_abo",
    "carrier_complaint__political_abo",
    "carrier_complaint__sms/voice__spam_abo",
    "consumer__cannabis_abo",
    "consumer__harassment_abo",
    "consumer__other_abo",
    "consumer__political_abo",
    "consumer__spam_abo",
]
CARRIER_MARK = "carrier_complaint"
CONSUMER_MARK = "consumer__"
# ---------------------------------------------------------------------------


def joined_tags(tags: Column | str = "tags") -> Column:
    tags = F.col(tags) if isinstance(tags, str) else tags
    return F.array_join(tags, ",")


def is_complaint_ticket(joined: Column) -> Column:
    """Any of the abuse tags appears in the comma-joined tag list."""
    cond = None
    for tag in COMPLAINT_TAGS:
        c = joined.contains(tag)
        cond = c if cond is None else cond | c
    return cond


def issue_type(joined: Column) -> Column:
    """First match wins: a carrier tag makes a carrier complaint even when a
    consumer tag is also present."""
    return (F.when(joined.contains(CARRIER_MARK), F.lit("Carrier Complaint"))
            .when(joined.contains(CONSUMER_MARK), F.lit("Consumer Complaint")))
