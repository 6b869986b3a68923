"""Literal-frame tests for predicates, calendar helpers and rates: NULL,
boundary and tie rules of the reference queries."""

import datetime as dt

from pyspark.sql import functions as F

from sendwatch.functions import predicates as P
from sendwatch.functions.dates import complete_months, pacific, ts_lit, week_key
from sendwatch.functions.rates import frac, pct


def _vals(df, col="r"):
    return [row[col] for row in df.collect()]


def test_not_flagged_keeps_null_and_drops_bit0(spark):
    df = spark.createDataFrame([(None,), (0,), (1,), (2,), (3,), (8,)], "flags int")
    assert _vals(df.select(P.not_flagged("flags").alias("r"))) == [True, True, False, True, False, True]


def test_phone_number_sender_null_counts_as_phone(spark):
    df = spark.createDataFrame([(None,), ("MG123",), ("+1555",), ("mg1",)], "sender string")
    assert _vals(df.select(P.phone_number_sender("sender").alias("r"))) == [True, False, True, True]


def test_range_boundaries(spark):
    rows = [(dt.datetime(2024, 1, 1, 0, 0, 0),), (dt.datetime(2024, 1, 2, 0, 0, 0),),
            (dt.datetime(2024, 1, 2, 23, 59, 59),), (dt.datetime(2024, 1, 3, 0, 0, 0),),
            (dt.datetime(2024, 1, 30, 0, 0, 0),), (dt.datetime(2024, 1, 30, 0, 0, 1),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    d1, d2, d30 = dt.date(2024, 1, 1), dt.date(2024, 1, 2), dt.date(2024, 1, 30)
    # closed timestamp range: last day counts only at 00:00:00
    assert _vals(df.select(P.ts_closed("t", d1, d30).alias("r"))) == [True] * 5 + [False]
    # open date range: both end days dropped entirely
    assert _vals(df.select(P.day_open("t", d2, d30).alias("r"))) == [False, False, False, True, False, False]
    # closed date range: whole last day kept
    assert _vals(df.select(P.day_closed("t", d2, d30).alias("r"))) == [False, True, True, True, True, True]
    # open timestamp range
    assert _vals(df.select(P.ts_open("t", d2, d30).alias("r"))) == [False, False, True, True, False, False]


def test_week_key_is_iso_monday(spark):
    rows = [(dt.datetime(2024, 1, 7, 23, 59, 59),), (dt.datetime(2024, 1, 8, 0, 0, 0),),
            (dt.datetime(2024, 1, 1, 0, 0, 0),)]
    df = spark.createDataFrame(rows, "t timestamp_ntz")
    assert _vals(df.select(week_key(F.col("t")).alias("r"))) == ["2024-01-01", "2024-01-08", "2024-01-01"]


def test_week_key_independent_of_session_zone(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 8, 1, 0, 0),)], "t timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        assert _vals(df.select(week_key(F.col("t")).alias("r"))) == ["2024-01-08"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_pacific_wall_time(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 7, 0, 0),), (dt.datetime(2024, 7, 1, 7, 0, 0),)],
                               "t timestamp_ntz")
    out = _vals(df.select(pacific(F.col("t")).alias("r")))
    assert out == [dt.datetime(2023, 12, 31, 23, 0, 0), dt.datetime(2024, 7, 1, 0, 0, 0)]


def test_complete_months_month_end(spark):
    rows = [(dt.date(2023, 11, 30),), (dt.date(2023, 11, 15),), (dt.date(2023, 12, 31),), (dt.date(2024, 1, 31),)]
    df = spark.createDataFrame(rows, "d date")
    got = _vals(df.select(complete_months(F.col("d"), F.lit("2024-01-31").cast("date")).alias("r")))
    assert got == [2, 2, 1, 0]


def test_suspension_categories(spark):
    rows = [("category: AUP",), ("category: FRAUD",), ("manual review",), ("Account suspended",),
            ("parent_suspended",), (None,), ("category: CUSTOMER REQUEST",)]
    df = spark.createDataFrame(rows, "details string")
    aup = _vals(df.select(P.aup_suspension("details").alias("r")))
    fraud = _vals(df.select(P.fraud_suspension("details").alias("r")))
    # untagged detail counts for both categories; NULL for neither
    assert aup == [True, False, True, False, False, None, False]
    assert fraud == [False, True, True, False, False, None, False]


def test_complaint_tags_and_issue_type(spark):
    rows = [(["vip", "carrier_complaint__sms/voice__spam_abo"],), (["consumer__spam_abo"],),
            (["carrier_complaint__political_abo", "consumer__other_abo"],), (["billing"],),
            ([None, "consumer__harassment_abo"],), (["carrier_complaint__sms/voice__fraud_abo"],)]
    df = spark.createDataFrame(rows, "tags array<string>")
    j = P.joined_tags("tags")
    got = df.select(P.is_complaint_ticket(j).alias("hit"), P.issue_type(j).alias("kind")).collect()
    assert [r.hit for r in got] == [True, True, True, False, True, False]
    assert [r.kind for r in got][:3] == ["Carrier Complaint", "Consumer Complaint", "Carrier Complaint"]
    # array_join skips the NULL element
    assert got[4].kind == "Consumer Complaint"


def test_rates_zero_denominator_is_null(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "n long, d long")
    assert _vals(df.select(frac("n", "d").alias("r"))) == [None, 0.25]
    assert _vals(df.select(pct("n", "d").alias("r"))) == [None, 25.0]


def test_ts_lit_is_ntz(spark):
    assert spark.range(1).select(ts_lit(dt.date(2024, 1, 1)).alias("t")).schema["t"].dataType.typeName() \
        == "timestamp_ntz"
