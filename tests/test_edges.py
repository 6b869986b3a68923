"""Edge cases the driver tables never reach, pinned with literal frames."""

import datetime as dt
from types import SimpleNamespace

from pyspark.sql import functions as F

from sendwatch.sources.fixtures import FIXTURE_PARAMS as PRM
from sendwatch.plans import assemble, complaints, rates, traits

T = dt.datetime


def _messages(spark, rows):
    return spark.createDataFrame(
        [(sid, acct, ts, ts, ts, ts.date(), status, code, flags, "US", "US", "LC")
         for sid, acct, ts, status, code, flags in rows],
        "sid long, account_id long, sent_date timestamp_ntz, date_created timestamp_ntz, "
        "date_updated timestamp_ntz, data_load_date date, status string, error_code int, flags int, "
        "from_cc string, to_cc string, from_type string")


def _src(spark, **tables):
    empty_acct = spark.createDataFrame([], "account_id long")
    base = dict(
        internal_free=empty_acct,
        complaints=spark.createDataFrame([], "id long, account_id long, processed_ts timestamp_ntz"),
        optout_log=spark.createDataFrame([], "id long, account_id long, allowed int, sender string, "
                                             "updated_ts timestamp_ntz"),
        isv_list=spark.createDataFrame([], "id long"),
        customer_link=spark.createDataFrame([], "account_id long, customer_id long"),
    )
    base.update(tables)
    return SimpleNamespace(**base)


def test_attempts_without_delivery_give_null_delivered(spark):
    m = _messages(spark, [(1, 7, T(2024, 1, 3), "FAILED", 30003, 0), (2, 7, T(2024, 1, 4), "SENT", 30007, None),
                          (3, 8, T(2024, 1, 4), "DELIVERED", 0, None)])
    src = _src(spark, messages=m, internal_free=spark.createDataFrame([(7,), (8,)], "account_id long"))
    got = {r.account_id: (r.attempted, r.delivered) for r in rates.account_rates(src).collect()}
    assert got == {7: (2, None), 8: (1, 1)}


def test_repeated_ticket_group_repeats_the_ticket(spark):
    tickets = spark.createDataFrame(
        [(1, 5, ["consumer__spam_abo"], T(2024, 1, 10, 12), T(2024, 1, 10), 3),
         (2, 5, ["carrier_complaint__sms/voice__spam_abo", None], T(2024, 1, 10, 12), T(2024, 1, 10), 4)],
        "id long, account_id long, tags array<string>, created_at timestamp_ntz, updated_at timestamp_ntz, "
        "group_id long")
    groups = spark.createDataFrame([(3,), (3,), (4,)], "id long")
    src = _src(spark, tickets=tickets, ticket_groups=groups)
    got = complaints.complaint_tickets(src, PRM.month.first, PRM.month.last, PRM)
    kinds = sorted(r.issuetype for r in got.collect())
    assert kinds == ["Carrier Complaint", "Consumer Complaint", "Consumer Complaint"]


def _accounts(spark, rows):
    return spark.createDataFrame(rows, "sid long, parent_sid long, friendly_name string, date_created timestamp_ntz")


def test_missing_family_root_and_two_names(spark):
    accts = _accounts(spark, [
        (10, None, "BUILDING a", T(2020, 1, 31)),      # root with two names
        (10, None, "plain", T(2020, 1, 31)),
        (11, 10, "x", T(2023, 12, 31)),                 # child of 10
        (21, 20, "y", T(2023, 11, 30)),                 # child whose root row is missing
    ])
    src = _src(spark, accounts=accts)
    tr = {r.sid: r for r in traits.account_traits(src).collect() if r.sid != 10}
    assert tr[11].family_id == 10 and tr[11].parent == 1 and tr[11].age == 1
    assert tr[21].family_id == 20 and tr[21].num_sub == 0 and tr[21].age == 2
    fam = {r.sid: r.fam_size for r in traits.family_size(traits.account_traits(src)).collect()}
    assert fam == {10: 2, 11: 2, 21: 1}
    _, names = assemble._side_tables(src, PRM)
    got = {r.account_id: r.default_name for r in names.collect()}
    assert got == {10: 1, 11: 0, 21: 0}          # one row per account: max over its names


def test_age_bucket_edges(spark):
    accts = _accounts(spark, [(1, None, "a", T(2023, 2, 28)), (2, None, "b", T(2023, 1, 31)),
                              (3, None, "c", T(2021, 11, 30)), (4, None, "d", T(2019, 12, 31))])
    got = {r.sid: (r.age, r.age_cat) for r in traits.account_traits(_src(spark, accounts=accts)).collect()}
    assert got == {1: (11, "0-11"), 2: (12, "11-26"), 3: (26, "11-26"), 4: (49, "> 47")}


def test_week_edges_in_weekly_table(spark):
    m = _messages(spark, [(1, 1, T(2024, 1, 7, 23, 59, 59), "SENT", 0, None),
                          (2, 1, T(2024, 1, 8, 0, 0, 0), "SENT", 0, None)])
    src = _src(spark, messages=m)
    got = sorted((r.wk, r.total) for r in rates.week_unwanted_rates(src, snapshot=m).collect())
    assert got == [("2024-01-01", 1), ("2024-01-08", 1)]
    assert rates.week_unwanted_rates(src, snapshot=m).where(F.col("optouts") != 0).count() == 0
