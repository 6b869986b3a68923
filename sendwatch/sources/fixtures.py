"""Typed source views derived from the driver tables.

The reference reads message logs, spam reports, opt-out logs, audit events,
account records and support tickets. The driver provides TPC-H-style tables;
the mapping from one onto the other is fixed by FIXTURES.md (part B) and is
written here with the DataFrame API so every job downstream reads ordinary
columns with pushdown-friendly types (``TIMESTAMP_NTZ`` event times, ``DATE``
load day, ``BIGINT`` ids).

Every view is lazy: nothing is read until a job runs, and only the columns the
job needs are decoded.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sendwatch.config import Params
from sendwatch.functions.dates import ts_lit
from sendwatch.sources.tables import read_table


def _case(expr: Column, mapping: dict, default=None) -> Column:
    out = None
    for key, value in mapping.items():
        out = (F.when(expr == key, F.lit(value)) if out is None
               else out.when(expr == key, F.lit(value)))
    return out.otherwise(F.lit(default)) if default is not None else out


def _days(n: Column) -> Column:
    return F.make_dt_interval(days=n.cast("int"))


def _hours(n: Column) -> Column:
    return F.make_dt_interval(hours=n.cast("int"))


def _seconds(n: Column) -> Column:
    return F.make_dt_interval(secs=n.cast("decimal(18,6)"))


def _fdiv(c: Column, d: int) -> Column:
    return F.floor(c / F.lit(d)).cast("bigint")


# --- fixed values of the fixture mapping (FIXTURES.md part B) ---------------
STATUS_BY_EVENT_TYPE = {"purchase": "DELIVERED", "view": "SENT", "error": "UNDELIVERED",
                        "signup": "FAILED"}
STATUS_DEFAULT = "RECEIVED"
ERROR_CODE_BY_K = {0: 30003, 1: 30005, 2: 21614, 3: 30007, 4: 30008, 5: 21610, 6: 30002}
FROM_CC = {0: "US", 1: "CA", 2: "GB", 3: "AU", 4: "FR", 5: "DE"}
TO_CC = {0: "US", 1: "CA", 2: "GB", 3: "AU", 4: "IN"}
FROM_TYPE = {0: "LC", 1: "SC", 2: "AL"}
AUDIT_DETAILS = {0: "category: AUP", 1: "category: FRAUD", 2: "category: CUSTOMER REQUEST",
                 3: "Account suspended", 4: "parent_suspended", 5: "manual review",
                 6: "Account suspended VIA suspension trigger"}
PARENT_OFFSET_BY_MOD12 = {2: 1, 4: 1, 5: 2, 7: 1, 8: 2, 9: 3, 10: 4, 11: 5}
TICKET_TAGS = {0: "vip,carrier_complaint__sms/voice__spam_abo",
               1: "consumer__spam_abo",
               2: "carrier_complaint__political_abo,consumer__other_abo",
               3: "billing",
               4: "consumer__harassment_abo,x"}
TICKET_TAGS_DEFAULT = "carrier_complaint__sms/voice__fraud_abo"
DEFAULT_NAME_MARKER = "BUILDING"
# the mapped accounts are small: their volume gate, and their marker of a default name
FIXTURE_PARAMS = Params(min_attempted=15, default_name_marker=DEFAULT_NAME_MARKER)
# ---------------------------------------------------------------------------


@dataclass
class Sources:
    spark: SparkSession
    sf_dir: str

    def _t(self, name: str) -> DataFrame:
        return read_table(self.spark, self.sf_dir, name)

    @cached_property
    def messages(self) -> DataFrame:
        """One row per message: sid, account_id, times, status, error_code,
        flags (bit 0 = excluded traffic), from/to country, sender type."""
        e = self._t("events")
        k = F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int")
        ts = F.col("ts")
        eid = F.col("event_id")
        return e.select(
            eid.alias("sid"),
            F.col("user_id").alias("account_id"),
            ts.alias("sent_date"),
            ts.alias("date_created"),
            ts.alias("date_updated"),
            F.to_date(ts).alias("data_load_date"),
            _case(F.col("event_type"), STATUS_BY_EVENT_TYPE, STATUS_DEFAULT).alias("status"),
            _case(k % 10, ERROR_CODE_BY_K, 0).alias("error_code"),
            F.when(k >= 90, F.lit(None)).otherwise(_fdiv(k, 10).cast("int")).alias("flags"),
            _case(eid % 7, FROM_CC).alias("from_cc"),
            _case(_fdiv(eid, 7) % 6, TO_CC).alias("to_cc"),
            _case((F.col("user_id") + eid) % 4, FROM_TYPE).alias("from_type"),
        )

    @cached_property
    def bodies(self) -> DataFrame:
        """Message bodies keyed by message sid (at most one per passage id)."""
        e = self._t("events")
        b = self._t("benchmark")
        key = F.when(F.col("event_id") % 3 == 0, F.col("user_id") % 40).otherwise(F.col("event_id") % 45)
        return (e.select(F.col("event_id").alias("sid"), key.alias("item_id"))
                .join(b.select("item_id", F.col("text").alias("body")), "item_id")
                .select("sid", "body"))

    def _orders(self, status: str) -> DataFrame:
        return self._t("orders").where(F.col("o_orderstatus") == status)

    @staticmethod
    def _order_time(start: str) -> Column:
        ok = F.col("o_orderkey")
        return ts_lit(start) + _days(ok % 34) + _hours(ok % 24)

    @cached_property
    def complaints(self) -> DataFrame:
        """Carrier spam reports (the 7726 short code): id, account_id, processed_ts."""
        return self._orders("F").select(
            F.col("o_orderkey").alias("id"),
            _fdiv(F.col("o_custkey"), 10).alias("account_id"),
            self._order_time("2023-12-30 00:00:00").alias("processed_ts"))

    @cached_property
    def optout_log(self) -> DataFrame:
        """Opt-out log: allowed = 0 marks an opt-out; sender 'MG...' is a
        messaging service, anything else a phone number."""
        ok = F.col("o_orderkey")
        return self._orders("O").select(
            ok.alias("id"),
            _fdiv(F.col("o_custkey"), 10).alias("account_id"),
            (ok % 2).cast("int").alias("allowed"),
            F.concat(F.when(ok % 5 == 0, F.lit("MG")).otherwise(F.lit("+1")),
                     ok.cast("string")).alias("sender"),
            self._order_time("2023-12-30 00:00:00").alias("updated_ts"))

    @cached_property
    def audit_events(self) -> DataFrame:
        ok = F.col("o_orderkey")
        grp = _fdiv(ok, 6)
        return self._orders("P").select(
            ok.alias("event_id"),
            _fdiv(F.col("o_custkey"), 10).alias("account_id"),
            F.when(ok % 6 == 0, F.lit("Account suspended"))
             .otherwise(F.lit("Account reactivated")).alias("event_name"),
            _case(grp % 8, AUDIT_DETAILS).alias("details"),
            (ts_lit("2024-01-01 00:00:00") + _days(grp % 31) + _seconds(ok % 86400)).alias("date_created"))

    @cached_property
    def accounts(self) -> DataFrame:
        ck = F.col("c_custkey")
        off = _case(ck % 12, PARENT_OFFSET_BY_MOD12)
        return self._t("customer").select(
            ck.alias("sid"),
            (ck - off).alias("parent_sid"),
            F.concat(F.col("c_mktsegment"), F.lit(" "), F.col("c_name")).alias("friendly_name"),
            (ts_lit("2019-01-01 00:00:00") + _days((ck * 37) % 1800)).alias("date_created"))

    @cached_property
    def account_flags(self) -> DataFrame:
        ck = F.col("c_custkey")
        return self._t("customer").select(ck.alias("account_id"), (ck % 17 == 0).alias("is_internal"))

    @cached_property
    def customer_link(self) -> DataFrame:
        ck = F.col("c_custkey")
        return self._t("customer").select(
            F.when(ck % 50 == 49, F.lit(None).cast("bigint")).otherwise(ck).alias("account_id"),
            (ck % 300).alias("customer_id"))

    @cached_property
    def crm_accounts(self) -> DataFrame:
        """The CRM's accounts; every twelfth customer is there twice."""
        ck = F.col("c_custkey")
        times = F.when(ck % 12 == 5, 2).otherwise(1)
        return (self._t("customer").where(ck < 300)
                .select(ck.alias("customer_id"), F.explode(F.sequence(F.lit(1), times)).alias("_")).drop("_"))

    @cached_property
    def isv_list(self) -> DataFrame:
        return self._t("supplier").select(F.col("s_suppkey").alias("id"))

    @cached_property
    def cannabis_list(self) -> DataFrame:
        return (self._t("customer").where(F.col("c_mktsegment") == "FURNITURE")
                .select(F.col("c_custkey").alias("sid")))

    @cached_property
    def risky_list(self) -> DataFrame:
        c = self._t("customer")
        return (c.where((F.col("c_acctbal") < 0) | (F.col("c_custkey") % 3 == 0))
                .select(F.col("c_custkey").alias("sid")))

    @cached_property
    def tickets(self) -> DataFrame:
        d = F.col("doc_id")
        return self._t("documents").select(
            d.alias("id"),
            ((d * 7) % 150).alias("account_id"),
            F.split(_case(d % 6, TICKET_TAGS, TICKET_TAGS_DEFAULT), ",").alias("tags"),
            (ts_lit("2023-12-31 00:00:00") + _days(d % 33) + _hours(d % 24)).alias("created_at"),
            (ts_lit("2022-01-01 00:00:00") + _days((d * 13) % 900)).alias("updated_at"),
            (d % 30).alias("group_id"))

    @cached_property
    def ticket_groups(self) -> DataFrame:
        return self._t("nation").select(F.col("n_nationkey").cast("bigint").alias("id"))

    @cached_property
    def internal_free(self) -> DataFrame:
        """Account ids flagged as not internal (the IN-subquery list)."""
        return self.account_flags.where(~F.col("is_internal")).select("account_id")


def load(spark: SparkSession, sf_dir: str) -> Sources:
    return Sources(spark, sf_dir)
