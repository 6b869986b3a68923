"""A sender holding a third of all messages: results stay exact and the
message-level plans reduce the hot key map-side before any shuffle."""

import re

import pytest
from pyspark.sql import functions as F

from sendwatch.operators.top1 import mode_per_group
from sendwatch.plans import assemble, rates, suspension, traits
from sendwatch.sources import load
from sendwatch.sources.fixtures import FIXTURE_PARAMS
from tests.conftest import SF_SMALL

HOT = 42


class SkewedSources:
    """Driver sources with every third message re-assigned to one account."""

    def __init__(self, spark):
        self._src = load(spark, SF_SMALL)

    def __getattr__(self, name):
        return getattr(self._src, name)

    @property
    def messages(self):
        m = self._src.messages
        return m.withColumn("account_id", F.when(F.col("sid") % 3 == 0, F.lit(HOT)).otherwise(F.col("account_id")))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_sender_counts_are_exact(spark):
    src = SkewedSources(spark)
    got = {r.account_id: r.attempted for r in rates.account_rates(src).collect()}
    m = rates.month_messages(src, rates.DEFAULT_PARAMS.month)
    want = {r.account_id: r["count"] for r in m.groupBy("account_id").count().collect()}
    assert got == want
    assert got[HOT] >= sum(want.values()) // 3


def test_partial_aggregation_precedes_every_exchange(spark):
    src = SkewedSources(spark)
    plan = _plan(rates.account_rates(src))
    # each hash exchange on the account key sits on a partial aggregate
    for m in re.finditer(r"Exchange hashpartitioning\(account_id#\d+L?, \d+\)", plan):
        below = plan[m.end():m.end() + 400]
        assert "HashAggregate" in below and "partial_count" in below


def test_mode_is_an_aggregate_not_a_window(spark):
    src = SkewedSources(spark)
    freq = src.messages.groupBy("account_id", "from_cc").agg(F.count(F.lit(1)).alias("ct"))
    plan = _plan(mode_per_group(freq, ["account_id"], "from_cc"))
    assert "Window" not in plan and "partial_min" in plan


@pytest.fixture
def no_broadcast(spark):
    keys = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.set(k, "-1")
    yield
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


MESSAGE_JOBS = {
    "account_rates": lambda s: rates.account_rates(s),
    "account_wide": lambda s: rates.account_wide(s, FIXTURE_PARAMS.period1, traits.account_traits(s)),
    "week_unwanted_rates": lambda s: rates.week_unwanted_rates(s),
    "week_dominant_traits": lambda s: traits.week_dominant_traits(s),
    "aup_messages": lambda s: suspension.aup_messages(s),
    "fraud_messages": lambda s: suspension.fraud_messages(s),
    "features_p1": lambda s: assemble.features_p1(s, FIXTURE_PARAMS),
    "features_p2": lambda s: assemble.features_p2(s, FIXTURE_PARAMS),
}


@pytest.mark.parametrize("name", sorted(MESSAGE_JOBS))
def test_no_raw_message_reaches_an_exchange(spark, no_broadcast, name):
    """Between a scan of the message table and the first exchange above it
    there is a partial aggregate, even when no list is small enough to broadcast."""
    plan = _plan(MESSAGE_JOBS[name](load(spark, SF_SMALL)))
    lines = [x for x in plan.split("\n") if x.strip()]
    depth = lambda x: len(x) - len(x.lstrip(" :+-*(0123456789)"))
    for i, line in enumerate(lines):
        if "FileScan parquet" in line and "events.parquet" in line and "event_type" in line:
            level, between = depth(line), ""
            for above in reversed(lines[:i]):
                if depth(above) < level:
                    level = depth(above)
                    if "Exchange" in above:
                        break
                    between += above
            assert "Aggregate" in between, line


def test_one_pass_equals_separate_passes(spark):
    """The fused counts equal the separate jobs, also for a hot sender."""
    src = SkewedSources(spark)
    p = FIXTURE_PARAMS
    got = suspension.rates_and_suspensions(src, p.period1, p.suspensions_p1, p)
    want = (rates.month_counts(src, p.period1)
            .join(suspension.aup_messages(src, p.suspensions_p1, p), "account_id", "left")
            .join(suspension.fraud_messages(src, p.suspensions_p1, p), "account_id", "left"))
    cols = ["account_id", "attempted", "delivered", *rates.ERROR_COLUMNS, "aup", "fraud"]
    key = lambda r: r.account_id
    assert sorted(got.select(*cols).collect(), key=key) == sorted(want.select(*cols).collect(), key=key)


def test_account_list_before_or_after_the_aggregate(spark, src_small):
    """Few listed accounts filter the scan, many the aggregate; same rows."""
    accounts = src_small.accounts.selectExpr("sid AS account_id")
    m = rates.month_messages(src_small, FIXTURE_PARAMS.month)
    few, many = suspension.only_accounts(m, accounts), suspension.only_accounts(m, accounts, most=3)
    assert "BroadcastHashJoin" in _plan(few) and "Join" not in _plan(many)
    assert many.count() == m.count()
