"""Results do not depend on the session time zone (event times are NTZ)."""

import pytest

import __spark_entry__ as E
from tests.conftest import SF_SMALL
from tools.oracle_check import rows_of

NAMES = ["account_rates", "week_unwanted_rates", "aup_messages", "complaint_rate_account",
         "complaint_rate_month", "account_traits", "features_p1"]


@pytest.mark.parametrize("name", NAMES)
def test_same_result_in_another_session_zone(spark, name):
    q = E.queries()[name]

    def run():
        df = q(spark, SF_SMALL)
        return rows_of(df.columns, [tuple(r) for r in df.collect()], False)

    base = run()
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        other = run()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert base == other
