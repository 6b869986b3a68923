"""The monthly batch run writes every output and its tables equal the
registered queries."""

import tempfile

import __spark_entry__ as E
from sendwatch.monthly import run_month
from sendwatch.sources.fixtures import FIXTURE_PARAMS
from tests.conftest import SF_SMALL
from tools.oracle_check import rows_of


def test_run_month_outputs_match_queries(spark):
    out = tempfile.mkdtemp(prefix="sendwatch-month-")
    written = run_month(spark, SF_SMALL, out, FIXTURE_PARAMS)
    assert {"message_snapshot", "week_unwanted_rates", "features_p1", "blend_sweep_top20"} <= set(written)
    for name in ("week_unwanted_rates", "week_dominant_traits", "share_cc_pair", "account_wide_p1",
                 "features_p2"):
        got = spark.read.parquet(written[name])
        want = E.queries()[name](spark, SF_SMALL)
        cols = sorted(want.columns)
        assert rows_of(cols, [tuple(r) for r in got.select(*cols).collect()], False) == \
            rows_of(cols, [tuple(r) for r in want.select(*cols).collect()], False)


def test_csv_run_writes_every_output(spark):
    """The format changes the files, not which outputs there are."""
    out = tempfile.mkdtemp(prefix="sendwatch-month-csv-")
    written = run_month(spark, SF_SMALL, out, FIXTURE_PARAMS, fmt="csv")
    assert {"blend_sweep_top20", "risk_capped", "risk_ranking", "features_p2"} <= set(written)
    risk = spark.read.option("header", True).csv(written["risk_capped"])
    assert risk.count() == E.queries()["risk_capped"](spark, SF_SMALL).count() > 0
