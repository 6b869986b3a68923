"""The jobs on landed Parquet and CSV tables equal those on the fixture views."""

import pytest
from pyspark.sql import functions as F

from sendwatch.plans import assemble, complaints, rates
from sendwatch.sources.fixtures import FIXTURE_PARAMS
from sendwatch.sources.landed import VIEWS, LandedSources


@pytest.fixture(scope="module")
def landed(spark, src_small, tmp_path_factory):
    root = tmp_path_factory.mktemp("landed")
    paths, formats = {}, {}
    for name in VIEWS:
        df = getattr(src_small, name)
        paths[name] = str(root / name)
        if name in ("complaints", "tickets", "risky_list"):
            formats[name] = "csv"
            if name == "tickets":
                df = df.withColumn("tags", F.array_join("tags", ","))
            df.write.option("header", True).csv(paths[name])
        elif name == "messages":
            df.write.partitionBy("data_load_date").parquet(paths[name])
        else:
            df.write.parquet(paths[name])
    return paths, formats


def _rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_jobs_agree(spark, src_small, landed):
    src = LandedSources(spark, *landed)
    for job in (lambda s: rates.account_rates(s), lambda s: assemble.features_p1(s, FIXTURE_PARAMS),
                lambda s: complaints.complaint_rate_account(s)):
        assert _rows(job(src)) == _rows(job(src_small))


def test_load_day_bound_prunes_partitions(spark, landed):
    src = LandedSources(spark, *landed)
    plan = rates.month_messages(src, FIXTURE_PARAMS.period2)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(data_load_date" in plan


def test_drift_is_an_error(spark, landed, tmp_path):
    spark.range(3).toDF("wrong").write.parquet(str(tmp_path / "x"))
    with pytest.raises(ValueError, match="no column sid"):
        LandedSources(spark, {"bodies": str(tmp_path / "x")})
    with pytest.raises(ValueError, match="unknown"):
        LandedSources(spark, {"nonsense": str(tmp_path / "x")})
    with pytest.raises(AttributeError):
        _ = LandedSources(spark, {}).messages
