"""Write / read round trips of job outputs (CTAS, CSV hand-off, per-weight export)."""

import os
import tempfile

from sendwatch.plans import rates, score
from sendwatch.sources import sinks


def test_csv_round_trip_keeps_values(spark, src_small):
    df = rates.account_rates(src_small)
    path = os.path.join(tempfile.mkdtemp(prefix="sendwatch-csv-"), "rates")
    sinks.write_table(df, path, fmt="csv")
    back = sinks.read_csv_table(spark, path, df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def test_blend_export_partitioned_by_weight(spark, src_small):
    predicted = spark.range(60).selectExpr("id AS account_id", "id * 0.001 AS spam_pred", "(id % 7) * 0.01 AS optout_pred",
                                           "0.1 AS frac_7726", "0.2 AS optout_frac")
    df = score.blend_sweep_top(predicted)
    path = os.path.join(tempfile.mkdtemp(prefix="sendwatch-pq-"), "blend")
    sinks.write_table(df, path, partition_by=["weight"])
    dirs = sorted(d for d in os.listdir(path) if d.startswith("weight="))
    assert len(dirs) == 10
    back = sinks.read_parquet_table(spark, path)
    assert back.count() == df.count() == 200
    key = ["weight", "rnk", "account_id", "risk_score"]
    assert sorted(map(tuple, back.select(*key).collect())) == sorted(map(tuple, df.select(*key).collect()))


def test_snapshot_written_by_day_prunes(spark, src_small):
    snap = rates.message_snapshot(src_small)
    path = os.path.join(tempfile.mkdtemp(prefix="sendwatch-snap-"), "snap")
    rates.write_snapshot(snap, path)
    back = spark.read.parquet(path).where("send_day = DATE'2024-01-10'")
    plan = back._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(send_day" in plan
    assert back.count() == snap.where("CAST(sent_date AS DATE) = DATE'2024-01-10'").count()
