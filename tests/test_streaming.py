"""The streaming weekly rollup equals the batch computation on the same rows."""

import tempfile

from pyspark.sql import functions as F

from sendwatch.functions.dates import week_key
from sendwatch.plans.rates import unreachable
from sendwatch.streaming import weekly


def test_stream_matches_batch(spark, src_small):
    root = tempfile.mkdtemp(prefix="sendwatch-stream-")
    msgs = src_small.messages
    # land the month in two deliveries to exercise more than one micro-batch
    weekly.land_messages(msgs.where(F.col("sent_date") < F.lit("2024-01-15").cast("timestamp_ntz")), root + "/in")
    weekly.land_messages(msgs.where(F.col("sent_date") >= F.lit("2024-01-15").cast("timestamp_ntz")), root + "/in")
    q = weekly.start(spark, root + "/in", root + "/ckpt", output_mode="complete", available_now=True,
                     query_name="weekly_test")
    q.awaitTermination()
    got = {(r.account_id, r.wk): (r.total, r.unreachable, r.n_30007)
           for r in spark.sql("SELECT * FROM weekly_test").collect()}
    batch = (msgs.groupBy("account_id", week_key(F.col("sent_date")).alias("wk"))
             .agg(F.count(F.lit(1)).alias("total"), F.count_if(unreachable()).alias("unreachable"),
                  F.count_if(F.col("error_code") == 30007).alias("n_30007")))
    want = {(r.account_id, r.wk): (r.total, r.unreachable, r.n_30007) for r in batch.collect()}
    assert got == want


def test_append_writes_only_finished_weeks(spark, src_small):
    root = tempfile.mkdtemp(prefix="sendwatch-stream-append-")
    msgs = src_small.messages
    for lo, hi in (("2024-01-01", "2024-01-12"), ("2024-01-12", "2024-01-22"), ("2024-01-22", "2024-02-01")):
        part = msgs.where((F.col("sent_date") >= F.lit(lo).cast("timestamp_ntz"))
                          & (F.col("sent_date") < F.lit(hi).cast("timestamp_ntz")))
        weekly.land_messages(part, root + "/in")
    q = weekly.start_final_weeks(spark, root + "/in", root + "/out", root + "/ckpt", lateness="2 days",
                                 available_now=True, max_files_per_trigger=1)
    q.awaitTermination()
    got = {(r.account_id, str(r.wk)): r.total for r in spark.read.parquet(root + "/out").collect()}
    batch = (msgs.groupBy("account_id", week_key(F.col("sent_date")).alias("wk"))
             .agg(F.count(F.lit(1)).alias("total")))
    want = {(r.account_id, r.wk): r.total for r in batch.collect()}
    done_weeks = {wk for _, wk in got}
    # last event is on 2024-01-30: only weeks ending by 2024-01-28 are final
    assert done_weeks and max(done_weeks) <= "2024-01-15"
    assert got == {k: v for k, v in want.items() if k[1] in done_weeks}
