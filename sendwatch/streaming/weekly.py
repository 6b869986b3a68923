"""Incremental weekly message rollup (Structured Streaming).

The batch weekly table (``plans.rates.week_unwanted_rates``) recomputes a
whole month; this job keeps the same per account-week counts up to date as
message files land. Files are read with a declared schema, the event time
gets a watermark (late messages within ``lateness`` still update their week),
and 7-day tumbling windows start on Mondays (``startTime`` of 4 days: the
epoch is a Thursday). State holds one aggregation buffer per open
account-week; a week's state is dropped once the watermark passes its end.

Output modes: ``update`` (rows for weeks that changed in a micro-batch, for
a merge into a table via ``foreachBatch``) or ``append`` (a week once final).
The checkpoint location must be on shared storage so a restarted query
resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sendwatch.functions import predicates as P
from sendwatch.plans.rates import unreachable

LANDED_SCHEMA = ("sid BIGINT, account_id BIGINT, sent_date TIMESTAMP_NTZ, status STRING, "
                 "error_code INT, flags INT, from_cc STRING, to_cc STRING, from_type STRING, "
                 "data_load_date DATE")
WEEK = "7 days"
MONDAY_OFFSET = "4 days"


def land_messages(messages: DataFrame, path: str) -> None:
    """Write message rows the way they land: Parquet partitioned by load day."""
    (messages.select(*[c.split(" ")[0] for c in LANDED_SCHEMA.split(", ")])
     .write.mode("append").partitionBy("data_load_date").parquet(path))


def weekly_counts(stream: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Per account and Monday-aligned week: volume and error-class counts."""
    spark = stream.sparkSession
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "GMT", "Z"):
        raise ValueError("weekly_counts expects spark.sql.session.timeZone=UTC (event times are UTC)")
    events = stream.withColumn("event_time", F.col("sent_date").cast("timestamp"))
    win = F.window("event_time", WEEK, WEEK, MONDAY_OFFSET)
    return (events.withWatermark("event_time", lateness)
            .groupBy("account_id", win.alias("w"))
            .agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(unreachable()).alias("unreachable"),
                 F.count_if(F.col("error_code") == 30007).alias("n_30007"),
                 F.count_if(F.col("error_code") == 30002).alias("n_30002"),
                 F.count_if(F.col("error_code") == 21610).alias("n_21610"),
                 F.count_if(~P.not_flagged("flags")).alias("n_flagged"))
            .select("account_id", F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("wk"),
                    "total", "unreachable", "n_30007", "n_30002", "n_21610", "n_flagged"))


def read_landed(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(LANDED_SCHEMA)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def start(spark: SparkSession, landed_path: str, checkpoint: str, sink=None, output_mode: str = "update",
          available_now: bool = False, query_name: str = "weekly_counts") -> StreamingQuery:
    """Start the rollup. ``sink`` is a ``foreachBatch`` function
    (batch_df, epoch_id); without it the rows go to an in-memory table named
    ``query_name`` (tests)."""
    out = weekly_counts(read_landed(spark, landed_path)).writeStream.outputMode(output_mode) \
        .option("checkpointLocation", checkpoint).queryName(query_name)
    out = out.foreachBatch(sink) if sink is not None else out.format("memory")
    if available_now:
        out = out.trigger(availableNow=True)
    return out.start()


def start_final_weeks(spark: SparkSession, landed_path: str, out_path: str, checkpoint: str,
                      lateness: str = "2 days", available_now: bool = False,
                      max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Append finished weeks to a Parquet table partitioned by week.

    A week is written once the watermark (latest event time seen minus
    ``lateness``) passes its end; messages arriving later than that are
    dropped by the watermark instead of reopening a written week. The file
    sink's commit log plus the checkpoint make each week land exactly once
    across restarts."""
    rows = weekly_counts(read_landed(spark, landed_path, max_files_per_trigger), lateness)
    w = (rows.writeStream.outputMode("append").format("parquet").partitionBy("wk")
         .option("path", out_path).option("checkpointLocation", checkpoint))
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
