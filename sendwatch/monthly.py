"""Monthly batch run: every job of one month, written to a shared folder.

    python -m sendwatch.monthly <sf_dir> <out_dir> [parquet|csv]

The trimmed message snapshot is written once, partitioned by send day, and
read back: the weekly tables, message profiles and period tables then share
that one pass over the raw message table, and their lineage starts at a table
on shared storage (a lost executor recomputes from the snapshot files, not
from the raw month). Tables that later steps read (account traits, features) are
written as Parquet whatever the format of the outputs. Each output is its own
directory under ``out_dir``. The run takes the session that it is given; it
sets neither a master nor a number of shuffle partitions.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

from sendwatch.config import DEFAULT_PARAMS, Params
from sendwatch.plans import (assemble, bodies, complaints, models, profile, rates, score,
                             suspension, traits)
from sendwatch.session import materialize
from sendwatch.sources import load, sinks


def run_month(spark: SparkSession, sf_dir: str, out_dir: str, params: Params = DEFAULT_PARAMS,
              fmt: str = "parquet") -> dict[str, str]:
    src = load(spark, sf_dir)
    written: dict[str, str] = {}

    def out(name: str, df: DataFrame, partition_by=()) -> DataFrame:
        path = os.path.join(out_dir, name)
        sinks.write_table(df, path, fmt=fmt, partition_by=partition_by)
        written[name] = path
        return df

    snap_path = os.path.join(out_dir, "message_snapshot")
    rates.write_snapshot(rates.message_snapshot(src, params.month), snap_path)
    written["message_snapshot"] = snap_path
    snap = spark.read.parquet(snap_path)

    acct = materialize(traits.account_traits(src, params))
    out("account_traits", acct)
    out("week_unwanted_rates", rates.week_unwanted_rates(src, params.month, params, snapshot=snap))
    out("week_dominant_traits", traits.week_dominant_traits(src, params.month, params, snapshot=snap))
    for col in ("from_cc", "to_cc", "from_type", "status"):
        out(f"share_{col}", profile.share_of(src, col, params=params, snapshot=snap))
    out("share_cc_pair", profile.share_cc_pair(src, params=params, snapshot=snap))
    out("share_error_code", profile.share_error_code(src, params=params, snapshot=snap))
    out("top_error_codes", profile.top_error_codes(src, params=params))
    out("account_rates", rates.account_rates(src, params.month, params, with_errors=True))
    out("aup_messages", suspension.aup_messages(src, params.suspensions_month, params))
    out("fraud_messages", suspension.fraud_messages(src, params.suspensions_month, params))
    out("top_body_per_account", bodies.top_body_per_account(src, params.month, params))
    out("complaint_rate_account", complaints.complaint_rate_account(src, params.month, params))
    out("complaint_rate_month", complaints.complaint_rate_month(src, params.month, params))
    for tag, period in (("p1", params.period1), ("p2", params.period2)):
        out(f"account_wide_{tag}", rates.account_wide(src, period, acct))
    f1 = materialize(assemble.features_p1(src, params))
    f2 = materialize(assemble.features_p2(src, params))
    out("features_p1", f1)
    out("features_p2", f2)
    train = f1.where(assemble.split_flag(params))
    predicted = materialize(models.knn_predictions(train, f2))
    out("blend_sweep_top20", score.blend_sweep_top(predicted), partition_by=["weight"])
    out("risk_capped", score.risk_capped(predicted))
    tr, _, sc = models.model_frames(f1, f2, params)
    out("risk_ranking", models.risk_ranking(tr, sc), partition_by=["weight"])
    return written


def main(argv: list[str]) -> None:
    from sendwatch.sources.fixtures import FIXTURE_PARAMS

    sf_dir, out_dir = argv[0], argv[1]
    fmt = argv[2] if len(argv) > 2 else "parquet"
    spark = (SparkSession.builder.appName("sendwatch-monthly")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    for name, path in run_month(spark, sf_dir, out_dir, FIXTURE_PARAMS, fmt=fmt).items():
        print(name, path)


if __name__ == "__main__":
    main(sys.argv[1:])
