"""Most frequent message body per risky account.

Messages of listed accounts are joined to their bodies on the message id (a
uniform key, sort-merge at scale), counted per (account, body) with distinct
message ids, and the top body per account is picked by a struct-min aggregate
(count desc, body asc, NULL body last) so a hot sender never lands in one
window task. The count-distinct plan first shuffles on (account, body, sid),
which also spreads a hot account.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions import predicates as P
from sendwatch.functions.dates import date_lit
from sendwatch.operators.top1 import mode_per_group
from sendwatch.sources import Sources


def top_body_per_account(src: Sources, period: Period | None = None,
                         params: Params = DEFAULT_PARAMS) -> DataFrame:
    period = period or params.month
    end = period.next_month_start()
    m = src.messages.where(
        P.not_flagged("flags") & (F.col("error_code") == 0)
        & P.ts_half_open("date_created", period.first, end)
        & (F.col("data_load_date") >= date_lit(period.first))
        & (F.col("data_load_date") < date_lit(end)))
    risky = src.risky_list.select(F.col("sid").alias("account_id"))
    m = m.join(risky, "account_id", "left_semi").select("account_id", "sid")
    freq = (m.join(src.bodies, "sid", "left")
            .groupBy("account_id", "body").agg(F.countDistinct("sid").alias("n_sids")))
    return mode_per_group(freq, ["account_id"], "body", "n_sids")
