"""Risk scoring arithmetic: blend sweep, capped score, geometric means,
quantile summary and the mean-predictor baseline.

The blend sweep multiplies each account by the 10 weights with an
``explode`` (bounded fan-out of 10) and ranks within each weight. The
``rank <= 20`` filter over ``row_number`` is planned by Spark as a
``WindowGroupLimit``: every map task keeps only its own top 20 per weight
before the shuffle, so each weight's final window sees at most
20 x (map tasks) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendwatch.operators import stats
from sendwatch.operators.stats import r6
from sendwatch.plans.assemble import TARGETS
from sendwatch.plans.feature_profile import RISK_SCALE, risk_frame

# --- fixed values -------------------------------------------------------------
BLEND_STEPS = 10          # spam weight i * 0.1, i = 0..9 (1.0 excluded)
BLEND_STEP = 0.1
RISK_CAP = 10.0
RISK_QUANTILE = 0.85
TOP_PER_WEIGHT = 20
TOP_GEOMEAN = 10
# -----------------------------------------------------------------------------


ACTUAL = ("frac_7726", "optout_frac")


def blend_sweep_top(predicted: DataFrame, spam: str = "spam_pred", optout: str = "optout_pred",
                    k: int = TOP_PER_WEIGHT) -> DataFrame:
    """Per spam weight the ``k`` accounts with the highest blend of the two
    predicted rates, with the actual rates beside them."""
    w = F.col("_i").cast("double") * F.lit(BLEND_STEP)
    scored = (predicted.select("account_id", spam, optout, *ACTUAL,
                               F.explode(F.sequence(F.lit(0), F.lit(BLEND_STEPS - 1))).alias("_i"))
              .withColumn("_w", w)
              .withColumn("risk_score", F.col("_w") * F.col(spam) + (F.lit(1.0) - F.col("_w")) * F.col(optout))
              .withColumn("weight", F.round(F.col("_w"), 1)))
    win = Window.partitionBy("weight").orderBy(F.col("risk_score").desc(), F.col("account_id").asc())
    return (scored.withColumn("rnk", F.row_number().over(win).cast("bigint")).where(F.col("rnk") <= k)
            .select("weight", "rnk", "account_id", spam, optout, *ACTUAL, "risk_score"))


def risk_capped(predicted: DataFrame) -> DataFrame:
    """Risk score of the predicted opt-out rate, capped, beside the actual rate."""
    r = risk_frame(predicted)
    return r.select("account_id", "optout_pred", "optout_frac", "risk",
                    F.least(F.col("risk"), F.lit(RISK_CAP)).alias("risk_capped"))


def risk_quantile(predicted: DataFrame) -> DataFrame:
    return stats.quantile_summary(risk_frame(predicted), "risk", RISK_QUANTILE, RISK_CAP)


def geomean_top(features: DataFrame, plus_one: bool = False, k: int = TOP_GEOMEAN) -> DataFrame:
    spam = F.col("frac_7726") + F.lit(1.0) if plus_one else F.col("frac_7726")
    name = "score_sqrt_plus" if plus_one else "score_sqrt"
    return (features.select("account_id", "frac_7726", "optout_frac",
                            F.sqrt(spam * F.col("optout_frac")).alias(name))
            .orderBy(F.col(name).desc(), F.col("account_id").asc()).limit(k))


def baseline_rmse(features: DataFrame) -> DataFrame:
    """RMSE of predicting every account with the mean of the scored period:
    the population standard deviation of the target."""
    rows = [F.struct(F.lit(t).alias("target"), F.count(c).alias("n"),
                     r6(F.stddev_pop(c)).alias("rmse")) for t, c in TARGETS.items()]
    return features.agg(F.array(*rows).alias("_r")).select(F.inline("_r"))


assert RISK_SCALE == 100.0
