"""Account traits (age, family, ISV) and dominant weekly message traits.

All message-level work is one pass with partial aggregation; the mode of each
trait is an aggregate (``min`` of a struct), never a window over a sender's
rows. Account-level tables are bounded by the number of accounts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.config import DEFAULT_PARAMS, Params, Period
from sendwatch.functions.dates import complete_months, date_lit, ts_lit, week_key
from sendwatch.operators.tiles import tile_cutpoints
from sendwatch.plans.rates import WEEK_TRAITS, message_snapshot, week_trait_counts
from sendwatch.session import materialize
from sendwatch.sources import Sources

# --- fixed values: age and family-size buckets (months / sub-accounts) ------
AGE_CUTS = (11, 26, 47)
CUTPOINT_TILES = (0, 25, 50, 75)
# ---------------------------------------------------------------------------

def _live_accounts(src: Sources, params: Params) -> DataFrame:
    return (src.accounts.where(F.col("date_created") < ts_lit(params.ages_as_of))
            .withColumn("family_id", F.coalesce("parent_sid", "sid")))


def weighted_crosswalk(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """(account_id, customer_id, isv, weight): ``weight`` rows of the crosswalk.

    The left join to the CRM's accounts adds no column; a customer that the CRM
    holds n times repeats its rows n times. That is a number per customer, so
    rows carry it and are repeated only where a job puts them out. Sources
    without a CRM table have weight 1."""
    isv_ids = src.isv_list.select(F.col("id").alias("customer_id")).distinct().withColumn("_hit", F.lit(1))
    link = src.customer_link.where(F.col("account_id").isNotNull()
                                   & (F.col("account_id") != params.sentinel_account_id))
    crm = getattr(src, "crm_accounts", None)
    times = (crm.groupBy("customer_id").agg(F.count(F.lit(1)).alias("weight")) if crm is not None
             else isv_ids.select("customer_id", F.lit(1).cast("bigint").alias("weight")))
    return (link.join(isv_ids, "customer_id", "left").join(times, "customer_id", "left")
            .select("account_id", "customer_id", F.when(F.col("_hit").isNotNull(), 1).otherwise(0).alias("isv"),
                    F.coalesce("weight", F.lit(1)).alias("weight")))


def repeated(weighted: DataFrame) -> DataFrame:
    """Every row ``weight`` times, without the weight."""
    return (weighted.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("weight").cast("int"))))
            .drop("weight", "_"))


def isv_crosswalk(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """account_id -> customer_id with an ISV marker (customer on the ISV list)."""
    return repeated(weighted_crosswalk(src, params))


def family_sizes(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Sub-accounts per family root (distinct members minus the root)."""
    return (_live_accounts(src, params).groupBy("family_id")
            .agg((F.countDistinct("sid") - 1).alias("num_sub")))


def account_traits(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Per account: parent, family root, age in whole months, parent flag,
    family sub-account count, ISV flag looked up on the family root, and the
    age / family buckets. One row per account and crosswalk row of its root."""
    a = _live_accounts(src, params).select(
        "parent_sid", "sid", "family_id",
        complete_months(F.to_date("date_created"), date_lit(params.ages_as_of)).alias("age"),
        F.when(F.col("parent_sid").isNull(), 0).otherwise(1).alias("parent"))
    fam = family_sizes(src, params)
    isv = (weighted_crosswalk(src, params).groupBy(F.col("account_id").alias("family_id"), "isv")
           .agg(F.sum("weight").alias("weight")))
    lo, mid, hi = AGE_CUTS
    age_cat = (F.when(F.col("age") <= lo, F.lit(f"0-{lo}"))
               .when((F.col("age") > lo) & (F.col("age") <= mid), F.lit(f"{lo}-{mid}"))
               .when(F.col("age") > hi, F.lit(f"> {hi}"))
               .otherwise(F.lit(f"{mid}-{hi}")))
    sub_cat = (F.when(F.col("num_sub") == 0, F.lit("0")).when(F.col("num_sub") == 1, F.lit("1"))
               .otherwise(F.lit("> 1")))
    return repeated(a.join(fam, "family_id", "left").join(isv, "family_id", "left")
                    .select("parent_sid", "sid", "family_id", "age", "parent", "num_sub",
                            F.coalesce("isv", F.lit(0)).alias("isv"), age_cat.alias("age_cat"),
                            sub_cat.alias("num_sub_cat"), F.coalesce("weight", F.lit(1)).alias("weight")))


def family_size(traits: DataFrame) -> DataFrame:
    """Family size per account (members of the account's family). The
    reference self-joins the traits table and later drops the duplicate rows
    that join creates; the distinct projection is the same result."""
    return traits.select("sid", (F.coalesce("num_sub", F.lit(0)) + 1).alias("fam_size")).distinct()


def default_name_flags(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """sid, friendly_name and whether the name is the default one."""
    return src.accounts.select(
        "sid", "friendly_name",
        F.when(F.col("friendly_name").contains(params.default_name_marker), 1).otherwise(0).alias("default_name"))


def age_cutpoints(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    ages = _live_accounts(src, params).select(
        complete_months(F.to_date("date_created"), date_lit(params.ages_as_of)).alias("age"))
    return tile_cutpoints(ages, "age", CUTPOINT_TILES)


def subaccount_cutpoints(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    fams = family_sizes(src, params).where(F.col("num_sub") > 0).select("num_sub")
    return tile_cutpoints(fams, "num_sub", CUTPOINT_TILES)


def _week_trait_frequencies(counts: DataFrame) -> DataFrame:
    """(account, week, trait, value) -> count, NULL values included. The
    fan-out by trait is over aggregated counts, not over messages."""
    long = (counts.select("account_id", "wk", "ct", *WEEK_TRAITS)
            .unpivot(["account_id", "wk", "ct"], WEEK_TRAITS, "trait", "value"))
    return long.groupBy("account_id", "wk", "trait", "value").agg(F.sum("ct").alias("ct"))


def week_volume(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS,
                snapshot: DataFrame | None = None) -> DataFrame:
    period = period or params.month
    snap = snapshot if snapshot is not None else message_snapshot(src, period)
    return (snap.groupBy("account_id", week_key(F.col("sent_date")).alias("wk"))
            .agg(F.count(F.lit(1)).alias("ct")))


def week_dominant_traits(src: Sources, period: Period | None = None, params: Params = DEFAULT_PARAMS,
                         snapshot: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Per account-week: most frequent non-NULL origin country, destination
    country, sender type and status, plus the week's message volume. Weeks
    without any origin country are absent (the table is keyed on it).

    One pass over the snapshot: counts per account, week and combination of
    traits (``counts``, if they are there already), of these counts per
    (account, week, trait, value), then
    per (account, week, trait) the mode (struct-min over non-NULL values,
    ties to the smallest value) and the total (every message carries each
    trait, NULL included, so any trait's total is the week's volume)."""
    period = period or params.month
    if counts is None:
        counts = week_trait_counts(snapshot if snapshot is not None else message_snapshot(src, period))
    freq = _week_trait_frequencies(counts)
    pick = F.min(F.when(F.col("value").isNotNull(),
                        F.struct((-F.col("ct")).alias("neg_ct"), F.col("value").alias("v"))))
    per_trait = (freq.groupBy("account_id", "wk", "trait")
                 .agg(pick.alias("_pick"), F.sum("ct").alias("_total")))
    wide = per_trait.groupBy("account_id", "wk").agg(
        *[F.max(F.when(F.col("trait") == t, F.col("_pick.v"))).alias(t) for t in WEEK_TRAITS],
        F.max("_total").alias("ct"))
    return wide.where(F.col("from_cc").isNotNull()).select("account_id", "wk", *WEEK_TRAITS, "ct")


def week_wide(src: Sources, params: Params = DEFAULT_PARAMS) -> DataFrame:
    """Weekly rates joined to the week's dominant traits and account traits.
    Both come from one aggregate of the messages, written once."""
    from sendwatch.plans.rates import week_unwanted_rates

    counts = materialize(week_trait_counts(message_snapshot(src, params.month)))
    u = week_unwanted_rates(src, params.month, params, counts=counts)
    r = week_dominant_traits(src, params.month, params, counts=counts)
    a = account_traits(src, params)
    j = u.join(r, ["account_id", "wk"], "inner")
    return j.join(a, j["account_id"] == a["sid"], "inner")
