"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables in ``sf_dir`` through the source views,
over the whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sendwatch.plans import (assemble, bodies, complaints, feature_profile, models, profile, rates,
                             score, suspension, traits)
from sendwatch.session import materialize
from sendwatch.sources import Sources, load
from sendwatch.sources.fixtures import FIXTURE_PARAMS as PRM

QueryFn = Callable[[SparkSession, str], DataFrame]


def _q(fn: Callable[[Sources], DataFrame]) -> QueryFn:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(load(spark, sf_dir))
    run.__name__ = getattr(fn, "__name__", "query")
    return run


def _relational() -> dict[str, QueryFn]:
    return {
        "account_rates": _q(lambda s: rates.account_rates(s)),
        "account_error_counts": _q(lambda s: rates.account_error_counts(s)),
        "message_snapshot": _q(lambda s: rates.message_snapshot(s)),
        "week_unwanted_rates": _q(lambda s: rates.week_unwanted_rates(s)),
        "week_dominant_traits": _q(lambda s: traits.week_dominant_traits(s)),
        "week_volume": _q(lambda s: traits.week_volume(s)),
        "week_wide": _q(lambda s: traits.week_wide(s)),
        "account_traits": _q(lambda s: traits.account_traits(s)),
        "isv_flag": _q(lambda s: traits.isv_crosswalk(s)),
        "family_size": _q(lambda s: traits.family_size(traits.account_traits(s))),
        "default_name_flag": _q(lambda s: traits.default_name_flags(s, PRM)),
        "age_tile_cutpoints": _q(lambda s: traits.age_cutpoints(s)),
        "subaccount_tile_cutpoints": _q(lambda s: traits.subaccount_cutpoints(s)),
        "account_wide_p1": _q(lambda s: rates.account_wide(s, PRM.period1, traits.account_traits(s))),
        "account_wide_p2": _q(lambda s: rates.account_wide(s, PRM.period2, traits.account_traits(s))),
        "aup_messages": _q(lambda s: suspension.aup_messages(s)),
        "fraud_messages": _q(lambda s: suspension.fraud_messages(s)),
        "top_body_per_account": _q(lambda s: bodies.top_body_per_account(s)),
        "complaint_rate_account": _q(lambda s: complaints.complaint_rate_account(s)),
        "complaint_rate_month": _q(lambda s: complaints.complaint_rate_month(s)),
    }


def _f1(fn: Callable[[DataFrame], DataFrame], shared: bool = False) -> QueryFn:
    """Profile of the period-1 features. ``shared``: the profile reads the
    feature table in several branches (a summary row, then a pass), so the
    table is written once under the checkpoint folder and read back instead
    of re-running the feature joins per branch."""
    if shared:
        return _q(lambda s: fn(materialize(assemble.features_p1(s, PRM))))
    return _q(lambda s: fn(assemble.features_p1(s, PRM)))


def _f2(fn: Callable[[DataFrame], DataFrame], shared: bool = False) -> QueryFn:
    if shared:
        return _q(lambda s: fn(materialize(assemble.features_p2(s, PRM))))
    return _q(lambda s: fn(assemble.features_p2(s, PRM)))


def _profiles() -> dict[str, QueryFn]:
    return {
        "share_from_cc": _q(lambda s: profile.share_of(s, "from_cc")),
        "share_to_cc": _q(lambda s: profile.share_of(s, "to_cc")),
        "share_cc_pair": _q(lambda s: profile.share_cc_pair(s)),
        "share_from_type": _q(lambda s: profile.share_of(s, "from_type")),
        "share_status": _q(lambda s: profile.share_of(s, "status")),
        "share_error_code": _q(lambda s: profile.share_error_code(s)),
        "top_error_codes": _q(lambda s: profile.top_error_codes(s)),
        "top_failed_codes": _q(lambda s: profile.top_failed_codes(s)),
        "dq_duplicates": _q(lambda s: profile.dq_duplicates(s)),
        "dq_null_keys": _q(lambda s: profile.dq_null_keys(s)),
        "dq_key_containment": _q(lambda s: profile.dq_key_containment(s)),
        "dq_weeks_per_account": _q(lambda s: profile.dq_weeks_per_account(s)),
        "dq_week_duplicates": _q(lambda s: profile.dq_week_duplicates(s)),
    }


def _predicted(fn: Callable[[DataFrame], DataFrame]) -> QueryFn:
    """A risk job on the KNN predictions of the scored period."""
    def run(s: Sources) -> DataFrame:
        train, _, f2 = _split(s)
        return fn(materialize(models.knn_predictions(train, f2)))
    return _q(run)


def _features() -> dict[str, QueryFn]:
    return {
        "features_p1": _q(lambda s: assemble.features_p1(s, PRM)),
        "features_p2": _q(lambda s: assemble.features_p2(s, PRM)),
        "describe_features": _f1(feature_profile.describe_features, shared=True),
        "null_counts": _q(lambda s: feature_profile.null_counts(assemble.merged_period1(s, PRM))),
        "corr_long": _f1(feature_profile.corr_features, shared=True),
        "hist_age": _f1(feature_profile.hist_age, shared=True),
        "hist_unreachable": _f1(feature_profile.hist_unreachable, shared=True),
        "hist_21610": _f1(feature_profile.hist_21610, shared=True),
        "hist_risk": _predicted(feature_profile.hist_risk),
        "category_counts": _f1(feature_profile.category_counts),
        "cohort_sums": _f1(feature_profile.cohort_sums),
        "cohort_counts": _f1(feature_profile.cohort_counts),
        "column_totals": _f1(feature_profile.column_totals),
        "mean_by_flag": _f1(feature_profile.mean_by_flag),
        "baseline_rmse": _f2(score.baseline_rmse),
        "geomean_top": _f2(lambda f: score.geomean_top(f)),
        "geomean_plus_top": _f2(lambda f: score.geomean_top(f, plus_one=True)),
        "blend_sweep_top20": _predicted(lambda f: score.blend_sweep_top(f)),
        "risk_capped": _predicted(score.risk_capped),
        "risk_quantile": _predicted(score.risk_quantile),
        "sorted_21610": _f1(feature_profile.sorted_column),
    }


def _split(s: Sources):
    """Feature tables cut from their lineage once (reliable checkpoint), so
    the neighbour search's block sizing and scoring do not recompute them."""
    f1 = materialize(assemble.features_p1(s, PRM))
    flag = assemble.split_flag(PRM)
    return f1.where(flag), f1.where(~flag), materialize(assemble.features_p2(s, PRM))


def _knn() -> dict[str, QueryFn]:
    def predict(s: Sources) -> DataFrame:
        train, _, f2 = _split(s)
        return models.knn_scores(train, f2, "optout")

    def sweep(s: Sources) -> DataFrame:
        train, test, _ = _split(s)
        return models.knn_sweep(train, test)

    def best_k(s: Sources) -> DataFrame:
        train, test, _ = _split(s)
        return models.best_param(models.knn_sweep(train, test), "k")

    def predict_spam(s: Sources) -> DataFrame:
        train, _, f2 = _split(s)
        return models.knn_scores(train, f2, "spam")

    return {"knn_predict": _q(predict), "knn_predict_spam": _q(predict_spam), "knn_k_sweep": _q(sweep),
            "knn_best_k": _q(best_k)}


_SHARED: dict[tuple[str, str], tuple] = {}


def _shared(spark: SparkSession, sf_dir: str) -> tuple:
    """(train, test, scored, fits) of one application and input: the model frames
    are written once, and what one job has fitted the others use."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SHARED:
        _SHARED.clear()  # one input at a time
        s = load(spark, sf_dir)
        train, test, scored = models.model_frames(assemble.features_p1(s, PRM), assemble.features_p2(s, PRM), PRM)
        _SHARED[key] = (train, test, scored, models.Fits(train))
    return _SHARED[key]


def _m(fn: Callable) -> QueryFn:
    """A model job: ``fn(train, test, scored, fits)``."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(*_shared(spark, sf_dir))
    return run


def _ml() -> dict[str, QueryFn]:
    """Model-training jobs (no SQL oracle; checked against brute force in tests)."""
    def depths(family: str) -> QueryFn:
        return _m(lambda tr, te, sc, fits: models.depth_sweep(tr, te, family))

    def best(family: str) -> QueryFn:
        return _m(lambda tr, te, sc, fits: models.best_param(models.depth_sweep(tr, te, family), "depth"))

    return {
        "tree_depth_sweep": depths("tree"), "forest_depth_sweep": depths("forest"),
        "tree_best_depth": best("tree"), "forest_best_depth": best("forest"),
        "top_predictions": _m(lambda tr, te, sc, fits: models.top_predictions(tr, sc, fits=fits)),
        "top_predictions_spam": _m(lambda tr, te, sc, fits: models.top_predictions(tr, sc, "spam", fits=fits)),
        "gbt_lad": _m(lambda tr, te, sc, fits: models.gbt_scores(tr, sc, "spam", fits)),
        "gbt_huber": _m(lambda tr, te, sc, fits: models.huber_scores(tr, sc)),
        "gbt_grid_cv": _m(lambda tr, te, sc, fits: models.boosting_grid_cv(tr)),
        "gbt_grid_cv_depths": _m(lambda tr, te, sc, fits: models.boosting_grid_cv(
            tr, ["spam"], depths=models.BOOSTING_DEPTHS)),
        "importance_trees": _m(lambda tr, te, sc, fits: models.importance_trees(tr, fits)),
        "importance_permutation": _m(lambda tr, te, sc, fits: models.permutation_importance(tr, sc, "optout")),
        "importance_permutation_spam": _m(lambda tr, te, sc, fits: models.permutation_importance(tr, sc, "spam")),
        "leaderboard": _m(lambda tr, te, sc, fits: models.leaderboard(tr, sc, fits)),
        "risk_ranking": _m(lambda tr, te, sc, fits: models.risk_ranking(tr, sc, fits=fits)),
    }


def queries() -> dict[str, QueryFn]:
    out = _relational()
    out.update(_profiles())
    out.update(_features())
    out.update(_knn())
    out.update(_ml())
    return out
