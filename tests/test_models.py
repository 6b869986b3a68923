"""Model jobs against brute force on a tiny frame."""

import threading

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from sendwatch.operators import boosting
from sendwatch.plans import models
from sendwatch.plans.assemble import FEATURES


@pytest.fixture(scope="module")
def tiny(spark):
    rnd = np.random.default_rng(11)
    rows = []
    for i in range(60):
        x = rnd.random(len(FEATURES))
        rows.append((i, *map(float, x), float(x[3] * 0.5 + rnd.random() * 0.1), float(x[5] * 0.2)))
    cols = ["account_id", *FEATURES, "optout_frac", "frac_7726"]
    df = spark.createDataFrame(rows, cols)
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def test_boosting_prefix_equals_refit(tiny):
    label = "optout_frac"
    fit, val = tiny.where("account_id % 4 != 0"), tiny.where("account_id % 4 = 0")
    big, small = models.fit_boosters(fit, [boosting.Spec(label, "huber", 2, n) for n in (4, 3)])
    staged = boosting.predict(val.drop("features"), big.cuts, {"p": big.model}, ["account_id"], [3, 4])
    want = {r.account_id: r.prediction for r in small.transform(val).collect()}
    assert {r.account_id: r.p[0] for r in staged.collect()} == want


def test_boosting_grid_matches_one_fold_fits(tiny):
    grid = {(r.target, r.loss, r.max_depth, r.n_estimators): r.mean_r2 for r in models.boosting_grid_cv(
        tiny, sizes=[2, 5], depths=(1, 2), folds=2).collect()}
    assert len(grid) == 2 * 2 * 2 * 2
    data = models._with_folds(tiny, 2)
    cuts = boosting.binning(data, FEATURES)
    r2 = []
    for k in range(2):
        m = boosting.fit(data.where(f"fold <> {k}"), cuts, [boosting.Spec("frac_7726", "lad", 2, 5)])[0]
        rows = models.Booster(cuts, m).transform(data.where(f"fold = {k}")).select("frac_7726", "prediction").toPandas()
        r2.append(1 - ((rows.frac_7726 - rows.prediction) ** 2).mean() / rows.frac_7726.var(ddof=0))
    assert grid["spam", "lad", 2, 5] == pytest.approx(np.mean(r2), abs=1e-6)
    best = models.best_grid_point(tiny.sparkSession.createDataFrame(
        [("spam", "lad", 2, 5, 0.4), ("spam", "huber", 2, 2, 0.4), ("spam", "lad", 6, 70, 0.1)],
        "target string, loss string, max_depth int, n_estimators int, mean_r2 double")).first()
    assert (best.loss, best.n_estimators) == ("huber", 2)


def test_bagging_grid_cv_shape(tiny):
    out = models.bagging_grid_cv(tiny, "optout", sizes=[2, 3], folds=2, parallelism=2).collect()
    assert [r.n_estimators for r in out] == [2, 3]


def test_depth_sweep_train_error_falls(tiny):
    train, test = tiny.where("account_id % 3 != 0"), tiny.where("account_id % 3 = 0")
    sweep = {(r.target, r.depth): r.train_rmse
             for r in models.depth_sweep(train, test, "tree", depths=[1, 8]).collect()}
    assert sweep[("optout", 8)] <= sweep[("optout", 1)]


def test_fit_depths_reuse_is_exact(tiny):
    """Depths past the saturation point reuse a fit; a real refit at such a
    depth predicts identically."""
    label = "optout_frac"
    fitted = models.fit_depths(lambda d: models._tree(d, label), list(range(1, 31)), tiny, parallelism=4)
    sat = min(d for d in fitted if models.grown_depth(fitted[d]) < d)
    refit = models._tree(30, label).fit(tiny)
    a = [r.prediction for r in fitted[30].transform(tiny).orderBy("account_id").collect()]
    b = [r.prediction for r in refit.transform(tiny).orderBy("account_id").collect()]
    assert a == b and fitted[30] is fitted[sat]


def test_sweep_has_every_depth(tiny):
    """Depths beyond Spark's limit hold the saturated model."""
    train, test = tiny.where("account_id % 3 != 0"), tiny.where("account_id % 3 = 0")
    rows = models.depth_sweep(train, test, "tree").collect()
    assert sorted((r.target, r.depth) for r in rows) == sorted((t, d) for t in models.TARGETS for d in range(1, 51))
    by = {(r.target, r.depth): r for r in rows}
    assert all(r.reached for r in rows)
    for t in models.TARGETS:
        assert by[t, 50].test_rmse == by[t, 30].test_rmse


def test_permutation_is_one_at_every_size(spark):
    """Every variant's values are a permutation of the feature's values, and are moved."""
    for n in (5, 700):
        df = spark.range(n).selectExpr("id AS account_id", "id * 10.0 AS x", "explode(array(0, 1)) AS j", "0 AS r")
        got = models.permuted_values(df, F.col("x")).toPandas()
        assert len(got) == 2 * n
        for _, part in got.groupby("j"):
            assert sorted(part._perm) == sorted(part.x)
        assert n < 50 or (got._perm != got.x).mean() > 0.95


def test_leaderboard_and_rankings(tiny, monkeypatch):
    """Registered model jobs against numpy on their own predictions."""
    train, scored = tiny.where("account_id % 3 != 0"), tiny.where("account_id % 3 = 0")
    label = "optout_frac"
    monkeypatch.setattr(models, "TUNED_BOOSTER", {"optout": ("huber", 2, 6), "spam": ("lad", 3, 5)})
    monkeypatch.setattr(models, "BAGGING_TREES", 20)
    fits = models.Fits(train)
    board = {(r.target, r.model): r for r in models.leaderboard(train, scored, fits).collect()}
    assert set(board) == {(t, m) for t in ("optout", "spam") for m in
                          ("tree", "forest", "bagging", "boosting", "knn", "mean")}
    y = np.array([r[label] for r in scored.select(label).collect()])
    assert board["optout", "mean"].rmse == pytest.approx(y.std(), abs=1e-6)
    m = models._tree(models.BEST_TREE_DEPTH["optout"], label).fit(train)
    p = np.array([(r[label], r.prediction) for r in m.transform(scored).collect()])
    assert board["optout", "tree"].rmse == pytest.approx(np.sqrt(((p[:, 0] - p[:, 1]) ** 2).mean()), abs=1e-6)
    top = models.top_predictions(train, scored, "optout", k=3, fits=fits).where("model = 'tree'").orderBy("rnk").collect()
    assert [round(v, 6) for v in sorted(p[:, 1])[::-1][:3]] == [r.pred for r in top]
    ranks = models.risk_ranking(train, scored, top=4, fits=fits)
    assert ranks.count() == 40 and {"optout_frac", "frac_7726"} <= set(ranks.columns)
    for r in ranks.collect():
        assert r.risk_score == pytest.approx(r.weight * r.spam_pred + (1 - r.weight) * r.optout_pred)
    gbt = {r.account_id: r.boosting_pred for r in models.gbt_scores(train, scored).collect()}
    assert gbt == {r.account_id: r.boosting_pred for r in models.gbt_scores(train, scored, "spam", fits).collect()}
    assert len(gbt) == scored.count()
    staged = models.huber_scores(train, scored, sizes=(2, 4))
    assert staged.count() == 2 * 2 * scored.count()
    imp = models.importance_trees(train, fits).groupBy("model", "target").agg(F.sum("importance").alias("s")).collect()
    assert all(r.s == pytest.approx(1, abs=1e-4) for r in imp) and len(imp) == 8
    perm = {r.feature: r.importance for r in models.permutation_importance(train, scored, "optout", k=3, repeats=2).collect()}
    assert set(perm) == set(FEATURES)


def test_fit_rows_bound(spark):
    df = spark.range(20_000).toDF("account_id")
    assert models.fit_rows(df).count() == 20_000
    part = models.fit_rows(df, most=2_000).count()
    assert 1_700 < part < 2_300


def test_models_are_fitted_on_all_rows(spark):
    """However many there are."""
    df = spark.range(1_200_000).toDF("account_id")
    assert models.fit_rows(df).count() == 1_200_000


def test_depth_sweep_scores_all_training_rows(tiny, monkeypatch):
    """Beyond the bound the fit is on part of the rows, the statistics on all."""
    fit_rows, label = models.fit_rows, "optout_frac"
    monkeypatch.setattr(models, "fit_rows", lambda df: fit_rows(df, most=20))
    train, test = tiny.where("account_id % 3 != 0"), tiny.where("account_id % 3 = 0")
    part = fit_rows(train, most=20)
    assert 0 < part.count() < train.count()
    got = {r.target: r for r in models.depth_sweep(train, test, "tree", depths=[3]).collect()}["optout"]
    p = models._tree(3, label).fit(part).transform(train).select(label, "prediction").toPandas()
    assert got.train_rmse == pytest.approx(np.sqrt(((p[label] - p.prediction) ** 2).mean()), abs=1e-6)
    assert got.train_r2 == pytest.approx(1 - ((p[label] - p.prediction) ** 2).sum() / (
        (p[label] - p[label].mean()) ** 2).sum(), abs=1e-6)


def test_permuted_rows_are_searched_once(tiny, monkeypatch):
    """Variants that leave a row as it is, or give it a value twice, are one query row; every variant is counted."""
    train, scored = tiny.where("account_id % 3 != 0"), tiny.where("account_id % 3 = 0")
    same = [c for c in FEATURES if c != "age"]
    scored = scored.select("account_id", "optout_frac", "frac_7726", "age", *[F.lit(1.0).alias(c) for c in same])
    sizes = []
    plain = models.knn.knn_predict
    monkeypatch.setattr(models.knn, "knn_predict", lambda q, *a: (sizes.append(q.count()), plain(q, *a))[1])
    got = {r.feature: r.importance for r in models.permutation_importance(train, scored, "optout", k=3, repeats=2).collect()}
    n = scored.count()
    assert n <= sizes[0] <= 3 * n and sizes[1] == n  # a row as it is, and two values of the one feature that differs
    assert all(got[c] == pytest.approx(0, abs=1e-6) for c in same) and got["age"] != 0
    base = scored.withColumn("_row", F.monotonically_increasing_id()).persist()
    asked, _ = models.permuted_queries(base, 2)
    per = asked.select("_row", F.inline("at")).groupBy("j", "r").agg(F.countDistinct("_row").alias("d"), F.count("_row").alias("c"))
    assert [(r.d, r.c) for r in per.collect()] == [(n, n)] * (2 * len(FEATURES))


def test_missing_fits_run_at_the_same_time(tiny, monkeypatch):
    """Neither target's forests wait for the other's, and all shares come in one small table."""
    monkeypatch.setattr(models, "TUNED_BOOSTER", {"optout": ("huber", 2, 2), "spam": ("lad", 2, 2)})
    monkeypatch.setattr(models, "FOREST_TREES", 2)
    monkeypatch.setattr(models, "BAGGING_TREES", 3)
    both, plain = threading.Barrier(2), models.forest.fit
    monkeypatch.setattr(models.forest, "fit", lambda *a: (both.wait(60), plain(*a))[1])
    fits = models.Fits(tiny)
    got = models.importance_trees(tiny, fits)
    assert got.rdd.getNumPartitions() == 1 and got.count() == 2 * 4 * len(FEATURES)
    monkeypatch.setattr(models.forest, "fit", plain)
    for target in models.TARGETS:  # as one target by itself
        want = {n: models._importances(m) for n, m in models.Fits(tiny).tuned(target).items()}
        have = {(r.model, r.feature): r.importance for r in got.where(F.col("target") == target).collect()}
        assert have == {(n, f): pytest.approx(v, abs=1e-6) for n, x in want.items() for f, v in zip(FEATURES, x)}
