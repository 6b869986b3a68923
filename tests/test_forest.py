"""Bagged trees of any depth, and depth sweeps from one fit."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler

from sendwatch.operators import boosting, forest
from sendwatch.plans import models
from sendwatch.plans.assemble import FEATURES


@pytest.fixture(scope="module")
def frame(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(240):
        x = np.round(rnd.random(len(FEATURES)), 1)
        rows.append((i, *map(float, x), float(x[3] * 0.5 + rnd.random() * 0.1), float(x[5] * 0.2 + x[0])))
    df = spark.createDataFrame(rows, ["account_id", *FEATURES, "optout_frac", "frac_7726"])
    return VectorAssembler(inputCols=FEATURES, outputCol="features").transform(df)


def grown_by_hand(x, y, w, depth):
    """{row: prediction} by a plain recursion over exact cuts."""
    out = np.zeros(len(x))

    def go(rows, used, level):
        out[rows] = np.average(y[used], weights=w[used])
        if level == depth or len(np.unique(y[used])) < 2:
            return
        best = (0.0, None, None)
        error = (w[used] * (y[used] - np.average(y[used], weights=w[used])) ** 2).sum()
        for j in range(x.shape[1]):
            for c in np.unique(x[used, j])[:-1]:
                left, right = used[x[used, j] <= c], used[x[used, j] > c]
                rest = sum((w[p] * (y[p] - np.average(y[p], weights=w[p])) ** 2).sum() for p in (left, right))
                if error - rest > best[0] + 1e-9 * error:
                    best = (error - rest, j, c)
        if best[1] is not None:
            for side in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
                go(rows[side[rows]], used[side[used]], level + 1)

    go(np.arange(len(x)), np.flatnonzero(w), 0)
    return out


@pytest.mark.parametrize("depth", [0, 1, 3, 30])
def test_tree_is_the_greedy_one(depth):
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 9, (150, 4)).astype(np.uint8)
    y, w = rng.integers(0, 1000, 150), rng.poisson(1.0, 150)
    nodes, _, reached = forest.grow(x, y, w, depth, 1.0)
    got = nodes.staged(x, [depth])[:, 0]
    want = grown_by_hand(x, y.astype(float), w, depth)
    assert reached <= depth
    if depth < 30:
        assert got == pytest.approx(want)
    else:  # cuts that leave the same rows apart may differ between small nodes: every drawn row is fitted
        _, same = np.unique(x[w > 0], axis=0, return_inverse=True)
        mean = (np.bincount(same, (w * y)[w > 0]) / np.bincount(same, w[w > 0]))[same]
        assert got[w > 0] == pytest.approx(mean)


def test_forest_does_not_depend_on_partitions(frame):
    cuts = boosting.binning(frame, FEATURES)
    a, b = (forest.fit(df, cuts, [forest.Spec("frac_7726", 30, 5)])[0] for df in (frame.coalesce(1), frame.repartition(7)))
    p, q = ({r.account_id: r.prediction for r in f.transform(frame.repartition(n)).collect()} for f, n in ((a, 3), (b, 1)))
    assert p == q and len(p) == 240 and a.importances == b.importances and sum(a.importances) == pytest.approx(1)


def test_chunks_and_groups_add_up(frame, monkeypatch):
    cuts = boosting.binning(frame, FEATURES)
    f = forest.fit(frame, cuts, [forest.Spec("frac_7726", 6, 5)])[0]
    want = {r.account_id: r.prediction for r in f.transform(frame).collect()}
    chunks = forest._chunks
    monkeypatch.setattr(forest, "_chunks", lambda t: chunks(t, 7))
    got = {r.account_id: r.predictions for r in f.staged(frame.repartition(3), [2, 6], 2).collect()}
    assert {k: v[1] for k, v in got.items()} == pytest.approx(want)
    cut = forest.fit(frame, cuts, [forest.Spec("frac_7726", 2, 5)])[0]
    assert {k: v[0] for k, v in got.items()} == pytest.approx({r.account_id: r.prediction
                                                              for r in cut.transform(frame).collect()})
    assert f.staged(frame.limit(0), [2, 6]).count() == 0


def test_pieces_of_chunks_add_up(frame, monkeypatch):
    f = forest.fit(frame, boosting.binning(frame, FEATURES), [forest.Spec("frac_7726", 6, 5)])[0]
    want = {r.account_id: r.predictions for r in f.staged(frame, [2, 6], 3).collect()}
    monkeypatch.setattr(forest, "PIECE_BYTES", 160)
    assert {r.account_id: r.predictions for r in f.staged(frame, [2, 6], 3).collect()} == want and len(want) == 240


def test_full_depth_forest_takes_a_bounded_number_of_jobs(frame, spark):
    """Spark's forest runs a job or more per level; these trees grow in one."""
    cuts = boosting.binning(frame, FEATURES)
    group = "forest-jobs"
    spark.sparkContext.setJobGroup(group, "")
    forest.fit(frame, cuts, [forest.Spec("frac_7726", 30, 400)])
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("", "")
    assert n <= 12


def test_tree_sweep_is_one_fit_and_equals_a_fit_per_depth(frame, monkeypatch):
    train, test = frame.where("account_id % 3 != 0"), frame.where("account_id % 3 = 0")
    fits, fit_all = [], models._fit_all
    monkeypatch.setattr(models, "_fit_all", lambda es, *a: (fits.extend(es), fit_all(es, *a))[1])
    got = {(r.target, r.depth): r for r in models.depth_sweep(train, test, "tree", range(1, 12)).collect()}
    assert len(fits) == len(models.TARGETS)
    for t, label in models.TARGETS.items():
        for d in (1, 4, 9):
            m = models._tree(d, label).fit(train)
            for split, df in (("train", train), ("test", test)):
                r = models._rmse_by(models._scored(m, df, label, {"k": 1}), ["k"]).first()
                assert (got[t, d][f"{split}_rmse"], got[t, d][f"{split}_r2"]) == pytest.approx((r.rmse, r.r2), abs=2e-6)


def test_forest_sweep_equals_a_fit_per_depth(frame, monkeypatch):
    monkeypatch.setattr(models, "FOREST_TREES", 6)
    train, test = frame.where("account_id % 3 != 0"), frame.where("account_id % 3 = 0")
    got = {(r.target, r.depth): r for r in models.depth_sweep(train, test, "forest").collect()}
    assert len(got) == 100 and all(r.reached for r in got.values())
    f = forest.fit(train, boosting.binning(train, FEATURES), [forest.Spec("frac_7726", 4, 6)])[0]
    p = f.transform(test).select("frac_7726", "prediction").toPandas()
    assert got["spam", 4].test_rmse == pytest.approx(np.sqrt(((p.frac_7726 - p.prediction) ** 2).mean()), abs=2e-6)


@pytest.mark.parametrize("depth", [3, 30])
def test_tree_of_many_slices_is_the_same(monkeypatch, depth):
    """Nodes larger than a slice are summed up per bin, small ones share a slice."""
    rng = np.random.default_rng(depth)
    x = rng.integers(0, 40, (3000, 5)).astype(np.uint8)
    y = (rng.integers(0, 1 << 36, 3000) + (x[:, 2].astype(np.int64) << 33)) * (x[:, 0] > 9)
    w = forest.draws(0, 7, 3000)
    one = forest.grow(x, y, w, depth, 0.5)
    monkeypatch.setattr(forest, "SLICE", 130)
    assert np.array_equal(w, forest.draws(0, 7, 3000)) and np.array_equal(w, np.random.default_rng([0, 7]).poisson(1.0, 3000))
    many = forest.grow(x, y, w, depth, 0.5)
    again = forest.unpacked(forest.packed(many[0]))
    for part in ("feature", "cut", "left", "right", "value"):
        assert np.array_equal(getattr(one[0], part), getattr(many[0], part)), part
        assert np.array_equal(getattr(again, part), getattr(many[0], part)), part
    assert one[2] == many[2] and np.array_equal(one[1], many[1])


def test_tree_takes_its_cuts_from_all_rows(spark):
    """Spark's tree looks for cuts in a sample of 65,536 rows, where one row of 150,000 is mostly missed."""
    df = spark.range(150_000).selectExpr("id AS account_id", *[
        f"CAST(IF(id = {17_011 * (j + 1)}, 1, 0) AS double) AS {c}" for j, c in enumerate(FEATURES)])
    df = df.withColumn("optout_frac", sum(df[c] * (j + 1) for j, c in enumerate(FEATURES[:7])))
    tree = models.fit_trees(df, [(7, "optout_frac")])[0]
    got = sorted(r.prediction for r in tree.transform(df.where("optout_frac > 0")).collect())
    assert got == pytest.approx([1, 2, 3, 4, 5, 6, 7], abs=1e-6)


def test_sweep_beyond_sparks_cuts(frame, monkeypatch):
    """More rows than Spark takes cuts from: one tree on every row once, scored at every depth."""
    train, test = frame.where("account_id % 3 != 0"), frame.where("account_id % 3 = 0")
    monkeypatch.setattr(models, "SPARK_TREE_ROWS", 100)
    got = {(r.target, r.depth): r for r in models.depth_sweep(train, test, "tree").collect()}
    assert len(got) == 100 and all(r.reached for r in got.values())
    rows = train.select(*FEATURES, "frac_7726").toPandas()
    x = np.stack([np.unique(rows[c], return_inverse=True)[1] for c in FEATURES], axis=1)
    y = rows.frac_7726.to_numpy()
    for d in (1, 3):
        p = grown_by_hand(x, y, np.ones(len(y)), d)
        assert got["spam", d].train_rmse == pytest.approx(np.sqrt(((y - p) ** 2).mean()), abs=2e-6)
