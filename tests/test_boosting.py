"""Lockstep boosting against a plain numpy version, order statistics against sorted values."""

import numpy as np
import pytest

from sendwatch.operators import boosting as B

COLS = ["a", "b", "c"]


def frame(spark, n=400, seed=5):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 6, n), rng.random(n).round(2), rng.integers(0, 2, n)], axis=1).astype(float)
    y = 0.3 * x[:, 1] + 0.1 * (x[:, 0] > 3) + 0.2 * x[:, 2] * x[:, 1] + (rng.random(n) < 0.05) * rng.random(n) * 4
    z = np.where(rng.random(n) < 0.3, 0.0, y * 2)
    rows = [(i, *map(float, r), float(u), float(v), i % 3) for i, (r, u, v) in enumerate(zip(x, y, z))]
    return x, {"y": y, "z": z}, np.arange(n) % 3, \
        spark.createDataFrame(rows, "id long, a double, b double, c double, y double, z double, part int")


class Plain:
    """One model, split by split."""

    def __init__(self, x, y, loss, depth, trees, values):
        self.values = values
        self.init = f = np.median(y)
        self.trees, self.gain = [], np.zeros(x.shape[1])
        f = np.full(len(y), f)
        for _ in range(trees):
            r = y - f
            delta = np.percentile(np.abs(r), 90)
            g = np.where(r > 0, 1.0, -1.0) if loss == "lad" else np.clip(r, -delta, delta)
            tree = self.grow(x, g, np.arange(len(y)), depth)
            self.fill(tree, x, r, np.arange(len(y)), loss, delta)
            self.trees.append(tree)
            f = f + 0.1 * self.apply(tree, x)

    def grow(self, x, g, rows, depth):
        best = None
        if depth:
            for j in range(x.shape[1]):
                for lo, hi in zip(self.values[j], self.values[j][1:]):
                    cut = lo + (hi - lo) / 2
                    left, right = rows[x[rows, j] <= cut], rows[x[rows, j] > cut]
                    if len(left) and len(right):
                        gain = sum(g[s].sum() ** 2 / len(s) for s in (left, right)) - g[rows].sum() ** 2 / len(rows)
                        if best is None or gain > best[0] + 1e-9:
                            best = (gain, j, cut, left, right)
        if best is None or best[0] <= 1e-9:
            return {}
        gain, j, cut, left, right = best
        self.gain[j] += gain
        return {"j": j, "cut": cut, "l": self.grow(x, g, left, depth - 1), "r": self.grow(x, g, right, depth - 1)}

    def fill(self, t, x, r, rows, loss, delta):
        if "j" in t:
            go = x[rows, t["j"]] <= t["cut"]
            self.fill(t["l"], x, r, rows[go], loss, delta)
            self.fill(t["r"], x, r, rows[~go], loss, delta)
            return
        m = np.sort(r[rows])[(len(rows) + 1) // 2 - 1]
        t["v"] = m + (np.clip(r[rows] - m, -delta, delta).mean() if loss == "huber" else 0)

    def apply(self, t, x):
        if "j" not in t:
            return np.full(len(x), t["v"])
        return np.where(x[:, t["j"]] <= t["cut"], self.apply(t["l"], x), self.apply(t["r"], x))

    def predict(self, x, trees=None):
        return self.init + 0.1 * sum((self.apply(t, x) for t in self.trees[:trees]), np.zeros(len(x)))


@pytest.mark.parametrize("block", [B.BLOCK, 150])
def test_models_match_plain_ones(spark, monkeypatch, block):
    """In one block, and in lockstep over three."""
    monkeypatch.setattr(B, "BLOCK", block)
    x, y, part, df = frame(spark)
    specs = [B.Spec("y", "huber", 2, 4), B.Spec("y", "lad", 3, 6), B.Spec("z", "huber", 3, 3, fold=1),
             B.Spec("z", "lad", 1, 21, fold=2)]
    cuts = B.binning(df, COLS)
    models = B.fit(df.repartition(3), cuts, specs, folds="part")
    got = B.predict(df, cuts, {f"m{i}": m for i, m in enumerate(models)}, ["id"]).orderBy("id").toPandas()
    staged = B.predict(df, cuts, {"m": models[1]}, ["id"], sizes=[2, 6]).orderBy("id").collect()
    for i, s in enumerate(specs):
        use = part != s.fold if s.fold is not None else part >= 0
        want = Plain(x[use], y[s.label][use], s.loss, s.depth, s.trees, [np.unique(c) for c in x.T])
        assert models[i].init == pytest.approx(want.init)
        np.testing.assert_allclose(got[f"m{i}"], want.predict(x), rtol=1e-7, atol=1e-9)
        np.testing.assert_allclose(models[i].importances(3), want.gain / want.gain.sum(), rtol=1e-6, atol=1e-9)
        if i == 1:
            np.testing.assert_allclose([r.m for r in staged], np.stack([want.predict(x, 2), want.predict(x)], 1), atol=1e-9)


def test_fit_does_not_depend_on_partitions_and_blocks(spark, monkeypatch):
    _, _, _, df = frame(spark)
    cuts = B.binning(df, COLS)
    one = B.fit(df.repartition(1), cuts, [B.Spec("y", "huber", 3, 3)])[0]
    monkeypatch.setattr(B, "BLOCK", 90)
    two = B.fit(df.repartition(7), cuts, [B.Spec("y", "huber", 3, 3)])[0]
    for a, b in zip(one.trees, two.trees):
        assert a.feature.tolist() == b.feature.tolist() and a.value.tolist() == b.value.tolist()


def test_many_values_fall_into_bins(spark):
    df = spark.range(5000).selectExpr("id * 1.0 AS a", "0.0 AS b", "CAST(NULL AS double) AS c", "id * 2.0 AS y")
    cuts = B.binning(df, COLS)
    assert 200 <= len(cuts.cuts[0]) <= 255 and cuts.cuts[1] == () and cuts.cuts[2] == ()
    model = B.fit(df, cuts, [B.Spec("y", "lad", 2, 2)])[0]
    assert model.importances(3) == [1.0, 0.0, 0.0]


def test_order_statistics_over_blocks(spark, monkeypatch):
    """Groups of many blocks, ties, groups that are not in every block; brackets of a few values."""
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.normal(size=3000), np.zeros(800), rng.choice([0.5, 0.25], 900), [7.0]])
    g = np.concatenate([np.zeros(3000), np.ones(800), np.full(900, 2), [3]]).astype(np.uint8)
    blocks = [(y[i::9].tobytes(), np.zeros(len(y[i::9]), np.int32).tobytes(), g[i::9].tobytes(), b"") for i in range(9)]
    held = spark.createDataFrame(blocks, "y binary, fold binary, bins binary, f binary").repartition(3)
    rows = B._Rows(held, ["y"], [B.Spec("y", "lad", 1, 1)], [0.0], 1)
    asked = {k: sorted({0, n // 2, (n + 1) // 2 - 1, int(0.9 * n), n - 1}) for k, n in enumerate((3000, 800, 900, 1))}
    asked[3] = [0]
    want = {(k, r): float(np.sort(y[g == k])[r]) for k, rs in asked.items() for r in rs}
    for whole, step in ((1024, 256), (4, 2), (10, 7)):
        pairs = lambda block: (block.bins[:, 0].astype(np.int64), block.y[:, 0])
        sample = {"WHOLE": whole, "STEP": step}
        for name, value in sample.items():
            monkeypatch.setattr(B, name, value)
        assert B.order_statistics(rows, pairs, asked) == want


def test_bracket_holds_the_rank():
    rng = np.random.default_rng(5)
    for _ in range(200):
        parts, every = [], []
        for _ in range(rng.integers(1, 6)):
            v = np.sort(rng.integers(0, 40, rng.integers(1, 90)).astype(float))
            at = np.unique(np.append(np.arange(0, len(v), rng.integers(1, 20)), len(v) - 1))
            parts.append((at, v[at], len(v)))
            every.append(v)
        every = np.sort(np.concatenate(every))
        for rank in rng.integers(0, len(every), 5):
            low, high = B._bracket(parts, int(rank))
            assert low <= every[rank] <= high


def test_models_of_one_task_equal_lockstep(spark, monkeypatch):
    """Rows of several blocks: a task per model by default, without a pass per level; the same trees either way."""
    rng = np.random.default_rng(5)
    rows = [(float(a), float(b), float(round(a / 7 + (b > 3) + e, 1)), int(i % 3))
            for i, (a, b, e) in enumerate(zip(rng.integers(0, 40, 600), rng.integers(0, 9, 600), rng.normal(0, 0.3, 600)))]
    df = spark.createDataFrame(rows, "a double, b double, y double, fold int")
    cuts = B.binning(df, ["a", "b"])
    specs = [B.Spec("y", loss, depth, 5, fold) for loss in ("lad", "huber") for depth in (2, 4) for fold in (None, 1)]
    monkeypatch.setattr(B, "BLOCK", 150)
    passes = []
    lockstep = B._Rows.map
    monkeypatch.setattr(B._Rows, "map", lambda self, fn: passes.append(1) or lockstep(self, fn))
    alone = B.fit(df, cuts, specs, folds="fold")
    assert not passes
    monkeypatch.setattr(B, "ALONE", 0)
    together = B.fit(df, cuts, specs, folds="fold")
    assert passes
    for one, other in zip(alone, together):
        assert (one.spec, one.init) == (other.spec, other.init)
        for s, t in zip(one.trees, other.trees):
            for part in ("feature", "cut", "value", "gain"):
                assert np.array_equal(getattr(s, part), getattr(t, part))


def test_counts_of_many_slices_are_the_same(spark, monkeypatch):
    _, _, _, df = frame(spark)
    cuts = B.binning(df, COLS)
    specs = [B.Spec("y", "huber", 3, 4), B.Spec("z", "lad", 3, 4)]
    one = B.fit(df, cuts, specs)
    monkeypatch.setattr(B, "SLICE", 37)
    many = B.fit(df, cuts, specs)
    for a, b in zip(one, many):
        for s, t in zip(a.trees, b.trees):
            assert all(np.array_equal(getattr(s, part), getattr(t, part)) for part in ("feature", "cut", "value", "gain"))
