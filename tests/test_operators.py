"""Operators against brute force on small literal frames."""

import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sendwatch.operators import knn, stats
from sendwatch.operators.shares import frequency_with_share
from sendwatch.operators.tiles import tile_cutpoints
from sendwatch.operators.top1 import latest_per_group, mode_per_group


def test_mode_ties_go_to_smallest_value_nulls_last(spark):
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 3), (1, None, 3), (2, None, 5), (2, "z", 1)],
                               "k long, v string, ct long")
    got = {r.k: (r.v, r.ct) for r in mode_per_group(df, ["k"], "v").collect()}
    assert got == {1: ("a", 3), 2: (None, 5)}


def test_latest_per_group_breaks_ties_by_second_key(spark):
    df = spark.createDataFrame([(1, 10, 1, "x"), (1, 10, 2, "y"), (1, 5, 9, "z"), (2, None, 1, "n")],
                               "k long, t long, id long, d string")
    got = {r.k: r.d for r in latest_per_group(df, ["k"], ["t", "id"], ["d"]).collect()}
    assert got == {1: "y", 2: "n"}


@pytest.mark.parametrize("n", [7, 100, 101, 250, 999])
def test_tile_cutpoints_match_ntile(spark, n):
    rnd = random.Random(n)
    vals = [rnd.randint(0, 40) for _ in range(n)]
    df = spark.createDataFrame([(v,) for v in vals], "v long")
    tiles = (1, 25, 50, 75, 100)
    got = sorted(r.v for r in tile_cutpoints(df, "v", tiles).collect())
    w = Window.orderBy("v")
    brute = (df.withColumn("t", F.ntile(100).over(w)).where(F.col("t").isin(*tiles))
             .select("v").distinct().collect())
    assert got == sorted(r.v for r in brute)


def test_share_sums_to_one(spark):
    df = spark.createDataFrame([(x % 3,) for x in range(10)], "c long")
    rows = frequency_with_share(df, ["c"], "ct", "perc").collect()
    assert sum(r.ct for r in rows) == 10
    assert abs(sum(r.perc for r in rows) - 1.0) < 1e-12


def test_histogram_puts_max_in_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (0.5,), (1.0,), (1.0,)], "x double")
    got = {r.bin: r.n for r in stats.histogram(df, "x", 4).collect()}
    assert got == {1: 1, 3: 1, 4: 2}
    ranged = {r.bin: r.n for r in stats.histogram(df, "x", 2, 0.0, 0.5).collect()}
    assert ranged == {1: 1, 2: 1}


def test_corr_long_matches_numpy_and_nulls_constant(spark):
    rnd = np.random.default_rng(3)
    a = rnd.normal(size=50)
    b = 2 * a + rnd.normal(size=50)
    df = spark.createDataFrame([(float(x), float(y), 1.0) for x, y in zip(a, b)], "a double, b double, c double")
    got = {(r.col_a, r.col_b): r.corr for r in stats.corr_long(df, ["a", "b", "c"]).collect()}
    assert got[("a", "b")] == pytest.approx(np.corrcoef(a, b)[0, 1], abs=1e-6)
    assert got[("a", "a")] == pytest.approx(1.0)
    assert got[("a", "c")] is None


def test_knn_matches_numpy_brute_force(spark):
    rnd = np.random.default_rng(7)
    tr = rnd.integers(0, 5, size=(60, 3)).astype(float)   # many distance ties
    ty = rnd.random(60)
    q = rnd.integers(0, 5, size=(25, 3)).astype(float)
    train = spark.createDataFrame([(i, *map(float, tr[i]), float(ty[i])) for i in range(60)],
                                  "id long, f0 double, f1 double, f2 double, y double")
    query = spark.createDataFrame([(100 + i, *map(float, q[i]), 0.0) for i in range(25)],
                                  "id long, f0 double, f1 double, f2 double, y double")
    k = 7
    nn = knn.nearest_neighbours(query, train, "id", ["f0", "f1", "f2"], "y", k)
    got = {}
    for r in nn.collect():
        got.setdefault(r.qid, []).append((r.rank, r.tid))
    for i in range(25):
        d = ((q[i][None, :] - tr) ** 2).sum(axis=1)
        order = sorted(range(60), key=lambda j: (d[j], j))[:k]
        assert [t for _, t in sorted(got[100 + i])] == order


def test_knn_sweep_first_k_is_nearest_label(spark):
    train = spark.createDataFrame([(1, 0.0, 1.0), (2, 10.0, 3.0)], "id long, f double, y double")
    query = spark.createDataFrame([(9, 1.0, 2.0)], "id long, f double, y double")
    rows = {r.k: r.rmse for r in knn.knn_k_sweep(query, train, "id", ["f"], "y", 2).collect()}
    assert rows[1] == pytest.approx(1.0) and rows[2] == pytest.approx(0.0)


@pytest.mark.parametrize("n,buckets", [(1, 4), (7, 4), (250, 8), (999, 16)])
def test_exact_quantiles_match_numpy(spark, n, buckets):
    from sendwatch.operators.ranks import exact_quantiles

    rnd = np.random.default_rng(n)
    vals = np.concatenate([rnd.integers(0, 30, size=n).astype(float), np.zeros(n // 3)])  # hot value 0
    df = spark.createDataFrame([(float(v),) for v in vals] + [(None,)], "v double")
    qs = [0.0, 0.25, 0.5, 0.75, 0.85, 1.0]
    row = exact_quantiles(df, [], "v", qs, buckets=buckets).first()
    for i, q in enumerate(qs):
        assert row[f"q_{i}"] == pytest.approx(np.percentile(vals, 100 * q), abs=1e-9)


def test_value_ranks_cover_all_rows_per_key(spark):
    from sendwatch.operators.ranks import value_ranks

    rows = [("a", x % 5) for x in range(40)] + [("b", x % 3) for x in range(9)] + [("b", None)]
    df = spark.createDataFrame(rows, "k string, v long")
    got = {}
    for r in value_ranks(df, ["k"], "v", buckets=3).collect():
        got.setdefault(r.k, []).append((r.start, r.end, r.n, r.n_null))
    for k, spans in got.items():
        spans.sort()
        assert spans[0][0] == 1 and spans[-1][1] == spans[0][2]
        assert all(a[1] + 1 == b[0] for a, b in zip(spans, spans[1:]))
    assert got["b"][0][3] == 1 and got["a"][0][3] == 0
