"""Nearest neighbours by cells, beyond the bound up to which the model is sent to the tasks."""

import numpy as np
import pytest

from sendwatch.operators import knn

FEATS = ["a", "b", "c"]


def table(spark, x, y, shift=0):
    rows = [(i + shift, *map(float, r), float(v)) for i, (r, v) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, a double, b double, c double, y double")


def found(df):
    return [tuple(r) for r in df.orderBy("qid", "rank").collect()]


@pytest.mark.parametrize("kind", ["spread", "lumps", "one point"])
def test_cells_equal_the_whole_search(spark, kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 3)) * [1, 50, 0.01]
    q = np.concatenate([rng.normal(size=(100, 3)) * [1, 50, 0.01], [[1e6, 0, 0]]])
    if kind == "lumps":  # a third of all rows are one point, others lie on a coarse grid: ties everywhere
        x, q = np.round(x * [1, 0.05, 100]), np.round(q * [1, 0.05, 100])
        x[:300] = 1.0
        q[:40] = 1.0
    if kind == "one point":
        x[:] = q[:] = 2.5
    train, query = table(spark, x, rng.random(900)).repartition(4), table(spark, q, rng.random(101), 5000).repartition(3)
    whole = knn.nearest_neighbours(query, train, "id", FEATS, "y", 7)
    cells = knn.nearest_neighbours(query, train, "id", FEATS, "y", 7, max_train_rows=100, part_rows=40)
    assert found(cells) == found(whole)


def test_far_cells_are_not_visited(spark, monkeypatch):
    """Of 25 or more parts a query row visits a few."""
    rng = np.random.default_rng(1)
    x = rng.random((1000, 3))
    train, query = table(spark, x, x[:, 0]), table(spark, rng.random((200, 3)), np.zeros(200), 5000)
    visits = []
    search = knn._search
    monkeypatch.setattr(knn, "_search", lambda v, *a: (visits.append(v.count()), search(v, *a))[1])
    out = knn.nearest_neighbours(query, train, "id", FEATS, "y", 3, max_train_rows=10, part_rows=40)
    assert out.count() == 600 and visits[0] == 200
    assert sum(visits) < 200 * 25 * 0.4


def test_fewer_rows_than_k_and_none(spark):
    x = np.arange(12.0).reshape(4, 3)
    train, query = table(spark, x, [1, 2, 3, 4]), table(spark, x[:2], [0, 0], 50)
    assert knn.nearest_neighbours(query, train, "id", FEATS, "y", 9, max_train_rows=2, part_rows=1).count() == 8
    assert knn.nearest_neighbours(query, train.limit(0), "id", FEATS, "y", 9).count() == 0
    assert knn.nearest_neighbours(query.limit(0), train, "id", FEATS, "y", 9, max_train_rows=2, part_rows=1).count() == 0


@pytest.mark.parametrize("kind", ["spread", "ties", "missing"])
def test_leaves_equal_brute_force(kind):
    """The groups of a task give the rows of a plain search, ties by id."""
    rng = np.random.default_rng(3)
    x, q = rng.normal(size=(2500, 4)) * [9, 1, 1, 0.1], rng.normal(size=(150, 4)) * [9, 1, 1, 0.1]
    if kind == "ties":
        x, q = np.round(x), np.round(q)
        x[:900] = 1.0
    if kind == "missing":
        x[::50, 2], q[::30, 1] = np.nan, np.nan
    tid = rng.permutation(2500) * 3
    leaves = knn.Leaves(x, tid, x[:, 0])
    seen = 0
    for rows, near, dist in leaves.search(q, 20):
        for r, places, found in zip(rows, near, dist):
            d = np.zeros(len(x))
            for j in range(4):
                d = d + (q[r, j] - x[:, j]) ** 2
            want = np.lexsort((tid, d))[:20]
            if not np.isnan(d[want]).any():
                assert leaves.tid[places].tolist() == tid[want].tolist() and found.tolist() == d[want].tolist()
            seen += 1
    assert seen == len(q)


def test_a_search_holds_few_distances(monkeypatch):
    """No step's matrix grows with the training rows, and far groups are not met."""
    rng = np.random.default_rng(5)
    x = rng.random((60_000, 3))
    sizes, distances = [], knn._distances
    monkeypatch.setattr(knn, "_distances", lambda q, t: (sizes.append(q.shape[1] * t.shape[1]), distances(q, t))[1])
    got = list(knn.Leaves(x, np.arange(len(x)), x[:, 0]).search(rng.random((640, 3)), 10))
    assert sum(len(r) for r, _, _ in got) == 640
    assert max(sizes) <= knn.QUERIES * (knn.MOST_COLUMNS + 4 * knn.LEAF_ROWS)
    assert sum(sizes) < 640 * len(x) * 0.2


def test_prediction_is_the_mean_of_the_neighbours(spark):
    rng = np.random.default_rng(6)
    train, query = table(spark, rng.random((300, 3)), rng.random(300)), table(spark, rng.random((40, 3)), np.zeros(40), 900)
    nn = knn.nearest_neighbours(query, train, "id", FEATS, "y", 5).toPandas().groupby("qid")["y"].mean()
    got = {r.id: r.prediction for r in knn.knn_predict(query, train, "id", FEATS, "y", 5).collect()}
    assert got == pytest.approx(nn.to_dict()) and len(got) == 40


def test_groups_far_from_all_query_rows_are_not_measured(monkeypatch):
    """Query rows that lie together meet the boxes near their own box only."""
    rng = np.random.default_rng(5)
    x = rng.random((20_000, 2))
    leaves = knn.Leaves(x, np.arange(len(x)), x[:, 0])
    measured = []
    plain = knn._box_distances
    monkeypatch.setattr(knn, "_box_distances", lambda q, low, high: (measured.append(len(low)), plain(q, low, high))[1])
    q = rng.random((knn.QUERIES, 2)) * 0.01
    rows, near, d = next(leaves.search(q, 5))
    whole = ((q[rows][:, None, :] - x[None]) ** 2).sum(axis=2)
    assert (leaves.tid[near] == np.lexsort((np.broadcast_to(np.arange(len(x)), whole.shape), whole), axis=1)[:, :5]).all()
    assert sum(measured) < len(leaves.start) / 4
