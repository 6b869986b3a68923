"""K-nearest-neighbour regression (Euclidean, uniform weights), exact at any size.

Up to ``max_train_rows`` training rows are sent to every task once, and each
task searches them for its own query rows: no shuffle, no pair as a row.

Beyond that the training rows are dealt to spatial cells. Median cuts of a
bounded sample give the cells; each has the exact bounding box of its rows,
and a cell with many rows (many equal ones, say) is several parts with one
box. A query row first searches the part whose box is nearest, which bounds
its k-th distance, and then only the parts whose box is not farther than that.
Query rows and training rows of a part meet in a task; parts with many
visitors are served by several tasks. Boxes (two numbers per feature for every
``part_rows`` training rows) are what reaches the driver.

Inside a task the training rows lie in small groups of neighbours with their
bounding boxes (``Leaves``). Query rows that lie together search together,
nearest groups first, until the boxes left are farther than their k-th
distances; a step's memory is bounded whatever the number of rows. Ties go to
the smaller training id. Distances are accumulated feature by
feature in list order, the same left-to-right sum a SQL expression computes.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendwatch.session import materialize, share_package

NEIGHBOUR_SCHEMA = "qid long, rank long, tid long, dist double, y double"
LEAF_ROWS = 64        # training rows that are searched together
QUERIES = 64          # query rows that search together
MOST_COLUMNS = 8192   # training rows that these meet at a time: a few MB of distances
GROUPS = 32           # groups whose boxes they are measured against at a time
MAX_TRAIN_ROWS = 200_000
PART_ROWS = 20_000
SAMPLE_ROWS = 20_000  # of the training rows, for the cuts between cells
VISITORS = 20_000     # query rows that a task serves at a time


def _distances(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Squared distances, summed in the order of the features (rows of ``q`` and ``t``)."""
    d = np.zeros((q.shape[1], t.shape[1]))
    work = np.empty_like(d)
    for x, y in zip(q, t):
        np.subtract(x[:, None], y[None, :], out=work)
        np.multiply(work, work, out=work)
        d += work
    return d


class Leaves:
    """Training rows in small groups of neighbours, each with its exact bounding
    box: a query row only meets the groups whose box is not farther than its
    ``k``-th neighbour so far."""

    def __init__(self, x: np.ndarray, tid: np.ndarray, y: np.ndarray):
        finite = np.where(np.isnan(x), 0.0, x)
        self.cells = grow_cells(finite, -(-len(x) // LEAF_ROWS))
        cell = self.cells.of(finite)
        order = np.lexsort((tid, cell))
        self.x, self.tid, self.y = np.ascontiguousarray(x[order].T), tid[order], y[order]
        starts = np.flatnonzero(np.diff(cell[order], prepend=-1)) if len(x) else np.zeros(0, np.int64)
        # a cell of many rows (equal ones, say) is several groups
        self.start = np.array(sorted({int(p) for a, b in zip(starts, [*starts[1:], len(x)])
                                      for p in range(a, b, 4 * LEAF_ROWS)}), np.int64)
        self.end = np.append(self.start[1:], len(x))
        empty = np.zeros((x.shape[1], 0))
        low = np.minimum.reduceat(self.x, self.start, axis=1) if len(x) else empty
        high = np.maximum.reduceat(self.x, self.start, axis=1) if len(x) else empty
        # a box with a missing number is near everything
        self.low = np.where(np.isnan(low), -np.inf, low).T
        self.high = np.where(np.isnan(high), np.inf, high).T

    def search(self, qx: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, places of their ``k`` nearest, distances), chunk by chunk of query rows that lie together."""
        kk = min(k, len(self.tid))
        if not kk or not len(qx):
            return
        nan = np.isnan(qx).any(axis=1)
        cell = np.where(nan, -1, self.cells.of(np.where(np.isnan(qx), 0.0, qx)))
        order = np.lexsort((*qx.T[::-1], cell))
        for s in range(0, len(order), QUERIES):
            rows = order[s:s + QUERIES]
            q = np.ascontiguousarray(qx[rows].T)
            yield rows, *self._some(q, kk, bool(nan[rows].any()))

    def _some(self, q: np.ndarray, kk: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        x = np.where(np.isnan(q), 0.0, q)
        # no query row is nearer to a group than the box of all of them
        near = np.zeros(len(self.low)) if whole else _gaps(x.min(axis=1), x.max(axis=1), self.low, self.high)
        groups = np.argsort(near, kind="stable")
        near = near[groups]
        todo, gaps = np.zeros(0, np.int64), np.zeros((q.shape[1], 0))  # groups whose distances from every row are known
        places = np.zeros((q.shape[1], 0), np.int64)
        held = np.zeros((q.shape[1], 0))
        while True:
            if held.shape[1] == kk:
                limit = held[:, -1] * (1 + 1e-12)
                groups = groups[:np.searchsorted(near, limit.max(), side="right")] if not np.isnan(limit).any() else groups
                near = near[:len(groups)]
                reach = ~(gaps > limit[:, None]).all(axis=0)
                todo, gaps = todo[reach], gaps[:, reach]
            if not len(todo):
                if not len(groups):
                    return places, held
                todo, groups, near = groups[:GROUPS], groups[GROUPS:], near[GROUPS:]
                gaps = np.zeros((q.shape[1], len(todo))) if whole else _box_distances(x.T, self.low[todo], self.high[todo])
                order = np.argsort(gaps.min(axis=0), kind="stable")
                todo, gaps = todo[order], gaps[:, order]
                continue
            sizes = np.cumsum((self.end - self.start)[todo])
            n = max(1, int(np.searchsorted(sizes, MOST_COLUMNS, side="right")))
            if held.shape[1] < kk:  # first only as many as give a bound
                n = min(n, 1 + int(np.searchsorted(sizes, max(kk, 4 * LEAF_ROWS))))
            at = np.concatenate([np.arange(self.start[g], self.end[g]) for g in todo[:n]])
            todo, gaps = todo[n:], gaps[:, n:]
            d = np.concatenate([held, _distances(q, self.x[:, at])], axis=1)
            tids = np.concatenate([places, np.broadcast_to(at, (len(d), len(at)))], axis=1)
            best = _pick_rows(d, self.tid[tids], min(kk, d.shape[1]))
            held, places = np.take_along_axis(d, best, axis=1), np.take_along_axis(tids, best, axis=1)


def _gaps(low: np.ndarray, high: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Squared distances of a box to boxes."""
    gap = np.maximum(np.maximum(lows - high, low - highs), 0)
    return (gap * gap).sum(axis=1)


def _pick_rows(d: np.ndarray, tid: np.ndarray, kk: int) -> np.ndarray:
    """Places of the ``kk`` smallest of every row of ``d`` (ties by id), in order."""
    limit = np.partition(d, kk - 1, axis=1)[:, kk - 1]
    row, col = np.nonzero(~(d > limit[:, None]))
    order = np.lexsort((tid[row, col], d[row, col], row))
    row, col = row[order], col[order]
    rank = np.arange(len(row)) - np.searchsorted(row, np.arange(len(d)))[row]
    return col[rank < kk].reshape(len(d), kk)


def _nearest(qx: np.ndarray, qid: np.ndarray, leaves: Leaves, k: int) -> Iterator[pd.DataFrame]:
    """The ``k`` nearest training rows of every query row."""
    for rows, near, d in leaves.search(qx, k):
        kk, flat = near.shape[1], near.reshape(-1)
        yield pd.DataFrame({"qid": np.repeat(qid[rows], kk), "rank": np.tile(np.arange(1, kk + 1), len(rows)),
                            "tid": leaves.tid[flat], "dist": d.reshape(-1), "y": leaves.y[flat]})


def nearest_neighbours(query: DataFrame, train: DataFrame, id_col: str, features: Sequence[str], target: str, k: int,
                       max_train_rows: int = MAX_TRAIN_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """(qid, rank, tid, dist, y): the ``k`` nearest training rows of every
    query row, rank 1 = nearest, ties broken by training id."""
    return _found(query, train, id_col, features, target, k, False, max_train_rows, part_rows)


def _found(query: DataFrame, train: DataFrame, id_col: str, features: Sequence[str], target: str, k: int, sums: bool,
           max_train_rows: int = MAX_TRAIN_ROWS, part_rows: int = PART_ROWS) -> DataFrame:
    """The neighbours; with ``sums`` (qid, total, n) of their targets, a row or more per query row."""
    share_package(query.sparkSession)
    feats = list(features)
    cast = [F.col(c).cast("double").alias(c) for c in feats]
    t = train.select(F.col(id_col).cast("long").alias("tid"), *cast, F.col(target).cast("double").alias("y"))
    q = query.select(F.col(id_col).cast("long").alias("qid"), *cast)
    if t.limit(max_train_rows + 1).count() > max_train_rows:
        near = _by_cells(q, materialize(t), feats, k, part_rows)
        return near.groupBy("qid").agg(F.sum("y").alias("total"), F.count("y").alias("n")) if sums else near
    rows = t.toPandas().sort_values("tid", ignore_index=True)  # at most max_train_rows
    model = query.sparkSession.sparkContext.broadcast(
        (rows[feats].to_numpy(np.float64), rows["tid"].to_numpy(np.int64), rows["y"].to_numpy(np.float64)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaves = None
        for b in batches:
            leaves = leaves or Leaves(*model.value)
            x, qid = b[feats].to_numpy(np.float64), b["qid"].to_numpy(np.int64)
            if not sums:
                yield from _nearest(x, qid, leaves, k)
                continue
            total, n = np.zeros(len(x)), np.zeros(len(x), np.int64)
            for at, near, _ in leaves.search(x, k):
                y = leaves.y[near]
                total[at] = np.cumsum(np.nan_to_num(y), axis=1)[:, -1]  # in order of rank
                n[at] = (~np.isnan(y)).sum(axis=1)
            yield pd.DataFrame({"qid": qid, "total": total, "n": n}) if len(leaves.tid) else pd.DataFrame(
                {"qid": qid[:0], "total": total[:0], "n": n[:0]})

    return q.mapInPandas(run, "qid long, total double, n long" if sums else NEIGHBOUR_SCHEMA)


# ------------------------------------------------------------------- spatial cells

@dataclass
class Cells:
    """A tree of cuts (children of node i: ``below[i]`` and ``above[i]``, a cell number as -1 - cell)."""

    feature: np.ndarray
    cut: np.ndarray
    below: np.ndarray
    above: np.ndarray

    def of(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), dtype=np.int64)
        if not len(self.feature):
            return at
        while (inner := at >= 0).any():
            node = at[inner]
            low = x[inner, self.feature[node]] <= self.cut[node]
            at[inner] = np.where(low, self.below[node], self.above[node])
        return -1 - at


def grow_cells(sample: np.ndarray, cells: int) -> Cells:
    """About ``cells`` cells of equal shares of the sample, cut at medians of the widest feature."""
    least = max(1, len(sample) // max(1, cells))
    nodes: list[list] = []
    n_cells = 0

    def grow(rows: np.ndarray) -> int:
        nonlocal n_cells
        x = sample[rows]
        spread = x.max(axis=0) - x.min(axis=0) if len(x) else np.zeros(sample.shape[1])
        if len(rows) > least and spread.max(initial=0) > 0:
            j = int(spread.argmax())
            cut = float(np.median(x[:, j]))
            if cut >= x[:, j].max():  # more than half are at the top: cut below it
                cut = float(x[x[:, j] < cut, j].max())
            me = len(nodes)
            nodes.append([j, cut, 0, 0])
            nodes[me][2:] = grow(rows[x[:, j] <= cut]), grow(rows[x[:, j] > cut])
            return me
        n_cells += 1
        return -n_cells

    grow(np.arange(len(sample)))
    f, c, lo, hi = zip(*nodes) if nodes else ((),) * 4
    return Cells(np.array(f, np.int64), np.array(c, np.float64), np.array(lo, np.int64), np.array(hi, np.int64))


def _box_distances(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of every row to every box."""
    d = np.zeros((len(x), len(low)))
    for j in range(x.shape[1]):
        gap = np.maximum(np.maximum(low[None, :, j] - x[:, j:j + 1], x[:, j:j + 1] - high[None, :, j]), 0)
        d = d + gap * gap
    return d


def _by_cells(q: DataFrame, t: DataFrame, feats: list[str], k: int, part_rows: int) -> DataFrame:
    spark = t.sparkSession
    sample = t.orderBy(F.xxhash64("tid"), "tid").limit(SAMPLE_ROWS).select(*feats).toPandas().to_numpy(np.float64)
    n = t.count()
    cells = spark.sparkContext.broadcast(grow_cells(sample, -(-n // part_rows)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(cell=cells.value.of(b[feats].to_numpy(np.float64)))

    numbers = ", ".join(f"`{c}` double" for c in feats)
    t = materialize(t.mapInPandas(place, f"tid long, {numbers}, y double, cell long"))
    boxes = t.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(feats)],
                                  *[F.max(c).alias(f"hi{i}") for i, c in enumerate(feats)]).toPandas().sort_values("cell")
    parts = -(-boxes["n"].to_numpy() // part_rows)  # per cell
    first = dict(zip(boxes["cell"], np.cumsum(parts) - parts))
    many = dict(zip(boxes["cell"], parts))
    low, high = (np.repeat(boxes[[f"{s}{i}" for i in range(len(feats))]].to_numpy(np.float64), parts, axis=0)
                 for s in ("lo", "hi"))
    handed = spark.sparkContext.broadcast((first, many, low, high))

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            one, all_ = handed.value[:2]
            cell = b.pop("cell").to_numpy()
            spread = (b["tid"].to_numpy(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
            yield b.assign(part=[one[c] + s % all_[c] for c, s in zip(cell, spread)])

    t = materialize(t.mapInPandas(number, f"tid long, {numbers}, y double, part long"))

    def own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 4096):
                part = b.iloc[s:s + 4096]
                yield part.assign(part=_box_distances(part[feats].to_numpy(np.float64), *handed.value[2:]).argmin(axis=1))

    q = materialize(q)
    visits = f"qid long, {numbers}, part long"
    near = materialize(_search(q.mapInPandas(own, visits), t, feats, k))
    reach = near.groupBy("qid").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("reach"))

    def others(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 1024):
                part = b.iloc[s:s + 1024]
                d = _box_distances(part[feats].to_numpy(np.float64), *handed.value[2:])
                limit = part.pop("reach").fillna(np.inf).to_numpy(np.float64) * (1 + 1e-12)
                wanted = d <= limit[:, None]
                wanted[np.arange(len(d)), d.argmin(axis=1)] = False
                row, to = np.nonzero(wanted)
                yield part.iloc[row].assign(part=to)

    more = q.join(reach, "qid", "left").select("qid", *feats, "reach").mapInPandas(others, visits)
    every = near.unionByName(_search(more, t, feats, k))
    best = Window.partitionBy("qid").orderBy("dist", "tid")
    return every.withColumn("rank", F.row_number().over(best).cast("long")).where(F.col("rank") <= k).select(
        "qid", "rank", "tid", "dist", "y")


def _search(visits: DataFrame, t: DataFrame, feats: list[str], k: int) -> DataFrame:
    """The ``k`` nearest training rows of each visited part for each of ``visits`` (qid, features, part)."""
    visits = materialize(visits)
    tasks = (visits.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / VISITORS).cast("int").alias("tasks")))
    asked = visits.join(tasks, "part").withColumn("task", F.pmod(F.xxhash64("qid"), F.col("tasks")).cast("int")).drop("tasks")
    served = t.join(tasks, "part").withColumn("task", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).drop("tasks")

    def run(qs: pd.DataFrame, ts: pd.DataFrame) -> pd.DataFrame:
        leaves = Leaves(ts[feats].to_numpy(np.float64), ts["tid"].to_numpy(np.int64), ts["y"].to_numpy(np.float64))
        out = list(_nearest(qs[feats].to_numpy(np.float64), qs["qid"].to_numpy(np.int64), leaves, k))
        return pd.concat(out) if out else pd.DataFrame({c.split()[0]: [] for c in NEIGHBOUR_SCHEMA.split(", ")})

    return asked.groupBy("part", "task").cogroup(served.groupBy("part", "task")).applyInPandas(run, NEIGHBOUR_SCHEMA)


def knn_predict(query: DataFrame, train: DataFrame, id_col: str, features: Sequence[str],
                target: str, k: int) -> DataFrame:
    """(id, prediction): mean target of the k nearest training rows."""
    found = _found(query, train, id_col, features, target, k, True)
    return found.groupBy(F.col("qid").alias(id_col)).agg(F.try_divide(F.sum("total"), F.sum("n")).alias("prediction"))


def knn_k_sweep(query: DataFrame, train: DataFrame, id_col: str, features: Sequence[str],
                target: str, k_max: int) -> DataFrame:
    """(k, rmse, r2) for k = 1..k_max from one neighbour search: the prediction
    for k is the running mean over the first k neighbours."""
    nn = nearest_neighbours(query, train, id_col, features, target, k_max)
    run = Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    preds = nn.withColumn("pred", F.avg("y").over(run)).select("qid", F.col("rank").alias("k"), "pred")
    actual = query.select(F.col(id_col).alias("qid"), F.col(target).cast("double").alias("actual"))
    err = F.col("actual") - F.col("pred")
    se = preds.join(actual, "qid").withColumn("se", err * err)
    sst = F.var_pop("actual") * F.count("actual")
    return se.groupBy("k").agg(F.sqrt(F.avg("se")).alias("rmse"),
                               (F.lit(1.0) - F.try_divide(F.sum("se"), sst)).alias("r2"))
