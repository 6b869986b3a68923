"""Gradient boosting with absolute (LAD) and Huber loss as Spark jobs, many
models in lockstep.

Spark's own boosters know squared and absolute loss, with mean leaf values.
Here a tree is grown level by level on a matrix of binned features that is
written once and shared by all models: losses, depths, targets and folds of a
grid take the same passes over the rows. The matrix is held as blocks of
``BLOCK`` rows, so a pass is a map over blocks, and what reaches the driver is
a summary per block. Per level that is the sums of gradients per (model, node,
feature, bin), from which the best splits are chosen.

Leaf values (medians; medians plus the mean clipped deviation for Huber) and
Huber's clipping threshold are exact order statistics, of all leaves of all
models at once: a block sends every ``STEP``-th of a leaf's sorted residuals,
which brackets the wanted value between two of them whatever the other blocks
hold; a second pass counts what lies below the bracket and sends the distinct
residuals inside it, of which there are at most some ``STEP`` per block.

Trees are node tables (heap order: the children of i are 2i + 1 and 2i + 2).
Boosting is sequential, so the first n trees of a model are the model of n
trees: every size of a grid is scored from one fit.

Gradients are whole multiples of a small unit and are summed as integers, so
a fit does not depend on how rows are dealt. State (the predictions so far) is
written out every ``CUT`` trees; passes in between apply the pending trees.
All rows are fitted. In lockstep the summaries of all blocks meet on the driver,
whose share grows with the blocks; a task per model (up to ``ALONE`` rows) sends
it the trees only.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.session import materialize, share_package

MAX_BINS = 256
BLOCK = 1 << 16
ALONE = 1 << 22        # rows up to which a model is boosted in one task
SLICE = 1 << 18        # rows that such a task counts at a time
STEP = 256             # a block sends every STEP-th order statistic of a group
WHOLE = 1024           # or all, up to so many
SUMMARY_CELLS = 1 << 24  # (node, feature, bin) cells of all blocks that a pass may send
CUT = 20
UNIT_BITS = 40         # gradients are multiples of 2**-40 of the largest residual: sums of 2**22 rows fit 62 bits
ALPHA = 0.9            # Huber: share of residuals that are not clipped
RATE = 0.1


@dataclass(frozen=True)
class Spec:
    """One model: ``label`` column, loss ``lad`` or ``huber``, tree depth and
    count; ``fold``: the rows of this fold are left out."""

    label: str
    loss: str
    depth: int
    trees: int
    fold: int | None = None


@dataclass
class Tree:
    feature: np.ndarray  # -1 where the path ends
    cut: np.ndarray      # bins up to it go to the left child
    value: np.ndarray
    gain: np.ndarray

    @classmethod
    def stump(cls, depth: int) -> Tree:
        n = (2 << depth) - 1
        return cls(np.full(n, -1, np.int16), np.zeros(n, np.int16), np.zeros(n), np.zeros(n))

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        """Node where each row's path ends."""
        at = np.zeros(len(bins), dtype=np.int64)
        rows = np.arange(len(bins))
        while True:
            f = self.feature[at]
            go = f >= 0
            if not go.any():
                return at
            right = bins[rows, np.maximum(f, 0)] > self.cut[at]
            at = np.where(go, 2 * at + 1 + right, at)


@dataclass
class Model:
    spec: Spec
    init: float
    trees: list[Tree] = field(default_factory=list)

    def importances(self, n_features: int, trees: int | None = None) -> list[float]:
        """Share of every feature in the gains of all splits."""
        out = np.zeros(n_features)
        for t in self.trees[:trees]:
            np.add.at(out, t.feature[t.feature >= 0], t.gain[t.feature >= 0])
        return (out / out.sum() if out.sum() else out).tolist()


@dataclass(frozen=True)
class Binning:
    """Cut points per feature: the bin of a value is the number of cuts below it."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    def bins(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        return np.stack([np.searchsorted(np.array(c), x, side="left") for c, x in zip(self.cuts, columns)],
                        axis=1).astype(np.uint8)


def binning(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS) -> Binning:
    """Cuts halfway between neighbouring values; between quantiles where a
    feature has more values than bins (``max_bins`` numbers per feature reach the driver)."""
    qs = [i / max_bins for i in range(max_bins + 1)]
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), qs, 100 * max_bins).alias(f"q{i}")
                   for i, c in enumerate(features)]).first()
    few = _distinct(df, features, max_bins)
    cuts = []
    for i, _ in enumerate(features):
        values = few.get(i) or sorted(set(row[f"q{i}"] or ()))
        cuts.append(tuple(a + (b - a) / 2 for a, b in zip(values, values[1:])))
    return Binning(tuple(features), tuple(c[:max_bins - 1] for c in cuts))


def _distinct(df: DataFrame, features: Sequence[str], most: int) -> dict[int, list[float]]:
    """The values of the features that have at most ``most`` of them."""
    cells = df.select(F.posexplode(F.array(*[F.col(c).cast("double") for c in features])).alias("j", "x")).distinct()
    few = cells.groupBy("j").agg(F.count("x").alias("n")).where(F.col("n") <= most)
    out: dict[int, list[float]] = {}
    for r in cells.join(few, "j").select("j", "x").where("x IS NOT NULL").collect():
        out.setdefault(r["j"], []).append(r["x"])
    return {j: sorted(v) for j, v in out.items()}


def _matrix(b: pa.RecordBatch, column: str, width: int, dtype: type) -> np.ndarray:
    data = b.column(column)
    joined = b"".join(data.to_pylist())
    return np.frombuffer(joined, dtype=dtype).reshape(len(data), width)


def binned(df: DataFrame, cuts: Binning, keep: Sequence[str]) -> DataFrame:
    """Columns ``keep`` of ``df`` and its bins, a byte per feature."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import BinaryType, StructField, StructType

    share_package(df.sparkSession)
    schema = StructType([*(df.schema[k] for k in keep), StructField("bins", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [b.column(f"x{i}").to_numpy(zero_copy_only=False) for i in range(len(cuts.features))]
            rows = [r.tobytes() for r in cuts.bins(x)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(rows, pa.binary())],
                                             schema=arrow)

    x = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"x{i}") for i, c in enumerate(cuts.features)]
    return df.select(*keep, *x).mapInArrow(run, schema)


@dataclass(frozen=True)
class _Block:
    """Training rows as arrays: labels, folds, bins, and the predictions of all models."""

    y: np.ndarray
    fold: np.ndarray
    bins: np.ndarray
    f: np.ndarray
    labels: tuple[str, ...]
    specs: tuple[Spec, ...]

    def residuals(self, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows that model m learns from, their residuals)."""
        spec = self.specs[m]
        rows = np.arange(len(self.y)) if spec.fold is None else np.flatnonzero(self.fold != spec.fold)
        return rows, self.y[rows, self.labels.index(spec.label)] - self.f[rows, m]


def _blocks(df: DataFrame, labels: Sequence[str], n: int) -> DataFrame:
    """(y, fold, bins, f): a row per block of rows, without predictions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0

        def block() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            y = np.stack([t.column(c).to_numpy() for c in labels], axis=1)
            fold = t.column("fold").to_numpy().astype(np.int32)
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([x], pa.binary()) for x in (y.tobytes(), fold.tobytes(),
                                                      b"".join(t.column("bins").to_pylist()), b"")],
                ["y", "fold", "bins", "f"])

        for b in batches:
            held.append(b)
            size += b.num_rows
            if size >= BLOCK:
                yield block()
                size = 0
        if size:
            yield block()

    return materialize(df.repartition(max(1, -(-n // BLOCK))).mapInArrow(
        run, "y binary, fold binary, bins binary, f binary"))


class _Rows:
    """The training rows of all models and their predictions so far."""

    def __init__(self, held: DataFrame, labels: Sequence[str], specs: Sequence[Spec], init: Sequence[float], width: int):
        self.held, self.pending = held, []
        self.shape = (tuple(labels), tuple(specs), np.array(init, np.float64), width)

    def _reader(self) -> Callable[[pa.RecordBatch], Iterator[_Block]]:
        pending, (labels, specs, init, width) = self.pending[:], self.shape

        def read(batch: pa.RecordBatch) -> Iterator[_Block]:
            for y, fold, bins, f in zip(*(batch.column(c).to_pylist() for c in ("y", "fold", "bins", "f"))):
                fold = np.frombuffer(fold, np.int32)
                bins = np.frombuffer(bins, np.uint8).reshape(len(fold), width)
                f = (np.frombuffer(f, np.float64).reshape(len(fold), len(specs)).copy() if f
                     else np.repeat(init[None, :], len(fold), axis=0))
                for trees in pending:
                    for m, t in trees.items():
                        f[:, m] += RATE * t.value[t.leaf(bins)]
                yield _Block(np.frombuffer(y, np.float64).reshape(len(fold), len(labels)), fold, bins, f, labels, specs)

        return read

    def map(self, fn: Callable[[_Block], Any]) -> list[Any]:
        """``fn`` of every block."""
        read = self._reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for block in read(b):
                    yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fn(block))], pa.binary())], ["out"])

        return [pickle.loads(r["out"]) for r in self.held.mapInArrow(run, "out binary").collect()]

    def add(self, trees: dict[int, Tree]) -> None:
        self.pending.append(trees)
        if len(self.pending) < CUT:
            return
        read = self._reader()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = [block.f.tobytes() for block in read(b)]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("y", "fold", "bins")), pa.array(f, pa.binary())],
                                                 ["y", "fold", "bins", "f"])

        self.held = materialize(self.held.mapInArrow(run, "y binary, fold binary, bins binary, f binary"))
        self.pending = []


# ------------------------------------------------------------------- order statistics

def _grouped(groups: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(group, its values in order)."""
    order = np.lexsort((values, groups))
    groups, values = groups[order], values[order]
    cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])) if len(groups) else []
    for a, b in zip(cuts, [*cuts[1:], len(groups)]):
        yield int(groups[a]), values[a:b]


def _bracket(parts: list[tuple[np.ndarray, np.ndarray, int]], rank: int) -> tuple[float, float]:
    """Values between which (inclusive) the value of ``rank`` lies. ``parts``:
    per block, places in its sorted values, the values there, and their number."""
    x = np.unique(np.concatenate([v for _, v, _ in parts]))
    most_below, least_upto = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    for place, v, n in parts:
        most_below += np.append(place, n)[np.searchsorted(v, x, side="left")]
        least_upto += np.append(0, place + 1)[np.searchsorted(v, x, side="right")]
    return float(x[most_below <= rank][-1]), float(x[least_upto > rank][0])


def order_statistics(rows: _Rows, pairs: Callable[[_Block], tuple[np.ndarray, np.ndarray]],
                     ranks: dict[int, list[int]]) -> dict[tuple[int, int], float]:
    """{(group, rank): value} for the ranks (from 0) asked of each group;
    ``pairs`` gives a block's groups and values."""

    def sample(block: _Block) -> dict[int, tuple]:
        out = {}
        for g, v in _grouped(*pairs(block)):
            if g in ranks:
                at = np.arange(len(v)) if len(v) <= WHOLE else np.append(np.arange(0, len(v) - 1, STEP), len(v) - 1)
                out[g] = (at, v[at], len(v))
        return out

    found = rows.map(sample)
    out, brackets = {}, {}
    for g, wanted in ranks.items():
        parts = [f[g] for f in found if g in f]
        if all(len(at) == n for at, _, n in parts):
            whole = np.sort(np.concatenate([v for _, v, _ in parts]))
            out |= {(g, r): float(whole[r]) for r in wanted}
        else:
            brackets[g] = {r: _bracket(parts, r) for r in wanted}
    if not brackets:
        return out

    def inside(block: _Block) -> dict[tuple[int, int], tuple]:
        got = {}
        for g, v in _grouped(*pairs(block)):
            for r, (low, high) in brackets.get(g, {}).items():
                a, b = np.searchsorted(v, low, side="left"), np.searchsorted(v, high, side="right")
                got[g, r] = (int(a), *np.unique(v[a:b], return_counts=True))
        return got

    found = rows.map(inside)
    for g, wanted in brackets.items():
        for r in wanted:
            parts = [f[g, r] for f in found if (g, r) in f]
            values, at = np.unique(np.concatenate([v for _, v, _ in parts]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([c for _, _, c in parts])).astype(np.int64)
            before = sum(a for a, _, _ in parts)
            out[g, r] = float(values[np.searchsorted(np.cumsum(counts), r - before, side="right")])
    return out


# ------------------------------------------------------------------- growing

def _gradient(loss: str, r: np.ndarray, delta: float) -> np.ndarray:
    if loss == "lad":
        return np.where(r > 0, 1.0, -1.0)
    return np.clip(r, -delta, delta)


def _sums(cell: np.ndarray, whole: np.ndarray, size: int) -> np.ndarray:
    """Exact sums of integers per cell."""
    high, low = (whole >> 20).astype(np.float64), (whole & 0xFFFFF).astype(np.float64)
    return (np.bincount(cell, high, size).astype(np.int64) << 20) + np.bincount(cell, low, size).astype(np.int64)


def _choose(n: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, cut, rows to the left, rows, gain) of the largest gain per node; counts and sums: (node, feature, bin)."""
    ln, ls = n.cumsum(axis=2), s.cumsum(axis=2)
    size, total = ln[:, :1, -1:], ls[:, :1, -1:].astype(np.float64)
    left = ls.astype(np.float64)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left * left / ln + (total - left) ** 2 / (size - ln) - total * total / size
    gain = np.where((ln > 0) & (ln < size), gain, -1.0).reshape(len(n), -1)
    best = gain.argmax(axis=1)
    at = np.arange(len(n))
    feature, cut = np.divmod(best, MAX_BINS)
    return feature, cut, ln[at, feature, cut], size[:, 0, 0], gain[at, best]


def _best_splits(rows: _Rows, growing: dict[int, Tree], level: int, delta: dict[int, float], unit: float
                 ) -> Iterator[tuple[int, int, int, int, int, int, float]]:
    """(m, node, feature, bin, rows to the left, rows, gain) of the largest gain per open node of ``level``."""
    first, many = (1 << level) - 1, 1 << level
    specs, width = rows.shape[1], rows.shape[3]

    def emit(block: _Block) -> dict[int, tuple]:
        out = {}
        for m, tree in growing.items():
            at, r = block.residuals(m)
            node = tree.leaf(block.bins[at]) - first
            here = node >= 0
            if not here.any():
                continue
            node, mine = node[here], block.bins[at[here]]
            g = np.rint(_gradient(specs[m].loss, r[here], delta.get(m, 0.0)) / unit).astype(np.int64)
            base = node * (width * MAX_BINS)
            size = many * width * MAX_BINS
            n, s = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for j in range(width):
                cell = base + j * MAX_BINS + mine[:, j]
                n += np.bincount(cell, minlength=size)
                s += _sums(cell, g, size)
            found = np.flatnonzero(n)
            out[m] = (found.astype(np.int32), n[found], s[found])
        return out

    n = {m: np.zeros(many * width * MAX_BINS, np.int64) for m in growing}
    s = {m: np.zeros(many * width * MAX_BINS, np.int64) for m in growing}
    for part in rows.map(emit):
        for m, (cell, count, total) in part.items():
            n[m][cell] += count
            s[m][cell] += total
    for m in growing:
        feature, cut, left, size, gain = _choose(n[m].reshape(many, width, MAX_BINS), s[m].reshape(many, width, MAX_BINS))
        for k in np.flatnonzero(size).tolist():
            yield m, first + k, int(feature[k]), int(cut[k]), int(left[k]), int(size[k]), float(gain[k]) * unit * unit


class _Alone:
    """Rows of one model in a task: trees grown without passes. A level sorts
    nothing and counts only the rows of each smaller child; the larger child's
    counts and sums are the parent's less those."""

    def __init__(self, y: np.ndarray, bins: np.ndarray, spec: Spec, unit: float):
        self.y, self.columns, self.spec, self.unit = y, np.ascontiguousarray(bins.T), spec, unit

    def quantile(self, v: np.ndarray, q: float) -> float:
        at = (len(v) - 1) * q
        k = math.floor(at)
        k1 = min(k + 1, len(v) - 1)
        got = np.partition(v, [k, k1])
        return float(got[k] + (at - k) * (got[k1] - got[k]))

    def _cells(self, rows: np.ndarray | None, group: np.ndarray, groups: int, parts: Sequence[np.ndarray], scale: Sequence[int]
               ) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of ``parts`` x ``scale`` per (group, feature, bin)."""
        n, s = (np.zeros((groups, len(self.columns), MAX_BINS), np.int64) for _ in range(2))
        for k in range(0, len(group), SLICE):
            at = slice(k, k + SLICE) if rows is None else rows[k:k + SLICE]
            base = group[k:k + SLICE].astype(np.int64) << 8
            here = [p[at] for p in parts]
            for j, column in enumerate(self.columns):
                cell = base + column[at]
                n[:, j] += np.bincount(cell, minlength=groups << 8).reshape(groups, MAX_BINS)
                for p, times in zip(here, scale):
                    s[:, j] += np.bincount(cell, p, groups << 8).reshape(groups, MAX_BINS).astype(np.int64) * times
        return n, s

    def grow(self, r: np.ndarray, delta: float) -> tuple[Tree, np.ndarray]:
        """(tree without values, leaf of every row) on the residuals ``r``."""
        tree, unit = Tree.stump(self.spec.depth), self.unit
        g = _gradient(self.spec.loss, r, delta)
        if self.spec.loss == "lad":  # one size, two signs
            parts, scale = [g], [int(np.rint(1.0 / unit))]
        else:
            whole = np.rint(g / unit).astype(np.int64)
            parts, scale = [(whole >> 20).astype(np.float64), (whole & 0xFFFFF).astype(np.float64)], [1 << 20, 1]
        leaf = np.zeros(len(r), np.int32)
        rows, place = None, np.zeros(len(r), np.int32)  # rows of open nodes, and which node
        nodes = np.zeros(1, np.int64)
        n, s = self._cells(None, place, 1, parts, scale)
        for level in range(self.spec.depth):
            feature, cut, left, size, gain = _choose(n, s)
            gain *= unit * unit
            splits = gain > 1e-15 * size
            if not splits.any():
                break
            at = nodes[splits]
            tree.feature[at], tree.cut[at], tree.gain[at] = feature[splits], cut[splits], gain[splits]
            here = splits[place]
            rows = np.flatnonzero(here) if rows is None else rows[here]
            place = place[here]
            right = self.columns[feature[place], rows] > cut[place]
            number = (np.cumsum(splits) - 1).astype(np.int32)
            leaf[rows] = 2 * nodes[place] + 1 + right
            place = 2 * number[place] + right
            nodes = np.stack([2 * at + 1, 2 * at + 2], axis=1).reshape(-1)
            if level + 1 < self.spec.depth:
                small = (left > size - left)[splits]  # the right child has fewer rows
                mine = (place & 1) == small[place >> 1]
                less = self._cells(rows[mine], place[mine] >> 1, len(at), parts, scale)
                n, s = (self._children(whole[splits], part, small) for whole, part in zip((n, s), less))
        return tree, leaf

    @staticmethod
    def _children(parent: np.ndarray, part: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = np.empty((len(parent), 2, *parent.shape[1:]), np.int64)
        at = np.arange(len(parent))
        out[at, right.astype(np.int64)] = part
        out[at, 1 - right.astype(np.int64)] = parent - part
        return out.reshape(-1, *parent.shape[1:])

    def values(self, tree: Tree, leaf: np.ndarray, r: np.ndarray, delta: float) -> None:
        order = np.lexsort((r, leaf))
        start = np.flatnonzero(np.diff(leaf[order], prepend=-1))
        size = np.diff(np.append(start, len(leaf)))
        which = leaf[order[start]]
        # the smallest value whose cumulative share reaches one half
        median = r[order[start + (size + 1) // 2 - 1]]
        shift = np.zeros(len(median))
        if self.spec.loss == "huber":
            number = np.zeros(len(tree.feature), np.int64)
            number[which] = np.arange(len(which))
            g = number[leaf]
            shift = _sums(g, np.rint(np.clip(r - median[g], -delta, delta) / self.unit).astype(np.int64), len(median)
                          ) * self.unit / size
        tree.value[which] = median + shift

    def boost(self) -> Model:
        model = Model(self.spec, self.quantile(self.y, 0.5))
        f = np.full(len(self.y), model.init)
        for _ in range(self.spec.trees):
            r = self.y - f
            delta = self.quantile(np.abs(r), ALPHA) if self.spec.loss == "huber" else 0.0
            tree, leaf = self.grow(r, delta)
            self.values(tree, leaf, r, delta)
            model.trees.append(tree)
            f += RATE * tree.value[leaf]
        return model


def _boost(start: Callable[[Sequence[float]], Any], specs: Sequence[Spec], size: Sequence[int], unit: float,
           blocks: int) -> list[Model]:
    """The boosting loop over ``start(initial predictions)``, the rows."""
    every = list(range(len(specs)))

    def quantiles(rows: Any, models: list[int], q: float, absolute: bool) -> dict[int, float]:
        def pairs(block: _Block) -> tuple[np.ndarray, np.ndarray]:
            got = [block.residuals(m)[1] for m in models]
            v = np.concatenate(got)
            return np.repeat(models, [len(x) for x in got]), np.abs(v) if absolute else v

        at = {m: (size[m] - 1) * q for m in models}
        low = {m: math.floor(x) for m, x in at.items()}
        got = order_statistics(rows, pairs, {m: [k, min(k + 1, size[m] - 1)] for m, k in low.items()})
        return {m: got[m, k] + (at[m] - k) * (got[m, min(k + 1, size[m] - 1)] - got[m, k]) for m, k in low.items()}

    init = quantiles(start([0.0] * len(specs)), every, 0.5, False)
    models = [Model(s, init[m]) for m, s in enumerate(specs)]
    rows = start([init[m] for m in every])
    width = rows.shape[3]
    for t in range(max(s.trees for s in specs)):
        active = [m for m in every if t < specs[m].trees]
        huber = [m for m in active if specs[m].loss == "huber"]
        delta = quantiles(rows, huber, ALPHA, True) if huber else {}
        trees = {m: Tree.stump(specs[m].depth) for m in active}
        leaves: dict[int, dict[int, int]] = {m: {0: size[m]} for m in active}
        for level in range(max(specs[m].depth for m in active)):
            first = (1 << level) - 1
            growing = [m for m in active if level < specs[m].depth and any(k >= first for k in leaves[m])]
            wave = max(1, SUMMARY_CELLS // (blocks * (width * MAX_BINS << level)))  # models of a pass
            for k in range(0, len(growing), wave):
                for m, node, j, cut, left, n, gain in _best_splits(rows, {m: trees[m] for m in growing[k:k + wave]},
                                                                   level, delta, unit):
                    if gain > 1e-15 * n:
                        trees[m].feature[node], trees[m].cut[node], trees[m].gain[node] = j, cut, gain
                        del leaves[m][node]
                        leaves[m] |= {2 * node + 1: left, 2 * node + 2: n - left}
        _leaf_values(rows, trees, leaves, delta, unit)
        for m in active:
            models[m].trees.append(trees[m])
        rows.add(trees)
    return models


def fit(df: DataFrame, cuts: Binning, specs: Sequence[Spec], folds: str | None = None) -> list[Model]:
    """Models of ``specs``, boosted on the rows of ``df`` (labels and features;
    ``folds``: its column of fold numbers). Up to ``ALONE`` rows, some 120 bytes
    each, a task holds all that a model learns from, and models grow in a task
    each, without a pass per level. Beyond, all grow in lockstep, a map over the
    blocks per pass. Both give the same models."""
    specs = list(specs)
    labels = sorted({s.label for s in specs})
    fold = F.col(folds).cast("int") if folds else F.lit(-1)
    frame = df.select(*[F.col(c).cast("double").alias(c) for c in labels], fold.alias("fold"), *cuts.features)
    table = materialize(binned(frame, cuts, [*labels, "fold"]))
    counts = {r["fold"]: r["n"] for r in table.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    size = [sum(n for k, n in counts.items() if k != s.fold) for s in specs]
    if not specs or not all(size):
        raise ValueError("a model has no training rows")
    n_rows, width = sum(counts.values()), len(cuts.features)
    held = _blocks(table, labels, n_rows)
    largest = table.agg(*[F.max(F.abs(F.col(c))).alias(c) for c in labels]).first()
    bits = UNIT_BITS - (n_rows >> 22).bit_length()
    unit = 2.0 ** (math.ceil(math.log2(max(1.0, 2 * max(abs(largest[c] or 0.0) for c in labels)))) - bits)
    if n_rows > ALONE:
        return _boost(lambda init: _Rows(held, labels, specs, init, width), specs, size, unit, -(-n_rows // BLOCK))

    # a task per model, the longest first
    ranked = sorted(range(len(specs)), key=lambda m: (-specs[m].trees * specs[m].depth, m))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for batch in batches:
            for k, place in enumerate(batch.column("place").to_pylist()):
                y, fold, bins = (batch.column(c)[k].as_buffer() for c in ("y", "fold", "bins"))
                spec = specs[ranked[place]]
                fold = np.frombuffer(fold, np.int32)
                y = np.frombuffer(y, np.float64).reshape(len(fold), len(labels))[:, labels.index(spec.label)]
                bins = np.frombuffer(bins, np.uint8).reshape(len(fold), width)
                learns = np.ones(len(fold), bool) if spec.fold is None else fold != spec.fold
                parts.setdefault(place, []).append((y[learns], bins[learns]))
        for place in sorted(parts):
            y, bins = (np.concatenate(x) for x in zip(*parts.pop(place)))
            alone = _Alone(y, bins, specs[ranked[place]], unit)
            del bins  # the model has its columns
            model = alone.boost()
            yield pa.RecordBatch.from_arrays([pa.array([ranked[place]], pa.int32()), pa.array([pickle.dumps(model)], pa.binary())],
                                             ["m", "model"])

    todo = held.select("y", "fold", "bins", F.explode(F.lit(list(range(len(specs))))).alias("place"))
    rows = todo.repartitionByRange(len(specs), "place").mapInArrow(run, "m int, model binary").collect()
    return [pickle.loads(r["model"]) for r in sorted(rows, key=lambda r: r["m"])]


def _leaf_values(rows: _Rows, trees: dict[int, Tree], leaves: dict[int, dict[int, int]], delta: dict[int, float],
                 unit: float) -> None:
    number = {(m, k): i for i, (m, k) in enumerate((m, k) for m in trees for k in sorted(leaves[m]))}
    place = {m: np.array([number.get((m, k), -1) for k in range(len(t.feature))]) for m, t in trees.items()}
    sizes = np.array([leaves[m][k] for m, k in number])

    def pairs(block: _Block) -> tuple[np.ndarray, np.ndarray]:
        got = [(place[m][t.leaf(block.bins[at])], r) for m, t in trees.items() for at, r in [block.residuals(m)]]
        return np.concatenate([g for g, _ in got]), np.concatenate([r for _, r in got])

    # the smallest value whose cumulative share reaches one half
    got = order_statistics(rows, pairs, {i: [(n + 1) // 2 - 1] for i, n in enumerate(sizes.tolist())})
    median = np.array([v for (i, _), v in sorted(got.items())])
    shift = np.zeros(len(median))
    if delta:
        def clipped(block: _Block) -> np.ndarray:
            out = np.zeros(len(median), np.int64)
            for m, d in delta.items():
                at, r = block.residuals(m)
                g = place[m][trees[m].leaf(block.bins[at])]
                out += _sums(g, np.rint(np.clip(r - median[g], -d, d) / unit).astype(np.int64), len(median))
            return out

        shift = sum(rows.map(clipped)) * unit / sizes
    for (m, k), i in number.items():
        trees[m].value[k] = median[i] + shift[i]


def predict(df: DataFrame, cuts: Binning, models: dict[str, Model], keep: Sequence[str],
            sizes: Sequence[int] | None = None) -> DataFrame:
    """Columns ``keep`` of ``df`` and a prediction per model; with ``sizes``
    an array per model, of the predictions of its first n trees for each n."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    kind = ArrayType(DoubleType()) if sizes else DoubleType()
    schema = StructType([*(df.schema[k] for k in keep), *(StructField(k, kind) for k in models)])
    arrow = to_arrow_schema(schema)
    steps = sorted(set(sizes or ()))
    handed = df.sparkSession.sparkContext.broadcast(models)  # node tables: models x trees x nodes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _matrix(b, "bins", len(cuts.features), np.uint8)
            out = []
            for model in handed.value.values():
                f = np.full(len(bins), model.init)
                staged = []
                for i, t in enumerate(model.trees, 1):
                    f = f + RATE * t.value[t.leaf(bins)]
                    if i in steps:
                        staged.append(f)
                out.append(pa.array(list(np.stack(staged, axis=1)) if len(bins) else [], pa.list_(pa.float64()))
                           if sizes else pa.array(f, pa.float64()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *out], schema=arrow)

    return binned(df, cuts, keep).mapInArrow(run, schema)
