"""Bagged regression trees of any depth as Spark jobs, and trees scored at every depth.

Spark's own forest keeps a histogram per open node, feature and bin. A tree that
grows until its leaves are pure has about as many nodes as rows, so the
histograms of hundreds of such trees dwarf the data, whatever the cluster.
Here the rows are binned once (``boosting.Binning``) and the trees are dealt to
tasks. A task grows a tree level by level. Its rows lie in order of their nodes
and a level takes some ``SLICE`` of them at a time: of small nodes, per feature,
one sort by (node, bin) and running sums along it give the gain of every cut; a
larger node is summed up per bin. A level costs as much as its rows, however
many nodes they are in.

Splits: all features, largest fall of the squared error, ties to the first
feature and the lowest cut. A node stays a leaf if its labels agree or no cut
gains. Bootstrap weights are Poisson(1) draws by tree over the rows in order of
a hash of their content, and labels are summed as integers (whole multiples of
a small unit), so a forest does not depend on how rows are dealt. Growth is
greedy and node by node: the tree of a lower depth limit is the upper part of
the deeper one, and a node's value is its prediction where the limit ends it.

Trees stay in a table (a row per tree), never on the driver. To score, rows are
packed in chunks; sets of chunks meet groups of trees, and the groups' sums
are added per chunk. All rows are fitted: a task holds them in some 100 bytes
each while it grows a tree (twelve features, one label).
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.operators.boosting import BLOCK, Binning, _sums, binned
from sendwatch.session import materialize, share_package

TASKS = 64            # tasks that grow a forest's trees, and groups that score them
DEEP_GROUPS = 16      # groups where every depth is scored: their sums are as many times wider
SET_CHUNKS = 4        # chunks of BLOCK rows that a scoring task holds at least,
SET_BYTES = 1 << 26   # and as many as fit this with their sums
PIECE_BYTES = 1 << 21  # of a chunk's sums that are added up at a time
SLICE = 1 << 18       # rows that a level works on at a time
UNIT_BITS = 40
SAFE_ROWS = 1 << 22   # sums of so many labels fit 62 bits; units are larger beyond
LEAST_GAIN = 1e-12    # of a node's squared error


@dataclass
class Nodes:
    """A tree: the children of an inner node are ``left`` and ``right``, -1 at
    leaves; rows whose feature is at most ``cut`` go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def staged(self, x: np.ndarray, depths: Sequence[int]) -> np.ndarray:
        """Predictions (rows, depths) of the tree cut off at each of the ascending depths."""
        out = np.empty((len(x), len(depths)))
        at = np.zeros(len(x), dtype=np.int64)
        rows = np.arange(len(x))  # those not at a leaf yet
        level = 0
        for i, depth in enumerate(depths):
            while level < depth and len(rows):
                rows = rows[self.left[at[rows]] >= 0]
                node = at[rows]
                low = x[rows, self.feature[node]] <= self.cut[node]
                at[rows] = np.where(low, self.left[node], self.right[node])
                level += 1
            out[:, i] = self.value[at]
        return out


def _level_cuts(node: np.ndarray, bins: np.ndarray, w: np.ndarray, s: np.ndarray, n_nodes: int
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(gain, feature, bin, weight, sum) per node: its best cut. Rows: node, bins, weight, weighted label."""
    place = len(node).bit_length()
    rows = np.arange(len(node))
    weight = np.zeros(n_nodes, np.int64)
    total = np.zeros(n_nodes, np.int64)
    np.add.at(weight, node, w)
    np.add.at(total, node, s)
    gain = np.zeros(n_nodes)
    feature, cut = np.zeros(n_nodes, np.int8), np.zeros(n_nodes, np.uint8)
    square = total.astype(np.float64) ** 2 / weight
    before_w, before_s = np.cumsum(weight) - weight, np.cumsum(total) - total
    for j in range(bins.shape[1]):
        cell = (node << 8) + bins[:, j]
        key = np.sort((cell << place) | rows)
        order = key & ((1 << place) - 1)
        cell = key >> place
        end = np.flatnonzero(cell[1:] != cell[:-1])  # rows up to here go left
        at = cell[end] >> 8
        inside = at == cell[end + 1] >> 8
        end, at = end[inside], at[inside]
        if not len(end):
            continue
        lw = np.cumsum(w[order])[end] - before_w[at]
        ls = (np.cumsum(s[order])[end] - before_s[at]).astype(np.float64)
        g = ls * ls / lw + (total[at] - ls) ** 2 / (weight[at] - lw) - square[at]
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        best = np.maximum.reduceat(g, first)
        which = np.flatnonzero(g == np.repeat(best, np.diff(np.append(first, len(g)))))[::-1]
        pick = np.zeros(n_nodes, np.int64)
        pick[at[which]] = which  # the lowest cut of the best
        better = at[first][best > gain[at[first]]]
        gain[better], feature[better] = g[pick[better]], j
        cut[better] = (cell[end[pick[better]]] & 255).astype(np.uint8)
    return gain, feature, cut, weight, total


def _large_cuts(bins: np.ndarray, w: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """``_level_cuts`` of one node, its rows summed up per bin a slice at a time."""
    width = bins.shape[1]
    n, s = np.zeros((width, 256), np.int64), np.zeros((width, 256), np.int64)
    for k in range(0, len(y), SLICE):
        part = bins[k:k + SLICE]
        mine = w[k:k + SLICE].astype(np.int64)
        whole = y[k:k + SLICE] * mine
        for j in range(width):
            n[j] += np.bincount(part[:, j], mine, 256).astype(np.int64)
            s[j] += _sums(part[:, j], whole, 256)
    weight, total = n[:1].sum(axis=1), s[:1].sum(axis=1)
    square = total.astype(np.float64) ** 2 / weight
    gain, feature, cut = np.zeros(1), np.zeros(1, np.int8), np.zeros(1, np.uint8)
    for j in range(width):
        found = np.flatnonzero(n[j])[:-1]  # bins up to one of these go left
        if not len(found):
            continue
        lw, ls = np.cumsum(n[j])[found], np.cumsum(s[j])[found].astype(np.float64)
        g = ls * ls / lw + (total - ls) ** 2 / (weight - lw) - square
        best = int(g.argmax())
        if g[best] > gain[0]:
            gain[0], feature[0], cut[0] = g[best], j, found[best]
    return gain, feature, cut, weight, total


def _slices(size: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """(first node, last node, first row, last row) of up to ``SLICE`` rows, or of one node; ends are exclusive."""
    ends = np.cumsum(size)
    node = row = 0
    while node < len(size):
        end = max(node + 1, int(np.searchsorted(ends, row + SLICE, side="right")))
        yield node, end, row, int(ends[end - 1])
        node, row = end, int(ends[end - 1])


def grow(bins: np.ndarray, whole: np.ndarray, w: np.ndarray, depth: int, unit: float) -> tuple[Nodes, np.ndarray, int]:
    """(tree, gains per feature, depth reached) on rows of weight ``w``; labels are ``whole`` times ``unit``."""
    drawn = np.flatnonzero(w)
    bins, y, w = bins[drawn], whole[drawn], w[drawn]
    del drawn
    shift = int(y.sum() // max(1, len(y)))  # gains of centred labels
    y -= shift
    size = np.array([len(y)])  # rows of the open nodes; rows are in order of their nodes
    levels, importance = [], np.zeros(bins.shape[1])
    made, reached = 1, 0
    for level in range(depth + 1):
        n_nodes = len(size)
        gain, error = np.zeros(n_nodes), np.zeros(n_nodes)
        feature, cut = np.zeros(n_nodes, np.int8), np.zeros(n_nodes, np.uint8)
        weight, total = np.zeros(n_nodes, np.int64), np.zeros(n_nodes, np.int64)
        mixed = np.zeros(n_nodes, bool)
        for a, b, begin, end in _slices(size):
            if end - begin > SLICE:
                got = _large_cuts(bins[begin:end], w[begin:end], y[begin:end])
            else:
                node = np.repeat(np.arange(b - a), size[a:b])
                mine = w[begin:end].astype(np.int64)
                got = _level_cuts(node, bins[begin:end], mine, y[begin:end] * mine, b - a)
            for out, x in zip((gain, feature, cut, weight, total), got):
                out[a:b] = x
            labels, mean = y[begin:end], total[a:b] / weight[a:b]
            if end - begin > SLICE:
                mixed[a] = labels.min() < labels.max()
                error[a] = sum(float((w[k:min(k + SLICE, end)] * (y[k:min(k + SLICE, end)] - mean) ** 2).sum())
                               for k in range(begin, end, SLICE))
            else:
                first = np.cumsum(size[a:b]) - size[a:b]
                mixed[a:b] = np.minimum.reduceat(labels, first) < np.maximum.reduceat(labels, first)
                error[a:b] = np.add.reduceat(mine * (labels - mean[node]) ** 2, first)
        splits = mixed & (gain > LEAST_GAIN * error) & (level < depth)
        number = np.cumsum(splits) - 1
        left = np.where(splits, made + 2 * number, -1)
        levels.append((np.where(splits, feature, 0), cut, left, (total / weight + shift) * unit))
        np.add.at(importance, feature[splits], gain[splits])
        if not splits.any():
            break
        reached = level + 1
        if not splits.all():
            keep = np.repeat(splits, size)
            bins, y, w = bins[keep], y[keep], w[keep]
        size, feature, cut = size[splits], feature[splits].astype(np.int64), cut[splits]
        low = np.zeros(len(size), np.int64)
        for a, b, begin, end in _slices(size):  # the rows of a node: those of its left child, then those of its right
            node = np.repeat(np.arange(b - a, dtype=np.int32), size[a:b])
            part = bins[begin:end]
            right = part[np.arange(end - begin), feature[a:b][node]] > cut[a:b][node]
            low[a:b] = np.bincount(node, ~right, b - a).astype(np.int64)
            order = (np.argsort(2 * node + right, kind="stable") if b - a > 1
                     else np.concatenate([np.flatnonzero(~right), np.flatnonzero(right)]))
            del node, right
            bins[begin:end], y[begin:end], w[begin:end] = part[order], y[begin:end][order], w[begin:end][order]
        size = np.stack([low, size - low], axis=1).reshape(-1)
        made += len(size)
    f, c, left, value = (np.concatenate(x) for x in zip(*levels))
    left = left.astype(np.int32)
    return Nodes(f.astype(np.int8), c, left, np.where(left >= 0, left + 1, -1).astype(np.int32), value), importance, reached


def packed(nodes: Nodes) -> bytes:
    """A grown tree in ten bytes a node: the children of its inner nodes follow each other."""
    feature = np.where(nodes.left >= 0, nodes.feature, -1).astype(np.int8)
    return nodes.value.tobytes() + feature.tobytes() + nodes.cut.astype(np.uint8).tobytes()


def unpacked(data: bytes) -> Nodes:
    n = len(data) // 10
    feature, cut = np.frombuffer(data, np.int8, n, 8 * n), np.frombuffer(data, np.uint8, n, 9 * n)
    inner = feature >= 0
    left = np.where(inner, 2 * np.cumsum(inner) - 1, -1).astype(np.int32)
    return Nodes(np.where(inner, feature, 0).astype(np.int8), cut, left, np.where(inner, left + 1, -1).astype(np.int32),
                 np.frombuffer(data, np.float64, n))


def draws(seed: int | None, tree: int, n: int) -> np.ndarray:
    """How often each of ``n`` rows is in a tree's bootstrap sample; once without a seed."""
    out = np.ones(n, np.uint8)
    if seed is not None:
        rng = np.random.default_rng([seed, tree])
        for k in range(0, n, SLICE):
            out[k:k + SLICE] = rng.poisson(1.0, min(SLICE, n - k))
        if not out.any():
            out[:] = 1
    return out


@dataclass(frozen=True)
class Spec:
    """A forest of ``trees`` trees of at most ``depth``; ``seed`` of its bootstrap
    draws (None: every row once)."""

    label: str
    depth: int
    trees: int
    seed: int | None = 0


@dataclass
class Forest:
    """A grown forest: ``table`` has a row per tree (group, tree, depth reached, gains, nodes)."""

    spec: Spec
    cuts: Binning
    table: DataFrame

    @property
    def importances(self) -> list[float]:
        """Share of every feature in the gains of a tree's splits, averaged over the trees."""
        out = np.zeros(len(self.cuts.features))
        for r in self.table.select("tree", "gains").orderBy("tree").collect():
            gains = np.array(r["gains"])
            out += gains / gains.sum() if gains.sum() else gains
        return (out / out.sum() if out.sum() else out).tolist()

    @property
    def depth(self) -> int:
        """Depth of the deepest tree."""
        return self.table.agg(F.max("depth").alias("d")).first()["d"]

    def transform(self, frame: DataFrame) -> DataFrame:
        """``frame`` without its vectors, and ``prediction``."""
        rows = self.staged(frame, [self.spec.depth], TASKS)
        return rows.withColumn("prediction", F.col("predictions")[0]).drop("predictions")

    def staged(self, frame: DataFrame, depths: Sequence[int], groups: int = DEEP_GROUPS) -> DataFrame:
        """``frame`` without its vectors, and ``predictions``: of the forest cut off at each depth."""
        depths = sorted(depths)
        keep = [c for c in frame.columns if c != "features"]
        rows = materialize(frame.select(*keep).withColumn("_row", F.monotonically_increasing_id()))
        chunks = _chunks(binned(rows, self.cuts, ["_row"]))
        n_chunks, width, n_trees = chunks.count(), len(self.cuts.features), self.spec.trees
        if not n_chunks:
            return rows.drop("_row").withColumn("predictions", F.array(*[F.lit(0.0) for _ in depths]))
        piece = max(1, PIECE_BYTES // (8 * len(depths)))
        # _row is 0.. within a partition; sets of chunks are dealt by a hash of the chunk's first row
        sets = -(-n_chunks // max(SET_CHUNKS, SET_BYTES // (BLOCK * (8 * len(depths) + 8 + width))))
        left = chunks.select("*", F.pmod(F.xxhash64("chunk"), F.lit(sets)).cast("int").alias("part"),
                             F.explode(F.lit(list(range(min(groups, n_trees))))).alias("group"))
        right = self.table.select((F.col("group") % min(groups, n_trees)).cast("int").alias("group"), "tree", "nodes",
                                  F.explode(F.lit(list(range(sets)))).alias("part"))

        def score(rows_: pa.Table, trees: pa.Table) -> pa.Table:
            ids = rows_.column("rows").to_pylist()
            x = [np.frombuffer(b, np.uint8).reshape(-1, width) for b in rows_.column("bins").to_pylist()]
            out = [np.zeros((len(part), len(depths))) for part in x]
            for _, k in sorted(zip(trees.column("tree").to_pylist(), range(len(trees)))):
                tree = unpacked(trees.column("nodes")[k].as_buffer())
                for part, total in zip(x, out):
                    total += tree.staged(part, depths)
            cut = [(c, g, i[8 * k:8 * (k + piece)], k) for c, g, i in zip(
                rows_.column("chunk").to_pylist(), rows_.column("group").to_pylist(), ids) for k in range(0, len(i) // 8, piece)]
            sums = []
            while out:
                total = out.pop(0)
                sums += [total[k:k + piece].tobytes() for k in range(0, len(total), piece)]
            chunk, group, ids, place = zip(*cut) if cut else ((), (), (), ())
            return pa.table({"chunk": pa.array(chunk, pa.int64()), "place": pa.array(place, pa.int32()),
                             "group": pa.array(group, pa.int32()), "rows": pa.array(ids, pa.binary()),
                             "sums": pa.array(sums, pa.binary())})

        part = left.groupBy("group", "part").cogroup(right.groupBy("group", "part")).applyInArrow(
            score, "chunk long, place int, group int, rows binary, sums binary")

        def add(parts: pa.Table) -> pa.Table:
            ids = np.frombuffer(parts.column("rows")[0].as_py(), np.int64)
            out = np.zeros((len(ids), len(depths)))
            for _, k in sorted(zip(parts.column("group").to_pylist(), range(len(parts)))):
                out += np.frombuffer(parts.column("sums")[k].as_buffer(), np.float64).reshape(out.shape)
            flat = pa.array((out / n_trees).reshape(-1))
            offsets = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * len(depths))
            return pa.table({"_row": pa.array(ids), "predictions": pa.ListArray.from_arrays(offsets, flat)})

        scored = part.groupBy("chunk", "place").applyInArrow(add, "_row long, predictions array<double>")
        return rows.join(scored, "_row").drop("_row")


def _chunks(table: DataFrame, most: int = BLOCK) -> DataFrame:
    """(chunk, rows, bins): up to ``most`` rows of (_row, bins) per row; a chunk is named by its first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, bins, size = [], [], 0

        def chunk() -> pa.RecordBatch:
            row = np.concatenate(ids)
            return pa.RecordBatch.from_arrays([pa.array([row[0]], pa.int64()), pa.array([row.tobytes()], pa.binary()),
                                               pa.array([b"".join(bins)], pa.binary())], ["chunk", "rows", "bins"])

        for b in batches:
            if not b.num_rows:
                continue
            ids.append(b.column("_row").to_numpy())
            bins.append(b"".join(b.column("bins").to_pylist()))
            size += b.num_rows
            if size >= most:
                yield chunk()
                ids, bins, size = [], [], 0
        if size:
            yield chunk()

    return materialize(table.mapInArrow(run, "chunk long, rows binary, bins binary"))


def fit(df: DataFrame, cuts: Binning, specs: Sequence[Spec]) -> list[Forest]:
    """Forests of ``specs`` on the rows of ``df`` (labels and features), grown in one job."""
    specs = list(specs)
    share_package(df.sparkSession)
    labels, width = sorted({s.label for s in specs}), len(cuts.features)
    frame = df.select(*[F.col(c).cast("double").alias(c) for c in labels], *cuts.features)
    table = materialize(binned(frame, cuts, labels).withColumn("key", F.xxhash64("bins")))
    head = table.agg(F.count(F.lit(1)).alias("n"), *[F.max(F.abs(F.col(c))).alias(c) for c in labels]).first()
    if not head["n"]:
        raise ValueError("a model has no training rows")
    n = head["n"]
    bits = UNIT_BITS - (n // SAFE_ROWS).bit_length()
    unit = 2.0 ** (math.ceil(math.log2(max(1.0, 2 * max(abs(head[c] or 0.0) for c in labels)))) - bits)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            y = np.stack([b.column(c).to_numpy() for c in labels], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (
                b.column("key").to_numpy().tobytes(), y.tobytes(), b"".join(b.column("bins").to_pylist()))],
                ["key", "y", "bins"])

    todo = [(m, t) for m, s in enumerate(specs) for t in range(s.trees)]
    tasks = min(TASKS, len(todo))
    parts = materialize(table.mapInArrow(pack, "key binary, y binary, bins binary"))
    dealt = parts.select("*", F.explode(F.lit(list(range(tasks)))).alias("task")).repartitionByRange(tasks, "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, whole, bins = np.empty(n, np.int64), np.empty((len(labels), n), np.int64), np.empty((n, width), np.uint8)
        here, at = [], 0  # tasks, all with the same rows: those of the first are read
        for b in batches:
            for k, task in enumerate(b.column("task").to_pylist()):
                if task not in here:
                    here.append(task)
                if task == here[0]:
                    some = np.frombuffer(b.column("key")[k].as_buffer(), np.int64)
                    end = at + len(some)
                    key[at:end] = some
                    y = np.frombuffer(b.column("y")[k].as_buffer(), np.float64).reshape(-1, len(labels))
                    whole[:, at:end] = np.rint(y / unit).T
                    bins[at:end] = np.frombuffer(b.column("bins")[k].as_buffer(), np.uint8).reshape(-1, width)
                    at = end
        for i, label in enumerate(labels):
            mine = [(m, t) for task in sorted(here) for m, t in todo[task::tasks] if specs[m].label == label]
            if not mine:
                continue
            order = np.lexsort((whole[i], key))
            y, x = whole[i][order], bins[order]
            del order
            for m, t in mine:
                s = specs[m]
                nodes, gains, depth = grow(x, y, draws(s.seed, t, n), s.depth, unit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([m], pa.int32()), pa.array([t % TASKS], pa.int32()), pa.array([t], pa.int32()),
                     pa.array([depth], pa.int32()), pa.array([gains.tolist()], pa.list_(pa.float64())),
                     pa.array([packed(nodes)], pa.binary())], ["m", "group", "tree", "depth", "gains", "nodes"])

    grown = materialize(dealt.mapInArrow(run, "m int, group int, tree int, depth int, gains array<double>, nodes binary"))
    return [Forest(s, cuts, grown.where(F.col("m") == m).drop("m")) for m, s in enumerate(specs)]
