"""Benchmark decontamination by SimHash over windows of the items' sizes.

An item of n words is looked for in every window of n words of every document;
a document shorter than the item is one window, the whole of it.
Windows and items are compared by their 5-word shingles, weighted by how often
each occurs (fewer than five words form one shingle): the similarity is the
sum of smaller weights over the sum of larger ones, and a window is a match at
``percent`` / 100 or more.

1. A fixed-size bitmap of the items' shingles, alone and with the item's size
   (2**``BITMAP_BITS`` bits whatever the benchmark's size), marks the places of
   a document that can match an item of a size. A window with too few marked
   places of its size to reach the threshold cannot be a match and is passed
   over; this bound loses nothing.
2. The other windows get a 64-bit SimHash of their weighted shingles.
   Equal windows, of whichever documents, are one row from here on.
3. Fingerprints are cut into ``blocks`` parts. If two differ in at most
   blocks * (flips + 1) - 1 bits, some part differs in at most ``flips``; the
   index holds every item's parts with up to that many bits flipped, so one
   equi-join finds all fingerprints within that radius.
4. Candidates are verified by the exact weighted similarity.

With the defaults (6 parts, 2 flips) the radius is 17 of 64 bits. A window at
the threshold 0.8 itself is farther with probability under 1 %, one at 0.9
with probability under 1e-5; a verbatim passage has distance 0. A whole
document short of the item gets a second fingerprint that counts ties of its
bits as ones, as the words it lacks may tip them either way.

Edge cases: items and texts that are null or without words match nothing;
repeated items are
reported under each id; ties of similarity go to the first window; rows that
share an id are one document; rows without an id are reported with a null id;
empty tables give no rows; other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.llm import words
from sendwatch.llm.common import NULL_ID_BASE, fresh, materialize, null_safe_id, text_slices

BITMAP_BITS = 24
MASKS = np.uint64(1) << np.arange(64, dtype=np.uint64)


@dataclass(frozen=True)
class Params:
    percent: int = 80
    blocks: int = 6
    flips: int = 2

    @property
    def radius(self) -> int:
        return self.blocks * (self.flips + 1) - 1

    def cuts(self) -> list[tuple[int, int]]:
        """(first bit, bits) of each part of a 64-bit fingerprint."""
        edges = [64 * i // self.blocks for i in range(self.blocks + 1)]
        return [(a, b - a) for a, b in zip(edges, edges[1:])]


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k-word windows (k up to 5)."""
    if len(h) < k:
        return h[:0]
    if k == words.SHINGLE:
        return words.shingle_hashes(h)
    total = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        total += h[i:i + len(total)] * words._WEIGHTS[i]
    return words.mix(total)


def tagged(shingles: np.ndarray) -> np.ndarray:
    """The shingles with their occurrence number mixed in: equal sets of these
    are equal multisets, so weighted similarity is plain set similarity."""
    order = np.argsort(shingles, kind="stable")
    s = shingles[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    start = np.maximum.accumulate(np.where(first, np.arange(len(s)), 0))
    return words.mix(s + (np.arange(len(s)) - start).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def simhash(shingles: np.ndarray, ties: bool = False) -> int:
    """64-bit SimHash; a repeated shingle counts as often as it occurs. ``ties``:
    a bit that half of the shingles have is set."""
    ones = ((shingles[:, None] & MASKS) != 0).sum(axis=0)
    return int(MASKS[2 * ones + ties > len(shingles)].sum(dtype=np.uint64))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def sized(shingles: np.ndarray, size: int) -> np.ndarray:
    """Hashes of (shingle, item size)."""
    return words.mix(shingles + np.uint64(size) * np.uint64(0x9E3779B97F4A7C15))


def _items(benchmark: DataFrame, id_col: str, text: str) -> DataFrame:
    """(item_id, size, fp, marks, tagged): items with at least one word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                rows = []
                for item, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
                    h = words.word_hashes(t)
                    if len(h):
                        s = grams(h, min(words.SHINGLE, len(h)))
                        rows.append((item, len(h), _signed(simhash(s)),
                                     np.concatenate([s, sized(s, len(h))]).view(np.int64).tolist(),
                                     tagged(s).view(np.int64).tolist()))
                columns = list(zip(*rows)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)],
                                                 ["item_id", "size", "fp", "marks", "tagged"])

    return materialize(
        benchmark.select(F.col(f"`{id_col}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text"))
        .mapInArrow(run, "item_id long, size int, fp long, marks array<long>, tagged array<long>"))


def _bitmap(items: DataFrame) -> np.ndarray:
    """The bitmap as bytes; at most 2**BITMAP_BITS / 64 words reach the driver."""
    place = F.shiftrightunsigned(F.col("s"), 64 - BITMAP_BITS)
    bits = (items.select(F.explode("marks").alias("s"))
            .select(F.shiftright(place, 6).alias("word"),
                    F.expr(f"shiftleft(1L, cast(shiftrightunsigned(s, {64 - BITMAP_BITS}) & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")).collect())
    out = np.zeros(1 << (BITMAP_BITS - 6), dtype=np.uint64)
    for r in bits:
        out[r["word"]] = r["bits"] & ((1 << 64) - 1)
    return out


def _marked(bitmap: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    place = shingles >> np.uint64(64 - BITMAP_BITS)
    return (bitmap[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)


def windows_of(h: np.ndarray, sizes: list[int], bitmap: np.ndarray, percent: int) -> list[tuple]:
    """(size, start, shingles) of the windows that can reach the threshold."""
    out = []
    for k in sorted({min(words.SHINGLE, n) for n in sizes}):
        s = grams(h, k)
        if not len(s):
            continue
        marked = _marked(bitmap, s)
        if not marked.any():
            continue
        places = np.flatnonzero(marked)
        for n in sizes:
            if min(words.SHINGLE, n) != k:
                continue
            w = n - k + 1  # shingles in a window, and in the item
            if n > len(h):  # common <= marked places and common / (len(s) + w - common) >= percent / 100
                if 100 * len(s) >= percent * w and (100 + percent) * int(
                        _marked(bitmap, sized(s[places], n)).sum()) >= percent * (len(s) + w):
                    out.append((n, 0, s))
                continue
            own = places[_marked(bitmap, sized(s[places], n))]
            if (100 + percent) * len(own) < 2 * percent * w:
                continue
            marked[:] = False
            marked[own] = True
            total = np.concatenate([[0], np.cumsum(marked)])
            # common <= marked places and common / (2w - common) >= percent / 100
            for start in np.flatnonzero((100 + percent) * (total[w:] - total[:-w]) >= 2 * percent * w).tolist():
                out.append((n, start, s[start:start + w]))
    return out


def _windows(docs: DataFrame, sizes: list[int], bitmap: np.ndarray, p: Params) -> DataFrame:
    handed = docs.sparkSession.sparkContext.broadcast((sizes, bitmap))
    schema = "node long, size int, start int, fp long, same long, tagged array<long>"
    names = ["node", "size", "start", "fp", "same", "tagged"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64())]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes_, bitmap_ = handed.value
        rows: list[tuple] = []
        for whole in batches:
            for b in text_slices(whole, "text"):
                for node, t in zip(b.column("node").to_pylist(), b.column("text").to_pylist()):
                    for n, start, s in windows_of(words.word_hashes(t), sizes_, bitmap_, p.percent):
                        x = tagged(s)
                        same = xxhash.xxh3_64_intdigest(np.sort(x).tobytes(), seed=n)
                        whole_doc = len(s) < n - min(words.SHINGLE, n) + 1
                        for fp in {simhash(s), simhash(s, ties=True)} if whole_doc else (simhash(s),):
                            rows.append((node, n, start, _signed(fp), _signed(same), x.view(np.int64).tolist()))
                        if len(rows) >= 2000:
                            yield batch(rows)
                            rows = []
        if rows:
            yield batch(rows)

    return docs.mapInArrow(run, schema)


def flips_of(value: int, bits: int, flips: int) -> list[int]:
    """``value`` with up to ``flips`` of its ``bits`` bits flipped."""
    return [value ^ sum(1 << i for i in c) for f in range(flips + 1) for c in combinations(range(bits), f)]


def _index(items: DataFrame, p: Params) -> DataFrame:
    """(size, part, value, item_id, item_fp, item_tagged): every part of every
    item's fingerprint with up to ``flips`` bits flipped."""
    def part(i: int, at: int, bits: int) -> Column:
        patterns = F.array(*[F.lit(m).cast("long") for m in flips_of(0, bits, p.flips)])
        value = F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << bits) - 1))
        return F.transform(patterns, lambda m: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(m).alias("value")))

    parts = [part(i, at, bits) for i, (at, bits) in enumerate(p.cuts())]
    return (items.select("size", "item_id", F.col("fp").alias("item_fp"), F.inline(F.concat(*parts)))
            .select("size", "part", "value", "item_id", "item_fp"))


def matches(docs: DataFrame, id_col: str, text: str, benchmark: DataFrame, item_id: str, item_text: str,
            p: Params = Params()) -> DataFrame:
    """(node, doc_id, item_id, similarity, start): the best window of every
    document and item that match; ``start`` is the window's first word (0 for a
    document shorter than the item)."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    nodes = docs.select(null_safe_id(F.col(f"`{id_col}`"), content).alias("node"), content.alias("text"))
    items = _items(benchmark, item_id, item_text)
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())
    seen = materialize(_windows(nodes, sizes, _bitmap(items), p))
    one_each = seen.select("size", "same", "fp", "tagged").dropDuplicates(["size", "same", "fp"])
    probes = F.array(*[F.struct(F.lit(i).alias("part"), F.shiftrightunsigned("fp", at).bitwiseAND(
        F.lit((1 << bits) - 1)).alias("value")) for i, (at, bits) in enumerate(p.cuts())])
    near = (one_each.select("size", "same", "fp", F.inline(probes))
            .join(_index(items, p), ["size", "part", "value"])
            .filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= p.radius)
            .select("size", "same", "item_id").distinct())
    common = F.size(F.array_intersect("tagged", "item_tagged"))
    union = F.size("tagged") + F.size("item_tagged") - common
    verified = (near.join(one_each.select("size", "same", "tagged").dropDuplicates(["size", "same"]), ["size", "same"])
                .join(items.select("item_id", "size", F.col("tagged").alias("item_tagged")), ["item_id", "size"])
                .filter(100 * common >= p.percent * union)
                .select("size", "same", "item_id", (common / union).alias("similarity")).distinct())
    return (seen.select("node", "size", "same", "start").join(materialize(verified), ["size", "same"])
            .groupBy("node", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("s"))).alias("best"))
            .select("node", F.when(F.col("node") < NULL_ID_BASE, F.col("node")).alias("doc_id"), "item_id",
                    F.col("best.similarity").alias("similarity"), (-F.col("best.s")).cast("long").alias("start")))


def clean(docs: DataFrame, id_col: str, text: str, benchmark: DataFrame, item_id: str, item_text: str,
          p: Params = Params()) -> DataFrame:
    """The rows of ``docs`` that match no item."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    node = fresh(docs, "node")
    found = materialize(matches(docs, id_col, text, benchmark, item_id, item_text, p)
                        .select(F.col("node").alias(node)).distinct())
    return (docs.withColumn(node, null_safe_id(F.col(f"`{id_col}`"), content))
            .join(found, node, "left_anti").drop(node))
