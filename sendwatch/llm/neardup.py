"""Near-duplicate groups by MinHash with sequential Bayesian verification.

1. One pass over the texts gives each document its set of distinct 5-word
   shingles (as 64-bit hashes), a 128-bit hash of the set and a MinHash
   signature. Documents with equal sets are one node from here on, so copies
   cost nothing further however many there are.
2. Signatures are banded. In every bucket the smallest node is the pivot, and
   every other node is a candidate with the pivot: linear in the bucket, never
   all pairs.
3. Candidates are verified in sequence: signatures are compared batch by
   batch, and a candidate is pruned as soon as the posterior probability that
   its similarity reaches the threshold, given the matches so far (uniform
   prior), falls under ``miss``. Survivors are verified exactly on full sets.
   Each node is first compared with the pivot that it shares most buckets
   with, one pair per node; then with its other pivots, as far as the two are
   not in one component by now.
4. Nodes linked to pivots form components. Only pairs of a bucket that lie in
   different components can still change the result; exactly those are
   compared last, by the same sequential test and exact verification, in
   large buckets chunk against chunk inside tasks (``_block_links``). In a
   bucket of near copies few are left, and none is dropped or capped.

A pair at the threshold itself meets in no band with probability
(1 - t**rows)**bands, 4e-5 for the defaults, and falls quickly above it.

Edge cases: texts without words are linked with nothing; fewer than five words
form one shingle; rows that share an id count as one document; a row without
an id takes part by its content and its component is the smallest id that it
reaches (null if none); an empty table gives no rows; input columns may have
any name.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.llm import words
from sendwatch.llm.common import NULL_ID_BASE, fresh, materialize, null_safe_id, text_slices
from sendwatch.llm.components import connected_components


@dataclass(frozen=True)
class Params:
    percent: int = 85        # link where 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 8
    batch: int = 32          # signature values compared before each look at the posterior
    miss: float = 1e-6       # a candidate is pruned under this posterior probability
    small_bucket: int = 32   # up to here, pairs of a bucket are rows; beyond, chunks meet in tasks
    chunk_nodes: int = 1024
    chunk_shingles: int = 1 << 20
    seed: int = 20240917

    @property
    def values(self) -> int:
        return self.bands * self.rows


def permutations(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    a = rng.integers(0, 1 << 32, p.values, dtype=np.uint32) | np.uint32(1)
    return a, rng.integers(0, 1 << 32, p.values, dtype=np.uint32)


def signatures(sets: list[np.ndarray], p: Params) -> np.ndarray:
    """MinHash values (16 bits each) of non-empty sets, one row per set."""
    a, b = permutations(p)
    x = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((p.values, len(sets)), dtype=np.uint32)
    for i in range(p.values):
        out[i] = np.minimum.reduceat(x * a[i] + b[i], starts)
    return ((out * np.uint32(0x9E3779B1)) >> np.uint32(16)).astype(np.uint16).T


def fewest_matches(p: Params) -> list[tuple[int, int]]:
    """(n, m): after n values, fewer than m matches leave the similarity below
    the threshold with posterior probability over 1 - miss."""
    t = p.percent / 100
    out = []
    for n in range(p.batch, p.values + 1, p.batch):
        tail, m = 0.0, 0
        while m <= n:  # P(similarity >= t | m of n) = P(Binomial(n + 1, t) <= m)
            tail += math.comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if tail >= p.miss:
                break
            m += 1
        out.append((n, m))
    return out


def sketches(docs: DataFrame, p: Params) -> DataFrame:
    """(node, n, hi, lo, sig) per row of ``docs`` (node, text); null hashes where there are no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                sets = [np.unique(words.shingle_hashes(words.word_hashes(t))) for t in b.column("text").to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                hi, lo, sig = ([None] * len(sets) for _ in range(3))
                if full:
                    made = signatures([sets[i] for i in full], p)
                    for k, i in enumerate(full):
                        digest = xxhash.xxh3_128_intdigest(sets[i].tobytes())
                        hi[i] = (digest >> 64) - (1 << 63)
                        lo[i] = (digest & ((1 << 64) - 1)) - (1 << 63)
                        sig[i] = made[k].tobytes()
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()),
                     pa.array(lo, pa.int64()), pa.array(sig, pa.binary())], ["node", "n", "hi", "lo", "sig"])

    return docs.mapInArrow(run, "node long, n long, hi long, lo long, sig binary")


def _bands(nodes: DataFrame, p: Params) -> DataFrame:
    """(key, node): one row per node and band; the band is ``key`` modulo the number of bands."""
    width = 2 * p.rows
    return nodes.select("node", F.explode(F.expr(
        f"""transform(sequence(0, {p.bands - 1}), i -> shiftright(xxhash64(substring(sig, i * {width} + 1, {width})),
                                                             8) * {p.bands} + i)""")).alias("key"))


def _plausible(pairs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs (a, b) that the sequential test does not prune."""
    looks = fewest_matches(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            left, right = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint16).reshape(n, p.values)
                           for c in ("sa", "sb"))
            alive, matches, done = np.arange(n), np.zeros(n, dtype=np.int64), 0
            for upto, least in looks:
                matches[alive] += (left[alive, done:upto] == right[alive, done:upto]).sum(axis=1)
                alive = alive[matches[alive] >= least]
                done = upto
            yield b.select(["a", "b"]).take(pa.array(alive))

    sig = nodes.select("node", "sig")
    return (pairs.join(sig.toDF("a", "sa"), "a").join(sig.toDF("b", "sb"), "b")
            .mapInArrow(run, "a long, b long"))


def _sets(docs: DataFrame, need: DataFrame) -> DataFrame:
    """(node, set): the shingle hashes of the documents in ``need``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in text_slices(whole, "text"):
                sets = [np.unique(words.shingle_hashes(words.word_hashes(t))).view(np.int64)
                        for t in b.column("text").to_pylist()]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [b.column("node"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))],
                    ["node", "set"])

    return docs.join(need, "node", "left_semi").mapInArrow(run, "node long, set array<long>").distinct()


def _verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """The pairs that are linked: sequential test, then exact similarity of the full sets."""
    likely = materialize(_plausible(pairs, nodes, p))
    need = materialize(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    sets = materialize(_sets(docs, need))
    both = likely.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    linked = 100 * common >= p.percent * (F.size("xa") + F.size("xb") - common)
    return materialize(both.filter(linked).select("a", "b").distinct())


def _block_links(members: DataFrame, docs: DataFrame, nodes: DataFrame, p: Params) -> DataFrame:
    """Links between different components in large buckets; ``members`` holds
    (key, node, part). A bucket is cut into chunks of bounded size, and every
    two chunks meet in one task, which compares them without a row per pair and
    returns a spanning forest of the links that it finds, so no more rows than
    nodes. A pair that shares several buckets is tested in its first band."""
    need = materialize(members.select("node").distinct())
    sets = materialize(_sets(docs, need))
    full = members.join(sets, "node").join(nodes.select("node", "sig"), "node")
    chunks = (members.join(sets.select("node", F.size("set").alias("n")), "node").groupBy("key")
              .agg(F.greatest(F.ceil(F.count(F.lit(1)) / p.chunk_nodes),
                              F.ceil(F.sum("n") / p.chunk_shingles)).cast("int").alias("chunks")))
    own = F.pmod(F.xxhash64("node"), F.col("chunks")).cast("int")
    dealt = (full.join(chunks, "key").withColumn("own", own)
             .withColumn("other", F.explode(F.expr("sequence(0, chunks - 1)")))
             .withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other"))
             .select("key", "i", "j", "own", "node", "part", "sig", "set"))

    def compare(block: pa.Table) -> pa.Table:
        a, b = block_forest(block.column("node").to_numpy(), block.column("part").to_numpy(),
                            block.column("own").to_numpy(), block.column("sig").to_pylist(),
                            [x.values.to_numpy().view(np.uint64) for x in block.column("set")],
                            block.column("key")[0].as_py(), p)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def block_forest(node: np.ndarray, part: np.ndarray, own: np.ndarray, sig: list[bytes], sets: list[np.ndarray],
                 key: int, p: Params) -> tuple[list[int], list[int]]:
    """Spanning forest of the links between nodes of different parts (and, if
    there are two chunks, of different chunks) whose first shared band has ``key``."""
    n = len(node)
    values = np.frombuffer(b"".join(sig), dtype=np.uint16).reshape(n, p.values)
    bands = np.ascontiguousarray(values).view(np.dtype((np.void, 2 * p.rows))).reshape(n, p.bands)
    band = key % p.bands
    looks = fewest_matches(p)
    two = own.min() != own.max()
    ones, others = [], []
    for u in range(n):
        v = np.arange(u + 1, n)
        v = v[(part[v] != part[u]) & ((own[v] != own[u]) if two else True)]
        if band and len(v):
            v = v[~(bands[v, :band] == bands[u, :band]).any(axis=1)]
        matches, done = np.zeros(len(v), dtype=np.int64), 0
        for upto, least in looks:
            matches += (values[v, done:upto] == values[u, done:upto]).sum(axis=1)
            v, matches, done = v[matches >= least], matches[matches >= least], upto
        ones.append(np.full(len(v), u))
        others.append(v)
    x, y = np.concatenate(ones).astype(np.int64), np.concatenate(others).astype(np.int64)
    if not len(x):
        return [], []
    common = _intersections(sets, x, y)
    length = np.array([len(s) for s in sets])
    linked = 100 * common >= p.percent * (length[x] + length[y] - common)
    root = list(range(n))

    def find(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    a, b = [], []
    for u, v in zip(x[linked].tolist(), y[linked].tolist()):
        ru, rv = find(u), find(v)
        if ru != rv:
            root[rv] = ru
            a.append(int(node[u]))
            b.append(int(node[v]))
    return a, b


def _intersections(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets[x[i]] and sets[y[i]], by products of
    membership matrices over the shingles that several sets hold."""
    length = [len(s) for s in sets]
    every, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), length)
    shared = times[at] > 1
    place = (np.cumsum(times > 1) - 1)[at[shared]]
    row = row[shared]
    order = np.argsort(place, kind="stable")
    place, row = place[order], row[order]
    total = np.zeros((len(sets), len(sets)), dtype=np.float32)
    step = 4096
    for k in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        lo, hi = np.searchsorted(place, [k, k + step])
        held = np.zeros((len(sets), step), dtype=np.float32)
        held[row[lo:hi], place[lo:hi] - k] = 1
        total += held @ held.T
    return total[x, y].astype(np.int64)


def _apart(pairs: DataFrame, parts: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different components."""
    return (pairs.join(parts.toDF("a", "ca"), "a", "left").join(parts.toDF("b", "cb"), "b", "left")
            .filter(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b"))


def _merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The components of ``parts`` joined by further links."""
    ends = (links.join(parts.toDF("a", "ca"), "a", "left").join(parts.toDF("b", "cb"), "b", "left")
            .select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    joined = connected_components(ends).toDF("part", "joined")
    known = (parts.withColumnRenamed("component", "part").join(joined, "part", "left")
             .select("node", F.coalesce("joined", "part").alias("component")))
    new = (joined.join(parts.select(F.col("node").alias("part")), "part", "left_anti")
           .select(F.col("part").alias("node"), F.col("joined").alias("component")))
    return materialize(known.unionByName(new))


def groups(df: DataFrame, id_col: str, text: str, p: Params = Params()) -> DataFrame:
    """Per row of ``df``: ``doc_id``, ``n_shingles``, ``component_id``, ``kept``."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    docs = df.select(null_safe_id(F.col(f"`{id_col}`"), content).alias("node"), content.alias("text"))
    rows, found = _components(docs, p)
    real = F.when(F.col("component") < NULL_ID_BASE, F.col("component"))
    return (rows.join(found, ["hi", "lo"], "left")
            .withColumn("component", F.coalesce("component", "node"))
            .select(F.when(F.col("node") < NULL_ID_BASE, F.col("node")).alias("doc_id"),
                    F.col("n").alias("n_shingles"), real.alias("component_id"),
                    (F.col("node") == F.col("component")).alias("kept")))


def _components(docs: DataFrame, p: Params) -> tuple[DataFrame, DataFrame]:
    """(node, n, hi, lo) per row, and (hi, lo, component) per distinct set."""
    sketched = materialize(sketches(docs, p))
    nodes = materialize(sketched.filter("n > 0").groupBy("hi", "lo")
                        .agg(F.min("node").alias("node"), F.first("sig").alias("sig")))
    bands = _bands(nodes, p)
    pivots = (bands.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("c"))
              .filter("c > 1").drop("c"))
    members = materialize(bands.join(pivots, "key"))  # buckets of two nodes or more
    stars = materialize(members.filter("a <> node").groupBy("a", F.col("node").alias("b"))
                        .agg(F.count(F.lit(1)).alias("shared")))
    # first each node with the pivot that it shares most buckets with: one pair per node
    best = materialize(stars.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("m"))).alias("x"))
                       .select((-F.col("x.m")).alias("a"), "b"))
    parts = connected_components(_verified(best, docs, nodes, p))
    # then the other pivots, where that has not joined the two
    others = _apart(stars.select("a", "b").join(best, ["a", "b"], "left_anti"), parts)
    parts = _merged(parts, _verified(others, docs, nodes, p))
    # what is left of each bucket: pairs between different components
    placed = (members.join(parts, "node", "left")
              .select("key", "node", F.coalesce("component", "node").alias("part"), "a"))
    sizes = materialize(placed.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y"),
                                                  F.count(F.lit(1)).alias("c")).filter("x <> y").select("key", "c"))
    left = materialize(placed.join(sizes, "key"))
    small = left.filter(F.col("c") <= p.small_bucket)
    one = small.select("key", F.col("node").alias("u"), F.col("part").alias("pu"), F.col("a").alias("pivot"))
    two = small.select("key", F.col("node").alias("v"), F.col("part").alias("pv"))
    # pairs with the pivot have been looked at
    rest = (one.join(two, "key").filter((F.col("pu") < F.col("pv")) & (F.col("u") != F.col("pivot"))
                                        & (F.col("v") != F.col("pivot")))
            .select(F.col("u").alias("a"), F.col("v").alias("b")).distinct())
    large = left.filter(F.col("c") > p.small_bucket).select("key", "node", "part")
    links = _verified(rest, docs, nodes, p).unionByName(_block_links(large, docs, nodes, p))
    parts = _merged(parts, links)
    whole = (nodes.select("hi", "lo", "node").join(parts, "node", "left")
             .select("hi", "lo", F.coalesce("component", "node").alias("component")))
    return sketched.select("node", "n", "hi", "lo"), whole


def deduplicate(df: DataFrame, id_col: str, text: str, p: Params = Params()) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each group the document
    with the smallest id stays, and of rows that share an id, one."""
    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    node = fresh(df, "node")
    keyed = df.withColumn(node, null_safe_id(F.col(f"`{id_col}`"), content))
    rows, found = _components(keyed.select(F.col(node).alias("node"), content.alias("text")), p)
    gone = materialize(rows.join(found, ["hi", "lo"]).filter("node <> component")
                       .select(F.col("node").alias(node)).distinct())
    stay = keyed.join(gone, node, "left_anti")
    again = materialize(rows.groupBy(F.col("node").alias(node)).count().filter("count > 1").select(node))
    if again.isEmpty():
        return stay.drop(node)
    # repeated ids: rare, and only those rows are compared
    once = stay.join(again, node, "left_anti")
    repeated = stay.join(again, node, "left_semi").dropDuplicates([node])
    return once.unionByName(repeated).drop(node)
