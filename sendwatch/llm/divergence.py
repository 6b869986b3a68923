"""Source divergence audit with a frequent-pattern tree of term rows.

Terms are ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` with A-Z lower-cased; a
language keeps those in at least ``least_docs`` of its documents. A group (a
language's source) or a whole language gives a kept term the share
p = 1 + floor(SCALE (count + 1) / (N + V)), and f(p, q) = floor((p - q)^2 / q).

``pairs``: f(p of a source, q of another) summed over all kept terms. Most
counts are zero, so the sum is

    V f(p0, q0) + sum over terms of the one source [f(p, q0) - f(p0, q0)]
    + sum over terms of the other [f(p0, q) - f(p0, q0)]
    + sum over terms of both [f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)]

with p0, q0 the shares of a term that does not occur. The first three need
only how often each share occurs in a source. The last comes from the tree: a
term's row lists its sources in order with their shares; equal rows are one
row with a multiplicity; a node stands for a prefix shared by rows, and its
correction against each ancestor is computed once, times the number of terms
below it. Rows are dealt by ranges, so that shared prefixes meet in a task;
in row order only the current path of the tree is held. A prefix that spans
two tasks is two nodes whose multiplicities add up to the same sum.

``terms``: the kept terms that a source uses more than its language, with
f(p of the source, q of the language), to ``top`` ranks.

All arithmetic is on integers: 64 bits hold every f (shares are at most about
SCALE, so squares stay under 2 * 10**18); sums and products with counts use
decimals of 38 digits.

Edge cases: null language, source and text are read as ''; a group without
terms is a group with N = 0; a language without kept terms gives its pairs the
value 0; an empty table gives no rows; a term is in a document once however
often it occurs; other columns may have any name. A term's row has at most as
many entries as its language has sources.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendwatch.llm.common import materialize, text_slices

SCALE = 1_000_000_000
HELD_TERMS = 200_000  # distinct terms that a task counts before it hands them on
HELD_PAIRS = 400_000  # node-ancestor combinations computed at a time
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """Terms of a UTF-8 text (every byte of a character past U+007F belongs to a term)."""
    return text.translate(_FOLD).split()


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, df): occurrences and documents. Every group has
    a row, with the empty term and n = 0 where a task found no term of it."""
    names = ["lang", "source", "term", "n", "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        size = 0

        def hand_on() -> Iterator[pa.RecordBatch]:
            for (la, so), (n, docs) in held.items():
                found = list(n) or [b""]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([la] * len(found), pa.string()), pa.array([so] * len(found), pa.string()),
                     pa.array(found, pa.binary()).cast(pa.string()), pa.array([n[w] for w in found], pa.int64()),
                     pa.array([docs[w] for w in found], pa.int64())], names)
            held.clear()

        for b in batches:
            for la, so, data in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text")):
                n, docs = held.setdefault((la, so), (Counter(), Counter()))
                found = terms_of(data.as_py())
                size -= len(n)
                n.update(found)
                docs.update(set(found))
                size += len(n)
                if size > HELD_TERMS:
                    yield from hand_on()
                    size = 0
        yield from hand_on()

    plain = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("text"))
    return (docs.mapInArrow(run, "lang string, source string, term string, n long, df long")
            .groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df")))


def share(n: Column, total: Column, kept: Column) -> Column:
    wide = F.lit(SCALE).cast("decimal(10,0)") * (n + 1).cast("decimal(19,0)")
    return F.call_function("div", wide, (total + kept).cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _wide(x: Column) -> Column:
    return x.cast("decimal(38,0)")


def _apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def corrections(rows: DataFrame) -> DataFrame:
    """(lang, a, b, value): the correction of f(p of source a, q of source b)
    over terms of both. ``rows``: lang, row (array of struct s, p, p0 in
    source order), m (terms that have the row), sorted inside partitions."""
    names = ["lang", "a", "b", "value"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = None
        path: list[list[int]] = []  # s, p, p0, terms below
        above: list[tuple[list[int], ...]] = []
        nodes: list[tuple[int, int, int, int, int]] = []
        sums: dict[tuple[int, int], int] = {}
        n_held = 0

        def compute() -> None:
            """Corrections of the node-ancestor combinations held, both ways."""
            nonlocal n_held
            if not nodes:
                return
            s, p, p0 = (np.fromiter((x for part in above for x in part[i]), np.int64, n_held) for i in range(3))
            depth = [n[4] for n in nodes]
            t, q, q0, m = (np.repeat(np.array([n[i] for n in nodes], np.int64), depth) for i in range(4))
            for one, two, value in (
                    (s, t, _apart(p, q) - _apart(p, q0) - _apart(p0, q) + _apart(p0, q0)),
                    (t, s, _apart(q, p) - _apart(q, p0) - _apart(q0, p) + _apart(q0, p0))):
                order = np.lexsort((two, one))
                one, two, value = one[order], two[order], (value * m)[order]
                first = np.flatnonzero(np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])]))
                for a, b, v in zip(one[first].tolist(), two[first].tolist(), np.add.reduceat(value, first).tolist()):
                    sums[a, b] = sums.get((a, b), 0) + v
            above.clear()
            nodes.clear()
            n_held = 0

        def leave(depth: int) -> None:
            """Close the nodes of the path below ``depth``."""
            nonlocal n_held
            while len(path) > depth:
                s, p, p0, m = path.pop()
                if path:
                    path[-1][3] += m
                    above.append(tuple([x[i] for x in path] for i in range(3)))
                    nodes.append((s, p, p0, m, len(path)))
                    n_held += len(path)
            if n_held > HELD_PAIRS:
                compute()

        def hand_on() -> pa.RecordBatch:
            rows_ = list(sums.items())
            sums.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(rows_), pa.string()), pa.array([k[0] for k, _ in rows_], pa.int32()),
                 pa.array([k[1] for k, _ in rows_], pa.int32()),
                 pa.array([Decimal(v) for _, v in rows_], pa.decimal128(38, 0))], names)

        for batch in batches:
            column = batch.column("row")
            flat = column.flatten()
            s, p, p0 = (flat.field(i).to_pylist() for i in range(3))
            ends = np.cumsum(column.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            begin = 0
            for la, m, end in zip(batch.column("lang").to_pylist(), batch.column("m").to_pylist(), ends):
                if la != lang or len(sums) > HELD_PAIRS:
                    leave(0)
                    compute()
                    if sums:
                        yield hand_on()
                    lang = la
                same, most = 0, min(len(path), end - begin)
                while same < most and path[same][0] == s[begin + same] and path[same][1] == p[begin + same]:
                    same += 1
                leave(same)
                path.extend([s[i], p[i], p0[i], 0] for i in range(begin + same, end))
                path[-1][3] += m
                begin = end
        leave(0)
        compute()
        if sums:
            yield hand_on()

    return rows.select("lang", "row", "m").mapInArrow(run, "lang string, a int, b int, value decimal(38,0)")


def audit(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 3,
          top: int = 200) -> tuple[DataFrame, DataFrame]:
    """(pairs, terms): lang, source, item, value, rank (from 1 per lang and
    source; value descending, then item)."""
    counts = materialize(term_counts(df, text, lang, source))
    kept = materialize(counts.filter("term <> ''").groupBy("lang", "term")
                       .agg(F.sum("df").alias("df"), F.sum("n").alias("n"), F.collect_list(F.struct("source", "n")).alias("by"))
                       .filter(F.col("df") >= least_docs).select("lang", "term", "n", "by"))
    spread = kept.select("lang", "term", F.col("n").alias("n_lang"), F.inline("by"))
    whole = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("n").alias("total_lang"))
    numbered = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("int")
    groups = (counts.groupBy("lang", "source").agg(F.lit(0).alias("_")).drop("_")
              .join(spread.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
              .join(whole, "lang", "left").na.fill(0, ["total", "kept", "total_lang"]).withColumn("s", numbered))
    total, v = F.col("total"), F.col("kept")
    groups = materialize(groups.withColumn("p0", F.when(v > 0, share(F.lit(0).cast("long"), total, v))))
    items = materialize(spread.join(groups, ["lang", "source"]).select(
        "lang", "source", "term", "s", "p0", share(F.col("n"), total, v).alias("p"),
        share(F.col("n_lang"), F.col("total_lang"), v).alias("q")))

    rows = materialize(items.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("s", "p", "p0"))).alias("row"))
                       .groupBy("lang", "row").agg(F.count(F.lit(1)).alias("m")))
    both = corrections(rows.repartitionByRange("lang", "row").sortWithinPartitions("lang", "row"))
    one = groups.select("lang", F.col("s").alias("a"), F.col("p0").alias("a0"), "kept")
    two = groups.select("lang", F.col("s").alias("b"), F.col("p0").alias("b0"))
    base = one.join(two, "lang").filter("a <> b").select("lang", "a", "b", F.coalesce(
        _wide(apart(F.col("a0"), F.col("b0"))) * F.col("kept"), _wide(F.lit(0))).cast("decimal(38,0)").alias("value"))
    shares = (items.groupBy("lang", F.col("s").alias("a"), F.col("p0").alias("a0"), "p")
              .agg(F.count(F.lit(1)).alias("m")).join(two, "lang").filter("a <> b"))
    p, a0, b0, m = F.col("p"), F.col("a0"), F.col("b0"), F.col("m")
    single = shares.select("lang", F.inline(F.array(
        F.struct("a", "b", _wide((apart(p, b0) - apart(a0, b0)) * m).alias("value")),
        F.struct(F.col("b").alias("a"), F.col("a").alias("b"), _wide((apart(b0, p) - apart(b0, a0)) * m).alias("value")))))
    summed = (base.unionByName(single).unionByName(both).groupBy("lang", "a", "b")
              .agg(F.sum("value").cast("long").alias("value")))
    names = groups.select("lang", "s", "source")
    named = (summed.join(names.withColumnRenamed("s", "a"), ["lang", "a"])
             .join(names.select("lang", F.col("s").alias("b"), F.col("source").alias("item")), ["lang", "b"]))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    columns = ["lang", "source", "item", "value", "rank"]
    pairs = named.withColumn("rank", F.row_number().over(best)).select(*columns)
    terms = (items.filter("p > q").select("lang", "source", F.col("term").alias("item"), apart(p, F.col("q")).alias("value"))
             .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top).select(*columns))
    return pairs, terms
