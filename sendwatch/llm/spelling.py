"""Spelling variant grouping by pivotal grams.

Words at one edit (a code point inserted, deleted or replaced) are found with
bigrams in a global order, rare ones first. A word's prefix is its first three
bigrams in that order. Three bigrams hold two that do not overlap; dynamic
programming picks the two disjoint ones of the prefix with the smallest total
frequency, the pivots. One edit spoils at most one pivot. If r's prefix ends no
later in the order than s's, the pivot that survives lies in s's prefix, since
a bigram of s outside it comes later than all of r's prefix (where it equals
the last one of s's prefix, it is among the first places of that bigram, which
are indexed too). So r's pivots are joined with s's prefix, never words with
words, and both ends of a near pair need only one of the two directions.

Position limits: a surviving pivot has the edit on one side, so up to and with
the pivot, or from it on, the two words are identical (its place moves by
nothing, or by the difference in length). And of the other side one half is
identical again. The join key is the hash of the identical side, the length of
the other side in r, and that half, so a key is shared by words that agree
almost everywhere, and no bucket gathers the words with a common bigram. Pairs
that meet are verified letter by letter, in time linear in their length.

Bigrams are counted in 2**16 buckets (a bigram's bucket follows from its two
code points; a bucket of several counts as one bigram, which the argument
above allows), so the order is a table of fixed size whatever the alphabet.

A word's form is its near word of the largest count (ties: the first in
code-point order) if that count is at least ``ratio`` times its own; counts
grow by the ratio along a chain of forms, so chains are short, and roots come
from pointer jumping over the words that have a form.

Edge cases: null texts have no words; a null id is read as ''; a word that
loses its only code point is no word; words with a count under ``least`` or
shorter than ``shortest`` (4 or more) are left out everywhere; repeated rows
count like others; an empty table gives no rows; other columns may have any name.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from heapq import nsmallest
from itertools import islice, pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import materialize

RUN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\xBF])+")  # [A-Za-zÀ-ÿ]+ in UTF-8
HELD_BYTES = 16_000_000
BUCKETS = 1 << 16
PREFIX = 3   # bigram length times one edit, and one
PIVOTS = 2   # one edit, and one
SPOIL = 97
USUAL = 200  # code points


def spoiled(doc_id: object, run: bytes) -> bytes:
    """The run, less one code point where the checksum of id and run asks for it."""
    h = zlib.crc32(run, zlib.crc32(b"%s:" % (b"" if doc_id is None else str(doc_id).encode())))
    if h % SPOIL:
        return run
    word = run.decode()
    k = h % len(word)
    return (word[:k] + word[k + 1:]).encode()


def word_counts(df: DataFrame, id_col: str, text: str, shortest: int, least: int) -> DataFrame:
    """(word, n) of the words of at least ``shortest`` code points with ``least`` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[bytes, int] = {}
        size = 0

        def hand_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()).cast(pa.string()),
                                              pa.array(list(total.values()), pa.int64())], ["word", "n"])
            total.clear()
            return out

        for b in batches:
            for doc_id, data in zip(b.column("doc_id").to_pylist(), b.column("text")):
                for found, n in Counter(RUN.findall(data.as_py().lower())).items():
                    if len(found) >= shortest:
                        word = spoiled(doc_id, found)
                        if len(word) - word.count(b"\xc3") >= shortest:
                            if word in total:
                                total[word] += n
                            else:
                                total[word] = n
                                size += len(word) + 100
                if size > HELD_BYTES:
                    yield hand_on()
                    size = 0
        yield hand_on()

    docs = df.select(F.col(f"`{id_col}`").cast("string").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    return (docs.filter("text IS NOT NULL").mapInArrow(run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))


def buckets_of(word: str) -> list[int]:
    """The bucket of every bigram."""
    return [(ord(a) * 31_337 + ord(b)) % BUCKETS for a, b in pairwise(word)]


def gram_frequencies(words: DataFrame) -> np.ndarray:
    """Places of every bigram bucket over all words: one row per bucket reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in batches:
            for w in b.column("word"):
                seen.update(buckets_of(w.as_py()))
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())],
                                         ["gram", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in words.select("word").mapInArrow(run, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        out[r["gram"]] = r["n"]
    return out


def prefix_of(grams: list[int], order: np.ndarray, index: bool) -> list[int]:
    """Places of the first bigrams in the global order (equal ones by place).
    ``index``: with the first places of the last of them. A pivot is among the
    first ``PREFIX`` places of its bigram, and one edit adds at most two before it."""
    places = nsmallest(PREFIX, range(len(grams)), key=lambda i: (order[grams[i]], i))
    if index:
        last = grams[places[-1]]
        places = sorted({*places, *islice((i for i, g in enumerate(grams) if g == last), PREFIX + 2)})
    return places


def pivots_of(places: list[int], cost: list[int]) -> list[int]:
    """The ``PIVOTS`` places, no two overlapping, of the smallest total cost.
    best[k]: the cheapest k places so far, with the last of them free to be followed."""
    byplace = sorted(zip(places, cost))
    best: list[list[tuple[int, tuple[int, ...]]]] = []  # per place: the cheapest choice of 0.. PIVOTS up to it
    for i, (place, c) in enumerate(byplace):
        before = next((best[j] for j in range(i - 1, -1, -1) if byplace[j][0] <= place - 2), [(0, ())])
        now = list(best[-1]) if best else [(0, ())]
        for k, (total, chosen) in enumerate(before[:PIVOTS]):
            got = (total + c, (*chosen, place))
            if k + 1 == len(now):
                now.append(got)
            else:
                now[k + 1] = min(now[k + 1], got)
        best.append(now)
    return list(best[-1][PIVOTS][1])


def keys_of(word: str, place: int, index: bool) -> list[int]:
    """Hashes under which a word is looked for by a pivot, or found by a prefix bigram (``index``)."""
    out = set()
    for side, same, rest in (("<", word[:place + 2], word[place + 2:]), (">", word[place:], word[:place])):
        for m in ((len(rest) - 1, len(rest), len(rest) + 1) if index else (len(rest),)):
            half, other = m // 2, m - m // 2
            if m >= 0 and half <= len(rest):
                out.add(f"{side}{same} {m} <{rest[:half]}")
            if m >= 0 and other <= len(rest):
                out.add(f"{side}{same} {m} >{rest[len(rest) - other:]}")
    return [xxhash.xxh3_64_intdigest(k.encode()) - (1 << 63) for k in out]


def one_edit(a: str, b: str) -> bool:
    """Whether two words differ by one code point inserted, deleted or replaced."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def _signatures(words: DataFrame, order: np.ndarray, cost: np.ndarray, index: bool) -> DataFrame:
    """(key, word, n, last): ``last`` is the end of the word's prefix in the global order."""
    handed = words.sparkSession.sparkContext.broadcast((order, cost))  # two numbers per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, costs = handed.value
        for b in batches:
            for begin in range(0, b.num_rows, 2_000):
                keys, names, counts, lasts = [], [], [], []
                part = b.slice(begin, 2_000)
                for word, n in zip(part.column("word").to_pylist(), part.column("n").to_pylist()):
                    grams = buckets_of(word)
                    places = prefix_of(grams, ranks, index)
                    last = int(max(ranks[grams[i]] for i in places))
                    if not index:
                        places = pivots_of(places, [int(costs[grams[i]]) for i in places])
                    got = {k for i in places for k in keys_of(word, i, index)}
                    keys += got
                    names += [word] * len(got)
                    counts += [n] * len(got)
                    lasts += [last] * len(got)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(names, pa.string()),
                                                  pa.array(counts, pa.int64()), pa.array(lasts, pa.int32())],
                                                 ["key", "word", "n", "last"])

    return words.select("word", "n").mapInArrow(run, "key long, word string, n long, last int")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n), a < b: all pairs of distinct ``words`` (word, n; four code points or more) at one edit."""
    cost = gram_frequencies(words)
    order = np.empty(BUCKETS, dtype=np.int32)
    order[np.lexsort((np.arange(BUCKETS), cost))] = np.arange(BUCKETS, dtype=np.int32)
    r = _signatures(words, order, cost, index=False).alias("r")
    s = _signatures(words, order, cost, index=True).alias("s")
    # words of usual length are verified within the join, longer ones (where that takes quadratic time) behind it
    close = (F.char_length("r.word") > USUAL) | (F.levenshtein(F.col("r.word"), F.col("s.word"), 1) == 1)
    # merge: the sides are many rows per word, of which Spark's estimate (the bytes of the words' file) knows nothing
    met = r.join(s.hint("merge"), (F.col("r.key") == F.col("s.key")) & (F.col("r.last") <= F.col("s.last"))
                 & (F.col("r.word") != F.col("s.word")) & close)
    first = F.col("r.word") < F.col("s.word")
    pick = lambda c, x, y: F.when(first, F.col(f"{x}.{c}")).otherwise(F.col(f"{y}.{c}"))
    pairs = met.select(pick("word", "r", "s").alias("a"), pick("n", "r", "s").alias("a_n"),
                       pick("word", "s", "r").alias("b"), pick("n", "s", "r").alias("b_n"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = [one_edit(x, y) for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist())]
            yield batch.filter(pa.array(same, pa.bool_()))

    return pairs.mapInArrow(verify, "a string, a_n long, b string, b_n long").distinct()


def roots(links: DataFrame) -> DataFrame:
    """(word, root) for ``links`` (word, form), a forest: every word's last form."""
    now = materialize(links.select("word", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = materialize(now.join(on.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.select("word", "root")
        now = new.select("word", "root")


def variants(words: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, n, n_near, form, form_n, root) for ``words`` (word, n), distinct."""
    pairs = materialize(near_pairs(words))
    both = pairs.select("a", "b", "b_n").toDF("word", "other", "other_n").union(pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"),
                                    F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("top"))
    formed = -F.col("top.m") >= ratio * F.col("n")
    found = materialize(words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(formed, F.col("top.w")).alias("form"), F.when(formed, -F.col("top.m")).alias("form_n")))
    last = roots(found.filter("form IS NOT NULL"))
    return found.join(last.hint("merge"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(df: DataFrame, id_col: str, text: str, shortest: int = 5, least: int = 3, ratio: int = 2) -> DataFrame:
    """``variants`` of the words of all texts."""
    if shortest < 4:
        raise ValueError("words of four code points or more have the three bigrams that the prefix needs")
    return variants(materialize(word_counts(df, id_col, text, shortest, least)), ratio)
