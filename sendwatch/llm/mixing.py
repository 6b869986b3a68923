"""Mixing sources to target weights by capped water-filling, in DataFrame functions only.

Sources in code-point order (null last) take the weights in turn and share a
budget of ``share`` times all words. A source's target is its part of the
budget by weight, but at most ``epochs`` times its words: water-filling clamps
the sources that are above their cap, hands the excess to the others by weight
and repeats until none is above. Each round is one aggregation over the table
of sources; two numbers reach the driver. A clamped source stays clamped, so
the rounds end.

A source is then taken ``floor(target / words)`` whole times, and once more
for a seeded part of its documents: in the order of a hash of seed, id and
text, a document is in while the words before it and half of its own fit into
the rest of the target. So a source's taken words miss its target by at most
half of one document. The document at which a source stops is found by radix
selection on the hash: words per source and three hex digits, then the same
inside the one bucket where the rest ends, then a running sum over the few
hashes left there. Nothing is sorted whole, whatever a source's share of the
rows. Rows that agree in id and text share a hash; where a source stops among
such rows they are numbered per partition of the written table.

Edge cases: a null text has size 0, as has one of white space; a source
without words has target 0; null is a source of its own, apart from ''; an
empty table gives no rows; a budget of ``epochs`` times all words or more
clamps every source; null or repeated ids are ordinary rows; equal rows are
interchangeable; input columns may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sendwatch.llm.common import global_row_numbers, materialize

WORD = r"[^\x20\x09-\x0D]+"
DIGITS = 3  # hex digits of the hash that a radix step looks at
STEPS = 2


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Null as '', any other source behind a '='."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def targets(sources: DataFrame, weights: tuple[float, ...], share: float, epochs: float) -> DataFrame:
    """``sources`` (key, source_size) with ``target``."""
    ranked = global_row_numbers(sources.withColumn("last", F.col("key") == ""), ["last", "key"], "place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                          (F.col("place") % len(weights) + 1).cast("int"))
    held = materialize(ranked.withColumn("weight", weight).drop("last", "place"))
    total, open_weight = held.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = rest = share * (total or 0)
    size, w = F.col("source_size"), F.col("weight")
    while True:  # rest / open_weight: what a unit of weight gets; it only grows
        above = size * F.lit(float(epochs)) * F.lit(float(open_weight or 0)) < w * F.lit(float(rest))
        clamped, still = held.agg(F.sum(F.when(above, size)), F.sum(F.when(~above, w))).first()
        now = (budget - epochs * (clamped or 0), still or 0)
        if now == (rest, open_weight or 0):
            break
        rest, open_weight = now
        if not open_weight:
            break
    cap = size * F.lit(float(epochs))
    by_weight = w * F.lit(float(rest)) / F.lit(float(open_weight)) if open_weight else cap
    return held.select("key", "source_size", F.when(above, cap).otherwise(by_weight).alias("target"))


def _cuts(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """(key, cut, quota, copies) for each source with a fractional part: of its
    hashes, those before ``cut`` are in, and ``quota`` of the ``copies`` rows at it."""
    level = goals.filter("rest > 0").select("key", "rest", F.lit("").alias("prefix"), F.lit(0).cast("long").alias("base"))
    inside = rows.select("key", "hash", "size")
    for step in range(1, STEPS + 1):
        digits = F.substring("hash", 1, step * DIGITS)
        before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("bucket").rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0))
        # written first, so that rows are dealt by bucket and a source's window has 16**DIGITS rows at most
        sums = materialize(inside.groupBy("key", digits.alias("bucket")).agg(F.sum("size").alias("words")))
        level = materialize(sums.join(level, "key").withColumn("base", F.col("base") + before)
                            .filter("base <= rest AND rest < base + words")
                            .select("key", "rest", F.col("bucket").alias("prefix"), "base"))
        inside = (inside.withColumn("prefix", digits).join(level.select("key", "prefix"), ["key", "prefix"], "left_semi")
                  .drop("prefix"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("hash").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0))
    few = materialize(inside.groupBy("key", "hash").agg(F.sum("size").alias("words"), F.max("size").alias("size"),
                                                        F.count(F.lit(1)).alias("copies")))
    last = (few.join(level, "key").withColumn("base", F.col("base") + before)
            .filter("base <= rest AND rest < base + words"))
    return materialize(last.select("key", F.col("hash").alias("cut"), "copies",
                                   F.floor((F.col("rest") - F.col("base")) / F.col("size") + 0.5).alias("quota")))


def _copy_numbers(rows: DataFrame) -> DataFrame:
    """``rows`` with ``copy``: numbers from 0 of the rows of a source, across partitions."""
    part = F.shiftright("place", 33)
    rows = rows.withColumn("part", part)
    counts = rows.groupBy("key", "part").agg(F.count(F.lit(1)).alias("n"))
    offsets = counts.select("key", "part", F.coalesce(F.sum("n").over(
        Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("offset"))
    number = F.row_number().over(Window.partitionBy("key", "part").orderBy("place")) - 1
    return (rows.withColumn("copy", number).join(offsets, ["key", "part"])
            .withColumn("copy", F.col("copy") + F.col("offset")).drop("part", "offset"))


def mix(df: DataFrame, id_col: str, text: str, source: str, keep: dict[str, str], weights: tuple[float, ...],
        share: float = 1.5, epochs: float = 2.0, seed: int = 0) -> DataFrame:
    """A row per row of ``df``: its columns ``keep`` (name in ``df``: name in
    the result), ``size``, ``source_size``, ``target`` of its source,
    ``repeats`` and ``taken`` (``repeats`` times ``size``)."""
    if not weights or min(weights) <= 0 or share < 0 or epochs <= 0:
        raise ValueError("weights and epochs must be positive, share not negative")
    t = F.col(f"`{text}`")
    known = F.concat_ws(":", F.lit(str(seed)), F.col(f"`{id_col}`").cast("string"), F.md5(F.coalesce(t, F.lit(""))))
    kept = F.struct(F.lit(0).alias("_"), *[F.col(f"`{k}`").alias(v) for k, v in keep.items()])
    held = materialize(df.select(kept.alias("kept"), source_key(F.col(f"`{source}`")).alias("key"),
                                 words_of(t).alias("size"), F.md5(known).alias("hash"))
                       .withColumn("place", F.monotonically_increasing_id()))
    sources = held.groupBy("key").agg(F.sum("size").alias("source_size"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = materialize(targets(sources, weights, share, epochs).withColumn("whole", whole.cast("long"))
                        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")))
    cuts = _cuts(held.filter("size > 0"), goals)
    rows = held.join(goals.join(cuts, "key", "left"), "key")
    split = (F.col("hash") == F.col("cut")) & (F.col("quota") > 0) & (F.col("quota") < F.col("copies"))
    split = F.coalesce(split & (F.col("size") > 0), F.lit(False))
    more = F.coalesce((F.col("hash") < F.col("cut")) | ((F.col("hash") == F.col("cut")) & (F.col("quota") > 0)),
                      F.lit(False)).cast("int")
    plain = rows.filter(~split).withColumn("more", more)
    # written first, or the window would keep the join's dealing by source
    shared = _copy_numbers(materialize(rows.filter(split))).withColumn("more", (F.col("copy") < F.col("quota")).cast("int"))
    every = plain.unionByName(shared.select(*plain.columns))
    repeats = (F.col("whole") + F.col("more")).cast("long")
    return every.select(*[F.col(f"kept.`{v}`").alias(v) for v in keep.values()], "size", "source_size", "target",
                        repeats.alias("repeats"), (repeats * F.col("size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: every row of ``mixed`` as often as ``repeats`` says."""
    n = F.col("repeats").cast("int")
    return mixed.withColumn("repeat", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(
        F.array().cast("array<int>"))))
