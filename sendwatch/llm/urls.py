"""URL filter: rules first, else naive Bayes over segmented host and path tokens.

Host labels run words together ("cheappills"). Words of the pages' visible
text, and the parts of host labels that hyphens cut, give unigram counts, and a
Viterbi search finds the most probable split of every distinct host label:
candidate words are joined with the counts by Spark, the search itself sees one
label at a time. A multinomial naive Bayes model then scores the host's words
and the path's tokens of the URLs that no rule decides. It learns from those
that a rule decides: what the rules block and allow are the examples, so the
filter needs no list of bad words and follows the rules it is given.

Everything row-like is joined by host or by the path's tokens, of which the
distinct ones are few, never collected: counts, labels and models are tables.

Edge cases: a null URL or one without "://" has empty host and path, meets no
rule and no token, and gets the more frequent class; rules that tie in length
go to the alphabetically first; a label without a known word is one word if
that is cheapest; a label of any length is split whole; pages without text
add no counts; without any URL that a rule decides every URL is allowed; empty
tables give no rows; repeated and null ids are ordinary rows.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import materialize, text_slices

STRETCH = 1000  # characters of a host label whose candidate words are listed together

# (rule, verdict)
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"),
         ("net/es/", "block"), ("net/fr/", "block"))


@dataclass(frozen=True)
class Params:
    longest_word: int = 20
    label_count: int = 100    # what a hyphened part of a host counts as, beside one occurrence in a text
    smoothing: float = 1.0    # of the naive Bayes counts


def with_parts(df: DataFrame, url: str, host: str, path: str) -> DataFrame:
    """``df`` with columns ``host`` (A-Z lower-cased) and ``path``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    u = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    lowered = F.translate(F.regexp_extract(u, pattern, 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return df.withColumn(host, lowered).withColumn(path, F.regexp_extract(u, pattern, 2))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits, else nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        site, _, rest = text.partition("/")
        fits = ((host == site) | host.endswith("." + site)) & path.startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; every run of digits becomes 0."""
    parts = F.split(F.regexp_replace(F.lower(text), r"[0-9]+", "0"), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda x: x != "")


_HIDDEN = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_WORD = re.compile(r"[^\W\d_]+")


def word_counts(df: DataFrame, markup: str, hosts: DataFrame, p: Params = Params()) -> DataFrame:
    """(word, n): unigram counts of the visible text, and of the parts of
    hyphened labels of the distinct ``host`` of ``hosts``. Each task sums its
    own counts before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen.keys()), pa.string()),
                                              pa.array(list(seen.values()), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for whole in batches:
            for b in text_slices(whole, "markup"):
                for t in b.column("markup").to_pylist():
                    if t:
                        seen.update(_WORD.findall(entities.unescape(_HIDDEN.sub(" ", t)).lower()))
                if len(seen) > 500_000:
                    yield rows()
        yield rows()

    counted = (df.select(F.col(f"`{markup}`").alias("markup")).mapInArrow(run, "word string, n long")
               .filter(F.char_length("word") <= p.longest_word))
    cut = F.filter(F.split("host", "[.]"), lambda x: x.contains("-"))
    parts = (hosts.select(F.explode(cut).alias("label")).select(F.explode(tokens(F.col("label"))).alias("word"))
             .filter((F.char_length("word") <= p.longest_word) & (F.col("word") != "0"))
             .select("word", F.lit(p.label_count).cast("long").alias("n")))
    return counted.unionByName(parts).groupBy("word").agg(F.sum("n").alias("n"))


def split_words(label: str, found: list[tuple[int, int, int]], total: float, longest: int) -> list[str]:
    """Most probable split of ``label``. ``found``: (place, length, count) of the
    known words in it. An unknown word of k letters has probability 10**-k / total;
    ties go to the split with the longer last word."""
    n = len(label)
    known = {(at, k): math.log(c / total) for at, k, c in found}
    best = [0.0] + [-math.inf] * n
    came = [0] * (n + 1)
    for end in range(1, n + 1):
        for k in range(min(end, longest), 0, -1):
            score = best[end - k] + known.get((end - k, k), -math.log(total) - k * math.log(10))
            if score > best[end]:
                best[end], came[end] = score, end - k
    out = []
    while n:
        out.append(label[came[n]:n])
        n = came[n]
    return out[::-1]


def segmented(labels: DataFrame, counts: DataFrame, p: Params = Params()) -> DataFrame:
    """(label, words) of the distinct ``label`` column of ``labels``."""
    total = float(counts.agg(F.sum("n")).collect()[0][0] or 1)
    # a row per stretch of a label, then one per candidate, which carries the label's number
    labels = materialize(labels.select("label").withColumn("id", F.monotonically_increasing_id()))
    starts = F.expr(f"sequence(0, greatest(char_length(label) - 1, 0), {STRETCH})")
    stretch = labels.select("id", "label", F.explode(starts).alias("b")).select(
        "id", "b", F.expr(f"substring(label, b + 1, {STRETCH + p.longest_word - 1})").alias("part"))
    inside = stretch.filter("part <> ''").select("id", "b", F.explode(F.expr(
        f"""flatten(transform(sequence(1, least({STRETCH}, char_length(part))), i -> transform(
            sequence(1, least({p.longest_word}, char_length(part) - i + 1)),
            k -> named_struct('at', i - 1, 'k', k, 'word', substring(part, i, k)))))""")).alias("s")
    ).select("id", (F.col("b") + F.col("s.at")).alias("at"), "s.k", "s.word")
    hits = (inside.join(counts, "word").groupBy("id")
            .agg(F.collect_list(F.struct("at", "k", "n")).alias("found")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names, found = b.column("label").to_pylist(), b.column("found").to_pylist()
            out = [split_words(x, [(f["at"], f["k"], f["n"]) for f in fs or []], total, p.longest_word)
                   for x, fs in zip(names, found)]
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array(out, pa.list_(pa.string()))],
                                             ["label", "words"])

    return labels.join(hits, "id", "left").select("label", "found").mapInArrow(run, "label string, words array<string>")


def _host_words(hosts: DataFrame, counts: DataFrame, p: Params) -> DataFrame:
    """(host_key, word): the segmented words of every distinct host, repeated words repeated."""
    pieces = hosts.select("host_key", F.posexplode(tokens(F.col("host"))).alias("i", "label"))
    split = materialize(segmented(pieces.select("label").distinct(), counts, p))
    return pieces.join(split, "label").select("host_key", F.explode("words").alias("word"))


def judge(df: DataFrame, url: str, markup: str, keep: list[str], rules=RULES, p: Params = Params(),
          teaches: Column | None = None) -> DataFrame:
    """Columns ``keep`` of ``df``, ``host``, ``path``, ``rule``, ``verdict`` and
    the method's ``log_odds`` of "block" (for URLs with a rule as well).
    ``teaches``: of the URLs that a rule decides, those that the model learns
    from (a condition on ``host`` and ``path``; default: all)."""
    rows = with_parts(df.select(*[F.col(f"`{k}`").alias(f"keep_{i}") for i, k in enumerate(keep)],
                                F.col(f"`{url}`").alias("url")), "url", "host", "path").drop("url")
    rule, said = rule_of(F.col("host"), F.col("path"), rules)
    example = F.when(F.lit(True) if teaches is None else teaches, (said == "block").cast("int"))
    # rows per word carry digests of host and path, which may be long
    rows = materialize(rows.withColumn("tokens", F.array_join(tokens(F.col("path")), " ")).withColumn("block", example)
                       .withColumn("host_key", F.md5("host")).withColumn("path_key", F.md5("tokens")))
    pages = materialize(rows.groupBy("host_key", "path_key", "block").agg(
        F.count(F.lit(1)).alias("n"), F.min("host").alias("host"), F.min("tokens").alias("tokens")))
    hosts = pages.groupBy("host_key").agg(F.min("host").alias("host"))
    counts = materialize(word_counts(df, markup, hosts, p))
    words = materialize(_host_words(hosts, counts, p))
    # tokens of both fields by class, and the classes' sizes
    labelled = pages.filter("block IS NOT NULL")
    by_host = labelled.groupBy("host_key", "block").agg(F.sum("n").alias("n"))
    by_path = labelled.groupBy("path_key", "block").agg(F.sum("n").alias("n"), F.min("tokens").alias("tokens"))
    host_tokens = by_host.join(words, "host_key").select(F.concat(F.lit("h:"), "word").alias("token"), "block", "n")
    path_words = F.filter(F.split("tokens", " "), lambda x: x != "")
    path_tokens = by_path.select(F.explode(path_words).alias("word"), "block", "n").select(
        F.concat(F.lit("p:"), "word").alias("token"), "block", "n")
    table = materialize(host_tokens.unionByName(path_tokens).groupBy("token").agg(
        F.sum(F.col("n") * F.col("block")).alias("blocked"), F.sum(F.col("n") * (1 - F.col("block"))).alias("allowed")))
    sizes = by_host.agg(F.sum(F.col("n") * F.col("block")), F.sum(F.col("n") * (1 - F.col("block")))).collect()[0]
    sums = table.agg(F.sum("blocked"), F.sum("allowed"), F.count(F.lit(1))).collect()[0]
    nb, na = (float(x or 0) for x in sizes)
    tb, ta, v = (float(x or 0) for x in sums)
    a = p.smoothing
    prior = math.log((nb + 1) / (na + 1)) if nb + na else 0.0
    weights = table.select("token", (F.log((F.col("blocked") + a) / (tb + a * v))
                                     - F.log((F.col("allowed") + a) / (ta + a * v))).alias("w"))
    host_score = materialize(words.withColumn("token", F.concat(F.lit("h:"), "word")).join(weights, "token")
                             .groupBy("host_key").agg(F.sum("w").alias("host_w")))
    keys = pages.groupBy("path_key").agg(F.min("tokens").alias("tokens"))
    path_score = materialize(keys.select("path_key", F.explode(path_words).alias("word"))
                             .withColumn("token", F.concat(F.lit("p:"), "word")).join(weights, "token")
                             .groupBy("path_key").agg(F.sum("w").alias("path_w")))
    odds = F.lit(prior) + F.coalesce("host_w", F.lit(0.0)) + F.coalesce("path_w", F.lit(0.0))
    return (rows.join(host_score, "host_key", "left").join(path_score, "path_key", "left")
            .select(*[F.col(f"keep_{i}").alias(k) for i, k in enumerate(keep)], "host", "path", rule.alias("rule"),
                    F.coalesce(said, F.when(odds > 0, "block").otherwise("allow")).alias("verdict"),
                    odds.alias("log_odds")))
