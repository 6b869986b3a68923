"""Quality rules as weak supervision, in DataFrame functions only.

Every rule reads a few counts of the whole text and votes good (1), bad (-1)
or abstains (0). Instead of asking that all rules pass, expectation-
maximisation estimates from the votes of all documents how often each rule
casts each vote on good and on bad documents (class-conditional vote
probabilities, so a rule that fires on one kind of junk is not outvoted by the
rules that do not look at it). The posterior probability of "good" given all
votes replaces the all-must-pass filter.

The estimation runs on the table of distinct vote patterns with their counts,
at most 3**len(RULES) rows whatever the corpus size: one aggregation over the
documents, then a small aggregation per iteration whose one result row (the
expected counts) is all that reaches the driver.

Words are ``[^\\x20\\x09-\\x0D]+``. Counts per text:

* ``n_words``, ``word_chars`` (code points in words),
* ``n_symbols`` (characters of ``[#*$%&|<>]``),
* ``n_dup_lines`` (lines with a word, equal to an earlier line),
* ``n_repeat_words`` (words inside 5-word windows that occur twice or more in
  the text, the first occurrence included).

Edge cases: null and empty texts have no words, fail the base rule and are not
kept; an empty table gives no rows and fits no model; null or repeated ids are
ordinary rows (all decisions are made on the row itself); columns of the input
may have any name.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import fresh, materialize

WINDOW = 5
SPACE = " \t\n\x0b\f\r"
VOTES = (-1, 0, 1)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines",
          "n_unique", "n_letters", "n_upper", "n_digits", "n_marks")


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are evaluated exactly once per row: a generator over a
    one-element array keeps the optimizer from copying the expressions into
    every place (and filter) that uses them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def with_counts(df: DataFrame, text: str, counts: str) -> DataFrame:
    """``df`` with one struct column ``counts`` holding ``COUNTS``."""
    words, lines, letters, hashes, basic = (fresh(df, f"{counts}_{k}")
                                            for k in ("words", "lines", "letters", "hashes", "basic"))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    trimmed = F.btrim(t, F.lit(SPACE))
    nothing = F.array().cast("array<string>")
    df1 = _once(df, **{
        words: F.when(trimmed == "", nothing).otherwise(F.split(trimmed, "[ \\t\\n\\x0B\\f\\r]+")),
        lines: F.filter(F.split(t, "\\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != ""),
        letters: F.regexp_replace(t, "\\P{L}+", ""),
    })
    w = f"`{words}`"
    n = F.size(words)
    windows = F.expr(f"transform(sequence(1, size({w}) - {WINDOW - 1}), i -> xxhash64("
                     + ", ".join(f"element_at({w}, i + {k})" if k else f"element_at({w}, i)"
                                 for k in range(WINDOW)) + "))")
    df2 = _once(df1, **{
        hashes: F.when(n > WINDOW, windows).otherwise(F.array().cast("array<bigint>")),
        basic: F.struct(
            n.cast("long").alias("n_words"),
            F.char_length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(t, F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.array_distinct(words)).cast("long").alias("n_unique"),
            F.char_length(letters).cast("long").alias("n_letters"),
            F.char_length(F.regexp_replace(letters, "\\P{Lu}+", "")).cast("long").alias("n_upper"),
            F.regexp_count(t, F.lit("[0-9]")).cast("long").alias("n_digits"),
            F.regexp_count(t, F.lit("[!?]")).cast("long").alias("n_marks"),
        ),
    })
    h = f"`{hashes}`"
    # Only texts with an equal pair of windows pay for the sort: windows sorted by hash, those equal
    # to a neighbour kept by position, then the union of [p, p + 5) over the kept positions.
    starts = (f"transform(array(array_sort(transform({h}, (x, i) -> named_struct('h', x, 'i', i)))), s -> "
              "sort_array(transform(filter(s, (x, i) -> (i > 0 AND s[i - 1].h = x.h) OR "
              "(i < size(s) - 1 AND s[i + 1].h = x.h)), x -> x.i)))")
    covered = (f"aggregate(flatten(transform({starts}, f -> zip_with(f, slice(f, 2, size(f)), "
               f"(a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))))), 0L, (s, x) -> s + x)")
    repeat = F.when(F.size(F.array_distinct(hashes)) < F.size(hashes), F.expr(covered)).otherwise(F.lit(0))
    got = {k: F.col(f"`{basic}`.{k}") for k in COUNTS if k != "n_repeat_words"}
    got["n_repeat_words"] = repeat.cast("long")
    df3 = _once(df2, **{counts: F.struct(*[got[k].alias(k) for k in COUNTS])})
    return df3.drop(words, lines, letters, hashes, basic)


def base_failed(c: dict[str, Column]) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def _ratio(a: Column, b: Column) -> Column:
    return a / F.greatest(b, F.lit(1))


def _vote(x: Column, bad: Column, good: Column) -> Column:
    return F.when(x.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0).cast("byte")


def rules(c: dict[str, Column]) -> dict[str, Column]:
    """The rules' votes. Limits are generous on both sides: between them a rule abstains."""
    symbols = _ratio(c["n_symbols"], c["n_words"])
    alpha = _ratio(c["n_letters"], c["word_chars"])
    upper = _ratio(c["n_upper"], c["n_letters"])
    unique = _ratio(c["n_unique"], c["n_words"])
    length = _ratio(c["word_chars"], c["n_words"])
    dup = _ratio(c["n_dup_lines"], c["n_lines"])
    repeat = _ratio(c["n_repeat_words"], c["n_words"])
    digits = _ratio(c["n_digits"], c["word_chars"])
    marks = _ratio(c["n_marks"], c["n_words"])
    long_enough = c["n_words"] >= 50
    return {
        "symbols": _vote(symbols, symbols > 0.1, symbols <= 0.02),
        "letters": _vote(alpha, alpha < 0.8, alpha >= 0.9),
        "capitals": _vote(upper, upper > 0.5, upper <= 0.2),
        "variety": _vote(unique, long_enough & (unique < 0.2), unique >= 0.4),
        "word_length": _vote(length, (length < 2.5) | (length > 12), (length >= 3.5) & (length <= 8)),
        "duplicate_lines": _vote(dup, dup > 0.5, dup <= 0.2),
        "repetition": _vote(repeat, repeat > 0.2, repeat <= 0.1),
        "digits": _vote(digits, digits > 0.5, digits <= 0.2),
        "marks": _vote(marks, marks > 0.5, marks <= 0.1),
    }


RULE_NAMES = ("symbols", "letters", "capitals", "variety", "word_length", "duplicate_lines",
              "repetition", "digits", "marks")


@dataclass(frozen=True)
class VoteModel:
    """``prior``: share of good documents. ``good[rule][v]``, ``bad[rule][v]``:
    probability of vote v (index into VOTES) by class."""

    prior: float
    good: tuple[tuple[float, ...], ...]
    bad: tuple[tuple[float, ...], ...]

    def log_odds(self, votes: list[Column]) -> Column:
        total = F.lit(0.0)
        first = math.log(self.prior) - math.log1p(-self.prior)
        for column, g, b in zip(votes, self.good, self.bad, strict=True):
            # array literals: every round of the EM runs the same generated code
            weights = [first + math.log(pg) - math.log(pb) for pg, pb in zip(g, b, strict=True)]
            total = total + F.element_at(F.lit(weights), column + F.lit(2))
            first = 0.0
        return total

    def posterior(self, votes: list[Column]) -> Column:
        return 1 / (1 + F.exp(-self.log_odds(votes)))


def accuracies(model: VoteModel) -> dict[str, float]:
    """Per rule: probability that its vote is right, given that it votes."""
    out = {}
    for name, g, b in zip(RULE_NAMES, model.good, model.bad, strict=True):
        right = model.prior * g[2] + (1 - model.prior) * b[0]
        voted = right + model.prior * g[0] + (1 - model.prior) * b[2]
        out[name] = right / voted if voted else 0.0
    return out


def fit(patterns: DataFrame, rounds: int = 40, tolerance: float = 1e-6, strength: float = 10.0,
        start: float = 0.95, per_document: bool = True) -> VoteModel | None:
    """EM over ``patterns`` (a byte column per rule of RULE_NAMES and ``n``).

    Starts from "good with probability ``start`` unless a rule votes bad".
    ``strength``: weight of GOOD_PRIOR and BAD_PRIOR. With ``per_document`` it
    is multiplied by the documents of the class, so the priors keep the same
    share at every size; without, it is a number of pseudo-documents, which
    fades as the class grows and leaves the rates to the votes. Rules look at
    different faults and are not independent, and with hardly any prior the
    estimate of a few hundred documents may settle on one kind of fault and
    take the others for good. None for an empty table."""
    votes = [F.col(k) for k in RULE_NAMES]
    any_bad = votes[0] == -1
    for v in votes[1:]:
        any_bad = any_bad | (v == -1)
    posterior = F.when(any_bad, F.lit(1 - start)).otherwise(F.lit(start))
    # one number per rule and vote; -1 for the totals
    cells = F.array(F.lit(-1), *[v.cast("int") + F.lit(3 * i + 1) for i, v in enumerate(votes)])
    model = None
    last = None
    for _ in range(rounds):
        q = _once(patterns.coalesce(1), q=posterior).select(F.col("n"), F.col("q"), F.explode(cells).alias("cell"))
        sums = {}
        for r in q.groupBy("cell").agg(F.sum(F.col("n") * F.col("q")).alias("good"),
                                       F.sum(F.col("n") * (1 - F.col("q"))).alias("bad")).collect():
            sums |= {f"g{r['cell']}": r["good"], f"b{r['cell']}": r["bad"]}
        if not sums:
            return None
        model = _model(sums, strength, per_document)
        flat = [model.prior, *(p for part in (*model.good, *model.bad) for p in part)]
        if last is not None and max(abs(a - b) for a, b in zip(flat, last)) < tolerance:
            break
        last = flat
        posterior = model.posterior(votes)
    return model


# What the rules are built for, as vote probabilities in the order of VOTES: a good document is
# hardly ever voted bad, and a bad one is mostly bad in one way, so that most rules still vote good.
GOOD_PRIOR = (0.001, 0.049, 0.95)
BAD_PRIOR = (0.1, 0.1, 0.8)


def _model(sums: dict[str, float], strength: float, per_document: bool) -> VoteModel:
    good_n, bad_n = float(sums["g-1"]), float(sums["b-1"])

    def rates(prefix: str, rule: int, n: float, prior: tuple[float, ...]) -> tuple[float, ...]:
        weight = strength * n + 1 if per_document else strength
        return tuple((float(sums.get(f"{prefix}{3 * rule + i}", 0.0)) + weight * x) / (n + weight)
                     for i, x in enumerate(prior))

    rules_ = range(len(RULE_NAMES))
    return VoteModel((good_n + 1) / (good_n + bad_n + 2),
                     tuple(rates("g", k, good_n, GOOD_PRIOR) for k in rules_),
                     tuple(rates("b", k, bad_n, BAD_PRIOR) for k in rules_))


def judge(df: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5,
          verdict: str = "quality") -> tuple[DataFrame, VoteModel | None]:
    """Columns ``keep`` (default: all) of ``df`` and the struct column
    ``verdict`` (the counts, ``base_failed``, ``posterior``, ``kept``). These
    rows are written once under the checkpoint folder. ``kept``: the base rule
    passed and the posterior is at or over ``threshold``."""
    counts = fresh(df, "counts")
    columns = [F.col(f"`{k}`") for k in (df.columns if keep is None else keep)]
    counted = materialize(with_counts(df, text, counts).select(*columns, counts))
    return _judged(counted, counts, threshold, verdict)


def _judged(counted: DataFrame, counts: str, threshold: float, verdict: str
            ) -> tuple[DataFrame, VoteModel | None]:
    c = {k: F.col(f"`{counts}`.{k}") for k in COUNTS}
    votes = rules(c)
    patterns = materialize(counted.select(*[v.alias(k) for k, v in votes.items()])
                           .groupBy(*RULE_NAMES).agg(F.count(F.lit(1)).alias("n")).coalesce(1))
    model = fit(patterns, per_document=False)
    posterior = model.posterior([votes[k] for k in RULE_NAMES]) if model else F.lit(None).cast("double")
    failed = base_failed(c)
    kept = ~failed & (posterior >= threshold)
    out = counted.withColumn(verdict, F.struct(
        *[c[k].alias(k) for k in COUNTS], failed.alias("base_failed"),
        posterior.alias("posterior"), F.coalesce(kept, F.lit(False)).alias("kept"))).drop(counts)
    return out, model
