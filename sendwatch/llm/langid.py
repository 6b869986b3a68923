"""Language identification with hyperdimensional profiles.

Every letter has a random bipolar vector, drawn from a generator seeded with
the letter's code point, so nothing needs to be stored or shared. An n-gram is
bound from its letters' vectors: the vector of the letter at place i, rotated
n - 1 - i positions, multiplied element by element. A text is the bundle (sum)
of its n-grams' vectors; a language prototype is the bundle of its training
texts. A document gets the language whose prototype has the largest cosine
with its vector.

A bundle is linear in n-gram counts, so a batch of documents is one product of
a count matrix with the vectors of the n-grams that occur in it. Training
needs only the counts per language of each task's texts; a task emits one
vector per language, and these are summed in Spark: one prototype per
language, ``dimensions`` numbers each, reaches the driver.

Letters are Unicode letters, lower-cased; runs of anything else are one
boundary symbol, which is also set before and after the text.

Edge cases: a null text or one without a letter is ``und`` with score 0;
without any training text every document is ``und``; ties go to the
alphabetically first language; training rows with a null language are left
out; repeated rows are ordinary rows; other columns may have any name.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import text_slices
from sendwatch.llm.worker import state

UNKNOWN = "und"
BITS = 21  # of a code point
# distinct n-gram vectors kept per worker before the memo is renewed
MEMO = 12_000
SLICE_CHARS = 300_000


@dataclass(frozen=True)
class Params:
    order: int = 3           # letters in an n-gram; at most 3 fit the packed form
    dimensions: int = 1024
    seed: int = 7
    max_languages: int = 1_000  # a larger number of labels is an error, not a cut


_LETTERS = np.zeros(0x110000, dtype=np.int8)  # 0 not looked at, 1 letter, 2 other


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, 0 for each run of anything else
    and at both ends; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    kinds = _LETTERS[codes]
    if not kinds.all():
        for c in np.unique(codes[kinds == 0]).tolist():
            _LETTERS[c] = 1 if unicodedata.category(chr(c))[0] == "L" else 2
        kinds = _LETTERS[codes]
    letter = kinds == 1
    if not letter.any():
        return np.empty(0, dtype=np.int64)
    codes = np.concatenate([[0], np.where(letter, codes, 0), [0]])
    return codes[np.concatenate([[True], (codes[1:] != 0) | (codes[:-1] != 0)])]


def ngrams_of(text: str | None, p: Params) -> tuple[np.ndarray, np.ndarray]:
    """(packed n-grams, counts) of a text."""
    codes = letters_of(text or "")
    n = len(codes) - p.order + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    packed = np.zeros(n, dtype=np.int64)
    for i in range(p.order):
        packed = packed << BITS | codes[i:i + n]
    return np.unique(packed, return_counts=True)


class Vectors:
    """Vectors of n-grams, memoised."""

    def __init__(self, p: Params):
        self.p = p
        self.letters: dict[int, np.ndarray] = {}
        self.rows: dict[int, np.ndarray] = {}

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            bits = np.random.default_rng([self.p.seed, code]).integers(0, 2, self.p.dimensions)
            self.letters[code] = (2 * bits - 1).astype(np.int8)
        return self.letters[code]

    def ngram(self, packed: int) -> np.ndarray:
        out = np.ones(self.p.dimensions, dtype=np.int8)
        for place in range(self.p.order):  # from the last letter: rotated by its distance from the end
            out = out * np.roll(self.letter(packed >> (BITS * place) & ((1 << BITS) - 1)), place)
        return out

    def of(self, ngrams: np.ndarray) -> np.ndarray:
        """One float32 row per n-gram."""
        if len(self.rows) > MEMO:
            self.rows.clear()
            self.letters.clear()
        out = np.empty((len(ngrams), self.p.dimensions), dtype=np.float32)
        rows = self.rows
        for i, g in enumerate(ngrams.tolist()):
            row = rows.get(g)
            if row is None:
                row = self.ngram(g)
                if len(rows) <= MEMO:
                    rows[g] = row
            out[i] = row
        return out


def vectors(p: Params) -> Vectors:
    return state("langid", p, lambda: Vectors(p))


def bundles(texts: list[str | None], p: Params) -> np.ndarray:
    """One vector per text (zeros where there is no n-gram)."""
    got = [ngrams_of(t, p) for t in texts]
    out = np.zeros((len(texts), p.dimensions), dtype=np.float32)
    if not any(len(g) for g, _ in got):
        return out
    every = np.unique(np.concatenate([g for g, _ in got]))
    v = vectors(p)
    step = 4096  # n-grams at a time: bounded whatever the alphabet
    for k in range(0, len(every), step):
        part = every[k:k + step]
        counts = np.zeros((len(texts), len(part)), dtype=np.float32)
        for i, (g, c) in enumerate(got):
            lo, hi = np.searchsorted(g, part[0]), np.searchsorted(g, part[-1], side="right")
            counts[i, np.searchsorted(part, g[lo:hi])] = c[lo:hi]
        out += counts @ v.of(part)
    return out


def train(df: DataFrame, text: str, language: str, p: Params = Params()) -> dict[str, np.ndarray]:
    """Prototype (unit vector) per language over all rows of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        counts: dict[str, dict[int, int]] = {}

        def fold() -> None:
            for lang, seen in counts.items():
                grams = np.fromiter(seen.keys(), dtype=np.int64, count=len(seen))
                n = np.fromiter(seen.values(), dtype=np.float64, count=len(seen))
                vector = total.setdefault(lang, np.zeros(p.dimensions))
                for k in range(0, len(grams), 4096):
                    vector += n[k:k + 4096] @ vectors(p).of(grams[k:k + 4096])
            counts.clear()

        for whole in batches:
            for b in text_slices(whole, "text", SLICE_CHARS):
                by_language: dict[str, list[str]] = {}
                for t, lang in zip(b.column("text").to_pylist(), b.column("lang").to_pylist()):
                    by_language.setdefault(lang, []).append(t)
                for lang, texts in by_language.items():
                    got = [ngrams_of(t, p) for t in texts]
                    grams, at = np.unique(np.concatenate([g for g, _ in got]), return_inverse=True)
                    sums = np.bincount(at, weights=np.concatenate([c for _, c in got]).astype(np.float64),
                                       minlength=len(grams))
                    seen = counts.setdefault(lang, {})
                    for g, n in zip(grams.tolist(), sums.tolist()):
                        seen[g] = seen.get(g, 0) + n
                if sum(map(len, counts.values())) > 200_000:
                    fold()
        fold()
        for lang, vector in total.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * p.dimensions, pa.string()), pa.array(np.arange(p.dimensions), pa.int32()),
                 pa.array(vector, pa.float64())], ["lang", "place", "value"])

    labelled = df.select(F.col(f"`{text}`").alias("text"), F.col(f"`{language}`").cast("string").alias("lang"))
    summed = (labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
              .mapInArrow(run, "lang string, place int, value double")
              .groupBy("lang", "place").agg(F.sum("value").alias("value"))
              .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "value"))).alias("v")))
    rows = summed.limit(p.max_languages + 1).collect()
    if len(rows) > p.max_languages:
        raise ValueError(f"more than {p.max_languages} language labels")
    out = {}
    for r in sorted(rows, key=lambda r: r["lang"]):
        v = np.array([x["value"] for x in r["v"]])
        if np.any(v):
            out[r["lang"]] = v / np.linalg.norm(v)
    return out


def predictor(prototypes: dict[str, np.ndarray], p: Params = Params()):
    """Function of an Arrow string array: (languages, scores)."""
    names = sorted(prototypes)
    matrix = np.array([prototypes[k] for k in names], dtype=np.float32).reshape(len(names), p.dimensions)

    def predict(texts: pa.Array) -> tuple[list[str], np.ndarray]:
        vecs = bundles(texts.to_pylist(), p)
        norm = np.linalg.norm(vecs, axis=1)
        if not names:
            return [UNKNOWN] * len(vecs), np.zeros(len(vecs))
        cosine = (vecs @ matrix.T) / np.maximum(norm, 1e-30)[:, None]
        best = cosine.argmax(axis=1)
        score = np.clip(cosine[np.arange(len(best)), best].astype(np.float64), 0, 1)
        known = norm > 0
        return ([names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist())],
                np.where(known, score, 0.0))

    return predict


def predict(df: DataFrame, text: str, prototypes: dict[str, np.ndarray], keep: list[str],
            language: str = "lang_pred", score: str = "score", p: Params = Params()) -> DataFrame:
    """Columns ``keep`` of ``df``, ``language`` and ``score``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    fields = [df.schema[k] for k in keep]
    schema = StructType([*fields, StructField(language, StringType()), StructField(score, DoubleType())])
    arrow = to_arrow_schema(schema)
    handed = df.sparkSession.sparkContext.broadcast(prototypes)  # languages x dimensions numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = predictor(handed.value, p)
        for whole in batches:
            for b in text_slices(whole, "__text", SLICE_CHARS):
                names, scores = judge(b.column("__text"))
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(i) for i in range(len(keep))), pa.array(names, pa.string()),
                     pa.array(scores, pa.float64())], schema=arrow)

    cols = [F.col(f"`{k}`") for k in keep]
    return df.select(*cols, F.col(f"`{text}`").alias("__text")).mapInArrow(run, schema)


def held_out(id_col: Column) -> Column:
    """Rows kept from training: CRC-32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


def keep_known(df: DataFrame, text: str, prototypes: dict[str, np.ndarray], least: float,
               p: Params = Params()) -> DataFrame:
    """The rows of ``df`` whose language is recognised: not ``und``, score ``least`` or more."""
    handed = df.sparkSession.sparkContext.broadcast(prototypes)

    @F.pandas_udf("boolean")
    def known(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        judge = predictor(handed.value, p)
        for series in texts:
            batch = pa.RecordBatch.from_arrays([pa.array(series, pa.string(), from_pandas=True)], ["text"])
            out = [np.empty(0, dtype=bool)]
            for b in text_slices(batch, "text", SLICE_CHARS):
                names, scores = judge(b.column("text"))
                out.append((np.array(names, dtype=object) != UNKNOWN) & (scores >= least))
            yield pd.Series(np.concatenate(out).astype(bool))

    return df.filter(known(F.col(f"`{text}`")))
