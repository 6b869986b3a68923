"""Corpus pipeline: stages over ``documents``, each on all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which ``run`` writes as Parquet and rereads as the next
stage's docs. All but the last return the columns of docs (the filtering
stages take any columns besides ``doc_id``, ``text`` and ``lang``).

Null texts fail the quality rules; rows with null or repeated ids pass through
the filters like any other, but of rows that share an id near-dedup keeps one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendwatch.llm import decontam, langid, neardup, pieces, quality
from sendwatch.llm.common import fresh, materialize, share_package, table

# a document's cosine with its language's prototype; texts of a few words in a known language exceed it
LEAST_LANGUAGE_SCORE = 0.1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those that fail the base rule or whose posterior
    probability of being good is under a half."""
    verdict = fresh(docs, "verdict")
    judged, _ = quality.judge(docs, "text", verdict=verdict)
    return judged.filter(F.col(f"`{verdict}`.kept")).drop(verdict)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go: those in no language that the labelled documents teach."""
    share_package(spark)
    prototypes = langid.train(docs.filter(~langid.held_out(F.col("doc_id"))), "text", "lang")
    return langid.keep_known(docs, "text", prototypes, LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (similarity 0.8 or more) the document
    with the smallest id stays. A pair at 0.8 shares no band with probability 8e-5."""
    share_package(spark)
    return neardup.deduplicate(docs, "doc_id", "text", neardup.Params(percent=80, bands=40, rows=7, batch=40))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, "doc_id", "text", table(spark, sf_dir, "benchmark"), "item_id", "text")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and digests of the ids and of their decoding."""
    share_package(spark)
    return pieces.digests(docs, "doc_id", "text", public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("sentencepiece", sentencepiece),
]

# EM over votes, a trained language profile, MinHash and SentencePiece have no SQL form;
# the pipeline is tested against brute-force versions of its stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
