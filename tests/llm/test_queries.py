"""Columns of the registered queries over the smallest table, against plain Python and the libraries."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest

from sendwatch.llm import queries as Q
from sendwatch.llm import sharding
from tests.conftest import SF_SMALL
from tests.llm import brute
from tests.llm.test_pipeline import _vector


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}


def rows(spark, name):
    return Q.queries()[name](spark, SF_SMALL).collect()


def test_op3_counts(spark, docs):
    for r in rows(spark, "op3_weak_supervision"):
        want = brute.quality_counts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.kept and r.base_failed)


def test_op5_and_op7_tokens(spark, docs):
    import tokenizers

    lib = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {d: [*lib.encode(r.text or "", add_special_tokens=False).ids, 1] for d, r in docs.items()}
    start = 0
    got = {r.doc_id: r for r in rows(spark, "op7_huffman_ids")}
    for d in sorted(docs):
        crc = zlib.crc32(np.array(ids[d], "<u4").tobytes())
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids[d]), crc)
        start += len(ids[d])
    lib.encode_special_tokens = True
    counts = {d: len(lib.encode(r.text or "", add_special_tokens=False).ids) for d, r in docs.items()}
    flat = {r.doc_id: r.n_tokens for r in rows(spark, "op5_separator_scan")}
    assert flat == counts or flat == {d: n + 1 for d, n in counts.items()}


def test_op6_languages(spark, docs):
    from sendwatch.llm import langid

    v, memo = langid.Vectors(langid.Params()), {}
    held = {d: zlib.crc32(str(d).encode()) % 4 == 2 for d in docs}
    vectors = {d: _vector(r.text, v, memo) for d, r in docs.items()}
    prototypes = {}
    for d, r in docs.items():
        if not held[d] and r.lang is not None and r.text is not None:
            prototypes[r.lang] = prototypes.get(r.lang, 0) + vectors[d]
    for r in rows(spark, "op6_hyperdimensional"):
        x = vectors[r.doc_id]
        cosines = {k: x @ p / max(np.linalg.norm(x) * np.linalg.norm(p), 1e-30) for k, p in prototypes.items()}
        assert r.held_out == held[r.doc_id]
        assert r.score == pytest.approx(max(0, max(cosines.values())), abs=1e-4)
        assert cosines[r.lang_pred] == pytest.approx(max(cosines.values()), abs=1e-4)


def test_op9_sharding(spark, docs):
    keys = sharding.round_keys(0)
    n = len(docs)
    h = 1
    while 4 ** h < n:
        h += 1
    mask = (1 << h) - 1

    def walk(x):
        while True:
            left, right = x >> h, x & mask
            for k in keys:
                v = (right + k) % 2147483647
                v = (v * v + k) % 2147483647
                left, right = right, left ^ ((v * (k | 1) % 2147483647) & mask)
            x = left << h | right
            if x < n:
                return x

    place = {d: walk(i) for i, d in enumerate(sorted(docs))}
    for r in rows(spark, "op9_feistel_sharding"):
        data = (docs[r.doc_id].text or "").encode()
        p = place[r.doc_id]
        assert tuple(r[c] for c in ("size", "text_crc32", "law", "shard", "slot", "grown_shard")) == (
            len(data) + 1, zlib.crc32(data), "rows", p % 8, p // 8, None)


def test_op10_pieces(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for r in rows(spark, "op10_sentencepiece"):
        ids = sp.encode(docs[r.doc_id].text or "", add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)))
