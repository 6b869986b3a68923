import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tokenizers

from sendwatch.llm import huffman as H
from sendwatch.llm import separators as S
from sendwatch.llm.common import scratch_dir
from sendwatch.llm.tokens import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
TEXTS = [None, "", "Hello, World!", "it's <|endoftext|> HERE", "<|ENDOFTEXT|>", "é́ É ſ İ ΑΣ", "a\u00a0b\u2003c", "!!! ...",
         "\"quoted\" id one \"", "日本語 text", "x" * 3000, "w " * 5000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@pytest.mark.parametrize("as_text", [False, True])
def test_tokenizer_equals_library(name, as_text):
    path = public_tokenizers.path(name)
    own, lib = Tokenizer(path, as_text), tokenizers.Tokenizer.from_file(path)
    lib.encode_special_tokens = as_text
    r = random.Random(4)
    alphabet = "abcXYZ  \n\t.,'sS't\u0301éİſΣς\x1c\x85\xa0\u3000日😀0123<|endoftext|>"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(500)] + TEXTS
    got = [np.frombuffer(x, own.dtype).tolist() for x in own.encode(texts)]
    assert got == [e.ids for e in lib.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def _huffman_cost(counts):
    import heapq

    heap = [c for c in counts if c]
    heapq.heapify(heap)
    total = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        total += x
        heapq.heappush(heap, x)
    return total


def test_code_lengths():
    rng = np.random.default_rng(0)
    counts = (1e6 / np.arange(1, 300) ** 1.5).astype(np.int64) * rng.integers(0, 2, 299)
    free = H.code_lengths(counts, 40).astype(int)
    assert (free * counts).sum() == _huffman_cost(counts.tolist())
    short = H.code_lengths(counts, 9).astype(int)
    used = counts > 0
    assert short.max() <= 9 and (short[~used] == 0).all() and sum(2.0 ** -x for x in short[used].tolist()) == 1
    assert (short * counts).sum() >= (free * counts).sum()
    with pytest.raises(ValueError):
        H.code_lengths(np.ones(5, np.int64), 2)
    assert H.code_lengths(np.array([0, 7]), 5).tolist() == [0, 1]
    codes, lengths = H.canonical_codes(short), short
    texts = sorted(format(int(codes[s]), f"0{lengths[s]}b") for s in np.flatnonzero(used))
    assert not any(b.startswith(a) for a, b in zip(texts, texts[1:]))


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    counts = (1e6 / np.arange(1, 3000) ** 1.3).astype(np.int64)
    code = H.Code(H.code_lengths(counts, 16))
    ids = rng.choice(np.flatnonzero(counts), size=10_007).astype(np.uint32)
    blocks = [H.encode_block(code, ids[k:k + 1000], 64) for k in range(0, len(ids), 1000)]
    assert np.array_equal(H.decode_blocks(code, blocks, 64), ids)
    assert np.array_equal(H.decode_blocks(code, blocks[3:4], 64), ids[3000:4000])
    one = H.Code(H.code_lengths(np.array([0, 9]), 20))
    assert H.decode_blocks(one, [H.encode_block(one, np.ones(70, np.uint32), 8)], 8).tolist() == [1] * 70


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 7 % 40, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (3, "again"), (3, "again")]
    return rows, spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, part string").repartition(3)


def test_huffman_files(spark, docs):
    rows, df = docs
    p = H.Params(block_tokens=100, checkpoint_tokens=16, unit_docs=2)
    folder = scratch_dir(spark, "huffman-test")
    H.write(df, "doc_id", "text", folder, PATH, end_id=1, p=p)
    lib = tokenizers.Tokenizer.from_file(PATH)
    full, crc = H.read(spark, folder, p).collect(), H.read_crc32(spark, folder, p).collect()
    assert len(full) == len(crc) == len(rows)
    at = 0
    for r in sorted(full, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [r.doc_id for r in sorted(full, key=lambda r: r.start)]
    assert order == sorted((r[0] for r in rows), key=lambda d: (d is not None, d))
    want = sorted((d, lib.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows if d is not None)
    assert sorted((r.doc_id, list(r.ids)) for r in full if r.doc_id is not None) == want
    assert sorted((r.doc_id, r.ids_crc32) for r in crc if r.doc_id is not None) == sorted(
        (d, zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in want)


def test_huffman_empty(spark, docs):
    folder = scratch_dir(spark, "huffman-test")
    H.write(docs[1].limit(0), "doc_id", "text", folder, PATH, end_id=1)
    assert H.read(spark, folder).count() == 0


@pytest.mark.parametrize("block", [7, 1000, 1 << 20])
def test_separator_scan(spark, docs, block):
    rows, df = docs
    written = S.write(df, "doc_id", "text", scratch_dir(spark, "flat-test"), PATH, 49407)
    counts = S.scan(written.select("uri").distinct(), "<u2", 49407, block_tokens=block)
    lib = tokenizers.Tokenizer.from_file(PATH)
    lib.encode_special_tokens = True
    got = written.join(counts, ["uri", "place"]).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r.doc_id or -1, r.n_tokens) for r in got), key=key) == sorted(
        ((d or -1, len(lib.encode(t or "", add_special_tokens=False).ids)) for d, t in rows), key=key)
    assert all(r.finished for r in got) and counts.count() == len(rows)


def test_separator_tail_and_errors(spark, tmp_path):
    a, b, c = (tmp_path / x for x in "abc")
    a.write_bytes(np.array([5, 9, 9, 6, 7], "<u2").tobytes())
    b.write_bytes(b"")
    files = spark.createDataFrame([(str(a),), (str(b),)], "uri string")
    got = S.scan(files, "<u2", 9, block_tokens=2).orderBy("place").collect()
    assert [(r.place, r.start, r.n_tokens, r.finished) for r in got] == [(0, 0, 1, True), (1, 2, 0, True), (2, 3, 2, False)]
    c.write_bytes(b"odd")
    with pytest.raises(Exception, match="no whole number"):
        S.scan(spark.createDataFrame([(str(c),)], "uri string"), "<u2", 9).collect()


def test_separator_empty(spark, docs):
    written = S.write(docs[1].limit(0), "doc_id", "text", scratch_dir(spark, "flat-test"), PATH, 49407)
    assert S.scan(written.select("uri").distinct(), "<u2", 49407).count() == 0
