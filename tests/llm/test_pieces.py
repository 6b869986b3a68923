import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from sendwatch.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def enc():
    return pieces.Encoder(PATH)


def _texts():
    r = random.Random(1)
    alphabet = "abcdefghijklmnop qrstuvwxyz  \n\t.,ABC日本▁é\x00😀\u0301<0x0A></s>"
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, 120))) for _ in range(600)] + [
        "", " ", "  ", "\n", "a\nb", " " * 333, "a" * 500, "x" * 1000 + " " + "hello " * 50, "</s><s>", "▁▁x", "a  "]


def test_agenda_equals_library(enc):
    texts = _texts()
    want = [i + [2] for i in enc.library.encode(texts, num_threads=1)]
    got = list(enc.encode(texts))
    assert [i.tolist() for i, _ in got] == want
    assert [s for _, s in got] == [" ".join(map(str, i)) for i in want]
    assert enc.differed == 0  # the library's check never had to correct
    assert [sum((enc.merge_heap(c) for c in enc.chunks(t)), []) + [2] for t in texts] == want
    assert enc.decode(want) == enc.library.decode(want)


def test_memo_generations(enc, monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_BYTES", 8_000)
    texts = _texts()[:100]
    for k in range(0, 100, 5):
        got = [i.tolist() for i, _ in enc.encode(texts[k:k + 5])]
        assert got == [i + [2] for i in enc.library.encode(texts[k:k + 5], num_threads=1)]


def test_frames(spark, enc):
    rows = [(1, "Hello world"), (None, None), (2, ""), (2, ""), (3, "é" * 3000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    lib = enc.library
    want = sorted((d or -1, lib.encode(t or "", add_eos=True)) for d, t in rows)
    out = pieces.encode(df, "text", PATH, keep=["doc_id"])
    assert sorted((r.doc_id or -1, list(r.ids)) for r in out.collect()) == want
    digests = pieces.digests(df, "doc_id", "text", PATH, with_ids=True).collect()
    assert sorted((r.doc_id or -1, list(r.ids)) for r in digests) == want
    for r in digests:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(list(r.ids)).encode()).hexdigest()
    assert pieces.digests(df.limit(0), "doc_id", "text", PATH).count() == 0


def test_memo_is_compact(enc, monkeypatch):
    """The memo holds numbers into arrays, no ids as objects, and stays within two generations."""
    import tracemalloc

    r = random.Random(2)
    texts = ["".join(r.choice("abcdefghij") for _ in range(8)) for _ in range(60_000)]
    monkeypatch.setattr(pieces, "MEMO_BYTES", 6_000_000)
    fresh = pieces.Encoder(PATH)
    tracemalloc.start()
    for k in range(0, len(texts), 5_000):
        got = list(fresh.encode([" ".join(texts[k:k + 5_000])]))
    del got
    used, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert used < 3 * 6_000_000
    assert len(fresh.memo[0]) + len(fresh.older[0]) > 20_000
    ids, bounds = fresh.encode_flat([texts[0], None, "", texts[-1]])
    want = [fresh.library.encode(t) + [2] for t in (texts[0], "", "", texts[-1])]
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == want
    assert [len(x) for x in fresh.encode_flat([])] == [0, 1] and fresh.differed == 0


def test_pair_table(enc):
    left, right = (np.array(x, np.int64) for x in zip(*[(k >> 20, k & 0xFFFFF) for k in enc.pairs]))
    rank, merged = enc._look_up(left, right)
    assert list(zip(rank.tolist(), merged.tolist())) == list(enc.pairs.values())
    names = enc.names
    assert all(names[left] + names[right] == names[i] for left, right, (_, i) in zip(
        left.tolist(), right.tolist(), enc.pairs.values()) if max(left, right) < len(names))
    none = enc._look_up(np.array([-1, 5, 1 << 18]), np.array([3, -7, 1 << 18]))
    assert (none[0] == pieces.NEVER).all()
