import hashlib
import uuid

import pytest

from sendwatch.llm import warc as W
from sendwatch.llm.common import scratch_dir

FAKE = ("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:x-row:666>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n")


def _brute(rows, least=100):
    out = []
    for i, _, p in rows:
        data = (p or "").encode()
        ids = [j for j, _, q in rows if (q or "") == (p or "") and j is not None]
        first = min(ids, default=None)
        again = len(data) >= least and first is not None and (i is None or i > first)
        out.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response",
                    first if again else None))
    return sorted(out, key=repr)


def _rows(df):
    return sorted(((r.id, r.payload_bytes, r.payload_digest, r.type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("range_bytes", [300, 4096, W.RANGE_BYTES])
def test_round_trip(spark, range_bytes):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 40)) for i in range(60)]
    rows += [(100, "u", FAKE * 30), (101, "u", FAKE * 30), (99, None, FAKE * 30), (102, "u", "x" * 99),
             (103, "u", "x" * 99), (104, "a\r\nWARC-Type: evil", None), (None, "n", "y" * 200), (105, "n", "y" * 200),
             (None, "n", "z" * 200), (106, "é", "ü" * 70000 + FAKE), (7, "dup", "same" * 100), (7, "dup", "same" * 100)]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, payload string")
    path = scratch_dir(spark, "warc-test")
    W.write(df.repartition(2), path, "page_id", "url", "html")
    got = W.read(spark, path, with_payload=True, range_bytes=range_bytes)
    assert _rows(got) == _brute(rows)
    for r in got.collect():
        if r.type == "response":
            assert r.payload_digest == r.declared_digest == hashlib.sha256(r.payload).hexdigest()
        else:
            assert bytes(r.payload) == b""


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    path = scratch_dir(spark, "warc-test")
    W.write(df, path, "page_id", "url", "html")
    assert W.read(spark, path).count() == 0


def test_chains(tmp_path):
    def record(body):
        head = f"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: {len(body)}\r\n\r\n".encode()
        return head + body + b"\r\n\r\n"

    bodies = [b"a" * 10, record(b"inner") * 3, b"", b"WARC/1.0\r\n", b"WARC/1.0\r\nContent-Length: 99999\r\n\r\n", b"z" * 500]
    data = b"".join(record(b) for b in bodies)
    path = tmp_path / uuid.uuid4().hex
    path.write_bytes(data)
    offsets, at = [], 0
    for b in bodies:
        offsets.append(at)
        at += len(record(b))
    found = W.candidates(str(path), 0, len(data))
    assert len(found) > len(bodies)  # the payloads hold candidates too
    chain, at, succ = [], 0, dict(found)
    while at in succ:
        chain.append(at)
        at = succ[at]
    assert chain == offsets and at == len(data)
    assert [r[8] for r in W.records_in(str(path), 0, len(data), False)] == offsets
    assert dict(W.exits(found, len(data)))[0] == len(data)


def test_payloads_full_of_magic(spark):
    """8 MB of magic lines without an empty line, candidates that never end, and headers longer than ranges."""
    import time

    lines = "WARC/1.0\r\n" * 800_000
    rows = [(1, "u", lines), (2, "u", "a\r\n\r\n" + lines), (3, "u", "WARC/1.0\r\nx: y\r\n" * 50_000),
            (4, "http://h/" + "q" * 3_000_000, "long header"), (5, "u", "end"), (6, "v" * 200_000, "x"),
            (7, "u", "\r\n\r\nWARC/1.0\r\nContent-Length: 7\r\n" + "z" * 5_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    path = scratch_dir(spark, "warc-test")
    W.write(df, path, "page_id", "url", "html")
    begin = time.monotonic()
    for range_bytes in (1 << 20, W.RANGE_BYTES):
        got = W.read(spark, path, range_bytes=range_bytes)
        assert _rows(got) == _brute(rows)
    assert time.monotonic() - begin < 90


def test_headers_past_the_bound_are_read_on_the_chain(spark):
    rows = [(i, "h" * (40 + 700 * (i % 3)), f"<p>{i}</p>" * (i % 9)) for i in range(40)]
    path = scratch_dir(spark, "warc-test")
    W.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(2), path, "page_id", "url", "html")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    ends = [W.candidates(f.path, k, min(k + 300, f.length), 64) for f in files for k in range(0, f.length, 300)]
    assert any(at == succ for found in ends for at, succ in found)
    assert _rows(W.read(spark, path, range_bytes=300, header_bytes=64)) == _brute(rows)
