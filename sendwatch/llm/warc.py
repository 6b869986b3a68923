"""WARC archives: write with payload deduplication, read with a verified chain.

Writing: one record per row, as text files whose line separator is the WARC
record terminator, so Spark's own writer (and its commit protocol) produces
the archives. Rows with equal payloads of at least ``min_bytes`` bytes keep
the payload once, in the row with the smallest id; the others become revisit
records that name it.

Reading, by boundary-chain verification. Files are cut into byte ranges.
1. Every range is searched for the record magic; each hit whose header can be
   read is a candidate with the offset of its successor (header + declared
   length). Inside the range the chains are followed at once, so a candidate
   is known by its first offset beyond the range.
2. Payloads may contain the magic too, so candidates are not yet records. Only
   what is reachable from offset 0 of the file is: pointer jumping over the
   (file, offset) -> (file, exit) table, whose length doubles each round,
   finds the offset at which the chain enters every range in log2(ranges)
   rounds.
3. Every range is read again from its entry along the declared lengths.
No task holds more than a range and one record; a file may be of any size.

Edge cases: a null payload is an empty one; rows without an id are written
with an empty id, come after all others when the smallest id is sought, and
read back as null; rows that share the smallest id of a group are all
responses; line breaks in a URL are percent-encoded; an empty table writes an
archive without records; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sendwatch.llm.common import local_path, materialize

MAGIC = b"WARC/1.0\r\n"
END = "\r\n\r\n"
RANGE_BYTES = 8 << 20
STEP = 64 << 10
HEADER_BYTES = 1 << 20  # past a range, for a header that starts in it
URN = "urn:x-row:"


# ---------------------------------------------------------------- writing

def revisits(rows: DataFrame, min_bytes: int) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload is kept elsewhere.
    ``rows``: id, digest, n_bytes. Grouping is by digest with partial sums, so
    a payload that holds a third of all rows is one row per task."""
    large = rows.filter(F.col("n_bytes") >= min_bytes).select("id", "digest")
    first = (large.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count(F.lit(1)).alias("c"))
             .filter((F.col("c") > 1) & F.col("refers_to").isNotNull()).drop("c"))
    return (large.join(first, "digest")
            .filter(F.col("id").isNull() | (F.col("id") > F.col("refers_to"))).distinct())


def _header(kind: Column, row_id: Column, url: Column, digest: Column, refers_to: Column,
            length: Column, date: str) -> Column:
    """All headers up to the empty line. The block is an HTTP response whose
    Content-Length is that of the full payload, in revisits as well."""
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    length.cast("string"), F.lit(END))
    body = F.when(kind == "response", length).otherwise(F.lit(0)) + F.octet_length(http)
    name = F.coalesce(row_id.cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: "), kind,
        F.lit(f"\r\nWARC-Record-ID: <{URN}"), name, F.lit(f">\r\nWARC-Date: {date}"),
        F.when(url.isNull(), F.lit("")).otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), url)),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), digest,
        F.when(refers_to.isNull(), F.lit("")).otherwise(
            F.concat(F.lit(f"\r\nWARC-Refers-To: <{URN}"), refers_to.cast("string"), F.lit(">"))),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        body.cast("string"), F.lit(END), http)


def write(df: DataFrame, path: str, id_col: str, url_col: str, payload_col: str,
          min_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> None:
    """Archives of all rows under ``path`` (which must not exist yet)."""
    text = F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit(""))
    rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"),
                     text.alias("payload"))
    keyed = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("n_bytes", F.octet_length("payload"))
    # written first: the planner then knows its size, and broadcasts it only if it is small
    again = materialize(revisits(keyed.drop("url", "payload"), min_bytes))
    marked = keyed.alias("k").join(
        again.withColumn("revisit", F.lit(True)).alias("a"),
        F.col("k.id").eqNullSafe(F.col("a.id")) & (F.col("k.digest") == F.col("a.digest")), "left")
    kind = F.when(F.col("a.revisit"), F.lit("revisit")).otherwise(F.lit("response"))
    url = F.regexp_replace(F.regexp_replace(F.col("k.url"), "\r", "%0D"), "\n", "%0A")
    record = F.concat(
        _header(kind, F.col("k.id"), url, F.col("k.digest"), F.col("a.refers_to"),
                F.octet_length(F.col("k.payload")), date),
        F.when(kind == "response", F.col("k.payload")).otherwise(F.lit("")))
    marked.select(record.alias("value")).write.mode("error").option("lineSep", END).text(path)


# ---------------------------------------------------------------- reading

def _fields(head: bytes) -> dict[bytes, bytes]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        out[name.strip().lower()] = value.strip()
    return out


class _Reader:
    """Bytes of one file by offset, fetched in pieces."""

    def __init__(self, uri: str):
        fs, path = local_path(uri)
        self.file = fs.open_input_file(path)
        self.size = self.file.size()

    def get(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.size - at))
        return self.file.read_at(n, at) if n else b""

    def header(self, at: int, known: bytes = b"", most: int | None = None) -> bytes | None:
        """The header block at ``at`` without its empty line (which ends within
        ``most`` bytes, if given), or None."""
        data = known
        while (end := data.find(b"\r\n\r\n", 0, most)) < 0:
            if len(data) >= self.size - at or most and len(data) >= most:
                return None
            data = self.get(at, max(STEP, 2 * len(data)) if most is None else most)
        return data[:end] if data.startswith(MAGIC) else None

    def close(self) -> None:
        self.file.close()


def _successor(at: int, head: bytes) -> int | None:
    length = _fields(head).get(b"content-length", b"")
    return at + len(head) + 4 + int(length) + len(END) if length.isdigit() and len(length) < 19 else None


def candidates(uri: str, start: int, end: int, most: int = HEADER_BYTES) -> list[tuple[int, int]]:
    """(offset, successor) of every readable header whose magic starts in
    [start, end). A record starts at offset 0 or behind an empty line, so the
    header blocks of candidates do not overlap and each byte is read once. A
    header that runs on for more than ``most`` bytes past the range (one per
    range at most) has itself as successor: it is read if the chain comes there."""
    reader = _Reader(uri)
    lead = min(start, len(END))
    data = reader.get(start - lead, end - start + lead + len(MAGIC) - 1)
    out = []
    at = data.find(MAGIC, lead)
    while at >= 0:
        place = start - lead + at
        if place == 0 or data[at - len(END):at] == END.encode():
            head_end = data.find(b"\r\n\r\n", at)
            head = data[at:head_end] if head_end >= 0 else reader.header(place, data[at:], len(data) - at + most)
            if head is not None:
                if (succ := _successor(place, head)) is not None:
                    out.append((place, succ))
            elif reader.size - place > len(data) - at + most:
                out.append((place, place))
        at = data.find(MAGIC, at + 1)
    reader.close()
    return out


def exits(found: list[tuple[int, int]], end: int) -> list[tuple[int, int]]:
    """(offset, first offset on its chain that is at or beyond ``end`` or has a
    header still to be read), dead chains left out."""
    leave: dict[int, int] = {}
    for at, succ in reversed(found):
        if succ >= end or succ == at:
            leave[at] = succ
        elif succ in leave:
            leave[at] = leave[succ]
    return sorted(leave.items())


def _ranges(spark: SparkSession, path: str, range_bytes: int) -> DataFrame:
    """(file, uri, start, end): all byte ranges, dealt evenly over tasks."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
             .select(F.col("path").alias("uri"), "length").filter("length > 0"))
    cut = files.select(
        F.xxhash64("uri").alias("file"), "uri", "length",
        F.explode(F.expr(f"sequence(0L, length - 1, {range_bytes}L)")).alias("start")
    ).withColumn("end", F.least(F.col("start") + range_bytes, F.col("length")))
    return materialize(cut)


def _spread(ranges: DataFrame, n: int) -> DataFrame:
    return ranges.repartition(max(1, min(n, 20_000)), "file", "start")


def chain_entries(ranges: DataFrame, n_ranges: int, most: int, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """(file, start, entry): where the chain from offset 0 enters each range that it enters."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, uri, start, end in zip(*(b.column(c).to_pylist() for c in ("file", "uri", "start", "end"))):
                links = exits(candidates(uri, start, end, header_bytes), end)
                if links:
                    at, leave = zip(*links)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file] * len(at), pa.int64()), pa.array([start] * len(at), pa.int64()),
                         pa.array(at, pa.int64()), pa.array(leave, pa.int64())],
                        ["file", "start", "at", "leave"])

    links = materialize(_spread(ranges, n_ranges).mapInArrow(scan, "file long, start long, at long, leave long"))
    rounds = max(1, most - 1).bit_length()
    while True:
        # a chain can enter a range only at offset 0 of the file or where some chain leaves another range
        targets = links.select("file", F.col("leave").alias("at")).distinct()
        jump = materialize(links.join(targets, ["file", "at"], "left_semi")
                           .unionByName(links.filter("at = 0")).select("file", "at", "leave").distinct())
        open_ = jump.filter("at = leave").select("file", "at")
        reached = jump.filter("at = 0").select("file", "at")
        for _ in range(rounds):
            ahead = reached.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at"))
            reached = materialize(reached.unionByName(ahead).distinct())
            far = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("beyond"))
            jump = materialize(jump.join(far, ["file", "leave"], "left")
                               .select("file", "at", F.coalesce("beyond", "leave").alias("leave")))
        still = open_.join(reached, ["file", "at"], "left_semi")
        if not still.limit(1).count():
            break
        links = _read_on(links, still, ranges)
    return (links.select("file", "start", "at").join(reached, ["file", "at"])
            .groupBy("file", "start").agg(F.min("at").alias("entry")))


def _read_on(links: DataFrame, still: DataFrame, ranges: DataFrame) -> DataFrame:
    """``links`` (file, start, at, leave) with the successors of the very long
    headers at ``still``, which the chain has reached."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for uri, at in zip(b.column("uri").to_pylist(), b.column("at").to_pylist()):
                reader = _Reader(uri)
                head = reader.header(at)
                out.append(None if head is None else _successor(at, head))
                reader.close()
            yield pa.RecordBatch.from_arrays([b.column("file"), b.column("at"), pa.array(out, pa.int64())],
                                             ["file", "at", "succ"])

    found = (still.join(ranges.select("file", "uri").distinct(), "file")
             .mapInArrow(run, "file long, at long, succ long"))
    # a header that cannot be read ends its chain
    return materialize(links.join(found.withColumn("read", F.lit(True)), ["file", "at"], "left")
                       .withColumn("leave", F.when(F.col("read"), F.col("succ")).otherwise(F.col("leave")))
                       .filter("leave IS NOT NULL").select("file", "start", "at", "leave"))


RECORD = ("id long, uri string, type string, refers_to long, payload_bytes long, payload_digest string, "
          "declared_digest string, file string, offset long")


def _row_id(value: bytes | None) -> int | None:
    m = re.fullmatch(rb"<" + URN.encode() + rb"(-?\d+)>", value or b"")
    return int(m[1]) if m else None


def records_in(uri: str, entry: int, end: int, with_payload: bool) -> Iterator[tuple]:
    """The records whose header starts in [entry, end), along the chain."""
    reader = _Reader(uri)
    at = entry
    while at < end and (head := reader.header(at)) is not None and (succ := _successor(at, head)) is not None:
        fields = _fields(head)
        body = at + len(head) + 4
        block = reader.get(body, succ - len(END) - body)
        kind = fields.get(b"warc-type", b"").decode("ascii", "replace")
        payload, declared = block, len(block)
        if fields.get(b"content-type", b"").startswith(b"application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = _fields(http).get(b"content-length", b"")
            declared = int(length) if length.isdigit() else len(payload)
        stored = fields.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha256:")
        digest = stored if kind == "revisit" else hashlib.sha256(payload).hexdigest()
        url = fields.get(b"warc-target-uri")
        yield (_row_id(fields.get(b"warc-record-id")), url.decode("utf-8", "replace") if url is not None else None,
               kind, _row_id(fields.get(b"warc-refers-to")), declared if kind == "revisit" else len(payload),
               digest, stored, uri, at, *((payload,) if with_payload else ()))
        at = succ
    reader.close()


def read(spark: SparkSession, path: str, with_payload: bool = False,
         range_bytes: int = RANGE_BYTES, header_bytes: int = HEADER_BYTES) -> DataFrame:
    """One row per record (columns of RECORD; ``payload`` binary on request,
    empty in revisits). ``payload_digest`` of a response is computed from the
    bytes read; ``declared_digest`` is the header's."""
    ranges = _ranges(spark, path, range_bytes)
    total = ranges.agg(F.count(F.lit(1)), F.max(F.ceil(F.col("length") / range_bytes))).collect()[0]
    entries = chain_entries(ranges, total[0], int(total[1] or 1), header_bytes)
    schema = RECORD + (", payload binary" if with_payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, entry, end in zip(*(b.column(c).to_pylist() for c in ("uri", "entry", "end"))):
                held, size = [], 0
                for row in records_in(uri, entry, end, with_payload):
                    held.append(row)
                    size += len(row[-1]) if with_payload else 0
                    if len(held) >= 2000 or size >= 8 << 20:
                        yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=fields)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in held], schema=fields)

    todo = ranges.join(entries, ["file", "start"]).select("file", "start", "uri", "entry", "end")
    return _spread(todo, total[0]).mapInArrow(load, schema)
