"""Token-id files under a canonical length-limited Huffman code.

One code for the whole corpus: ids are counted over all documents (summed per
task before the shuffle; one count per vocabulary entry reaches the driver),
the package-merge algorithm gives the optimal code lengths of at most
``max_bits``, and canonical codes follow from the lengths alone, which are all
that ``codebook`` stores.

Documents are written in ascending id order, each with an end id; texts are
tokenised once, the order is a range exchange over their ids, and every task
writes one file:

    magic, u32 tokens per block, u32 tokens per checkpoint
    blocks: u32 tokens, u32 words, u32 bit offset of every checkpoint, code words
    index: u64 offset of each block; i64 id, u8 id is null, i64 tokens of each document
    trailer: u64 offset of the index, u64 blocks, u64 documents, magic

Blocks decode independently. Inside a block, all checkpoints decode in step:
one table look-up of ``max_bits`` bits gives symbol and length for each of
them. A folder's ``manifest`` names the files of successful tasks, in order.

Edge cases: null and empty texts hold the end id alone; rows without an id
come first; a document may span any number of blocks; repeated ids are
ordinary documents; an empty table gives no files; a vocabulary of which one
entry occurs gets a code of one bit; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sendwatch.llm.common import local_path, scratch_dir, text_slices
from sendwatch.llm.tokens import SLICE_CHARS, PartFile, part_number, record_batch, tokenizer

MAGIC = b"HUFIDS01"


@dataclass(frozen=True)
class Params:
    max_bits: int = 18
    block_tokens: int = 1 << 16
    checkpoint_tokens: int = 256
    unit_docs: int = 1024  # documents that a reading task takes at a time


# ------------------------------------------------------------------- the code

def code_lengths(counts: np.ndarray, max_bits: int) -> np.ndarray:
    """Optimal code lengths (0 where the count is 0) by package-merge."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weight = counts[used].astype(np.float64)
    leaf_flags = []
    level = np.empty(0)
    for _ in range(max_bits):
        packages = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weight, packages])
        order = np.argsort(both, kind="stable")
        level = both[order]
        leaf_flags.append(order < n)
    lengths = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for is_leaf in reversed(leaf_flags):
        leaves = int(is_leaf[:take].sum())
        lengths[:leaves] += 1
        take = 2 * (take - leaves)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), dtype=np.uint64)
    code = previous = 0
    for s, n in zip(used.tolist(), lengths[used].tolist()):
        code <<= n - previous
        codes[s] = code
        code, previous = code + 1, n
    return codes


class Code:
    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.codes = canonical_codes(lengths)
        self.bits = int(lengths.max(initial=1))
        # one table of symbol << 5 | length: a single look-up per id
        self.table = np.ones(1 << self.bits, dtype=np.uint32)
        if self.bits > 24 or len(lengths) > 1 << 27:
            raise ValueError("codes of at most 24 bits and ids under 2**27")
        used = np.flatnonzero(lengths)
        used = used[np.lexsort((used, lengths[used]))]
        spans = 1 << (self.bits - self.lengths[used])
        total = int(spans.sum())
        self.table[:total] = np.repeat((used << 5 | self.lengths[used]).astype(np.uint32), spans)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(big-endian 32-bit code words, bit offset of every id)."""
        n = self.lengths[ids]
        at = np.cumsum(n) - n
        word = at >> 5
        shifted = self.codes[ids] << (64 - (at & 31) - n).astype(np.uint64)
        out = np.zeros(int((at[-1] + n[-1] + 31) >> 5) + 1, dtype=np.uint64)
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        # codes do not overlap, so adding them is or-ing them
        out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
        out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4"), at

    def decode(self, words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Ids of all lanes joined: lane i has counts[i] ids from bit starts[i].
        Lanes run in step, so counts should be alike."""
        words = np.append(words.astype(np.uint64), np.zeros(2, np.uint64))
        pairs = words[:-1] << np.uint64(32) | words[1:]
        out = np.zeros((int(counts.max(initial=0)), len(starts)), dtype=np.uint32)
        at = starts.astype(np.int64).copy()
        down = np.uint64(64 - self.bits)
        live = np.argsort(-counts, kind="stable")
        at, left = at[live], counts[live]
        for k in range(out.shape[0]):
            n = int(np.searchsorted(-left, -k, side="left"))  # lanes with more than k ids
            now = at[:n]
            code = (pairs[now >> 5] << (now & 31).astype(np.uint64)) >> down
            out[k, :n] = got = self.table[code]
            now += got & np.uint32(31)
        flat = np.empty((len(starts), out.shape[0]), dtype=np.uint32)
        flat[live] = out.T
        return flat[np.arange(out.shape[0]) < counts[:, None]] >> np.uint32(5)


def encode_block(code: Code, ids: np.ndarray, every: int) -> bytes:
    words, at = code.encode(ids)
    return (struct.pack("<II", len(ids), len(words)) + at[::every].astype("<u4").tobytes() + words.tobytes())


def decode_blocks(code: Code, blocks: list[bytes], every: int) -> np.ndarray:
    """Ids of consecutive blocks; all their checkpoints are lanes."""
    words, starts, counts, base = [], [], [], 0
    for b in blocks:
        n, size = struct.unpack_from("<II", b)
        lanes = -(-n // every)
        at = np.frombuffer(b, "<u4", lanes, 8).astype(np.int64)
        words.append(np.frombuffer(b, ">u4", size, 8 + 4 * lanes))
        starts.append(at + 32 * base)
        counts.append(np.minimum(every, n - every * np.arange(lanes)))
        base += size
    return code.decode(np.concatenate(words), np.concatenate(starts), np.concatenate(counts))


# ------------------------------------------------------------------- writing

WIDE = np.dtype("<u4")
NARROW = np.dtype("<u2")


def tokenised(docs: DataFrame, model_path: str, end_id: int) -> DataFrame:
    """(doc_id, tie, wide, ids): the ids of each text as bytes, end id included;
    ``wide`` ids take four bytes, others two. Written once, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(model_path)
        wide = tok.dtype == WIDE or end_id >> 16 > 0
        end = np.array([end_id], dtype=WIDE if wide else NARROW).tobytes()
        for whole in batches:
            for b in text_slices(whole, "text", SLICE_CHARS):
                ids = tok.encode(b.column("text").to_pylist())
                if wide and tok.dtype != WIDE:
                    ids = [np.frombuffer(x, tok.dtype).astype(WIDE).tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("tie"), pa.array([wide] * b.num_rows, pa.bool_()),
                     pa.array([x + end for x in ids], pa.binary())], ["doc_id", "tie", "wide", "ids"])

    path = scratch_dir(docs.sparkSession, "tables")
    (docs.withColumn("tie", F.monotonically_increasing_id())
     .mapInArrow(run, "doc_id long, tie long, wide boolean, ids binary")
     .write.option("compression", "zstd").parquet(path))
    return docs.sparkSession.read.parquet(path)


def _ids(data: bytes, wide: bool) -> np.ndarray:
    return np.frombuffer(data, dtype=WIDE if wide else NARROW)


def count_ids(tokens: DataFrame) -> np.ndarray:
    """Occurrences of every id."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for wide in (False, True):
                data = b"".join(b.filter(pc.equal(b.column("wide"), wide)).column("ids").to_pylist())
                n = np.bincount(_ids(data, wide))
                if len(n) > len(total):
                    total = np.pad(total, (0, len(n) - len(total)))
                total[:len(n)] += n
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen])], schema=schema)

    rows = (tokens.select("wide", "ids").mapInArrow(run, "id long, n long")
            .groupBy("id").agg(F.sum("n").alias("n")).collect())
    out = np.zeros(max([r["id"] for r in rows], default=0) + 1, dtype=np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


class _Writer:
    def __init__(self, folder: str, code: Code, p: Params):
        self.file = PartFile(folder, part_number(), ".huf")
        self.file.write(MAGIC + struct.pack("<II", p.block_tokens, p.checkpoint_tokens))
        self.code, self.p = code, p
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = 0
        self.blocks: list[int] = []
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, len(ids)))
        self.held.append(ids)
        self.n_held += len(ids)
        self.tokens += len(ids)
        if self.n_held >= self.p.block_tokens:
            self._flush(last=False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, np.uint32)
        size = self.p.block_tokens
        end = len(ids) if last else len(ids) // size * size
        for k in range(0, end, size):
            self.blocks.append(self.file.size)
            self.file.write(encode_block(self.code, ids[k:min(k + size, end)], self.p.checkpoint_tokens))
        self.held = [ids[end:].copy()]
        self.n_held = len(ids) - end

    def close(self) -> tuple:
        self._flush(last=True)
        index = self.file.size
        self.file.write(np.array(self.blocks, dtype="<u8").tobytes())
        self.file.write(np.array([d or 0 for d, _ in self.docs], dtype="<i8").tobytes())
        self.file.write(np.array([d is None for d, _ in self.docs], dtype="u1").tobytes())
        self.file.write(np.array([n for _, n in self.docs], dtype="<i8").tobytes())
        self.file.write(struct.pack("<QQQ", index, len(self.blocks), len(self.docs)) + MAGIC)
        self.file.close()
        return (part_number(), self.file.uri, len(self.docs), self.tokens)


def write(df: DataFrame, id_col: str, text: str, folder: str, model_path: str, end_id: int,
          p: Params = Params()) -> None:
    """Files of all texts under ``folder``, with ``manifest`` and ``codebook``."""
    spark = df.sparkSession
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    tokens = tokenised(docs, model_path, end_id)
    lengths = code_lengths(count_ids(tokens), p.max_bits)
    used = np.flatnonzero(lengths)
    spark.createDataFrame([(int(i), int(lengths[i])) for i in used], "id int, bits int").coalesce(1) \
        .write.parquet(f"{folder}/codebook")
    handed = spark.sparkContext.broadcast(lengths)  # a byte per vocabulary entry
    schema = pa.schema([("part", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for b in batches:
            writer = writer or _Writer(f"{folder}/files", Code(handed.value), p)
            for doc_id, wide, data in zip(b.column("doc_id").to_pylist(), b.column("wide").to_pylist(),
                                          b.column("ids")):
                writer.add(doc_id, _ids(data.as_py(), wide))
        if writer:
            yield record_batch([writer.close()], schema)

    ordered = (tokens.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
               .select("doc_id", "wide", "ids"))
    ordered.mapInArrow(run, "part int, uri string, n_docs long, n_tokens long").write.parquet(f"{folder}/manifest")


# ------------------------------------------------------------------- reading

class PartReader:
    """One file: its index, and the ids of any run of documents."""

    def __init__(self, uri: str, code: Code):
        fs, path = local_path(uri)
        self.file, self.code = fs.open_input_file(path), code
        size = self.file.size()
        tail = self.file.read_at(24 + len(MAGIC), size - 24 - len(MAGIC))
        head = self.file.read_at(len(MAGIC) + 8, 0)
        if not (tail.endswith(MAGIC) and head.startswith(MAGIC)):
            raise ValueError(f"{uri} is no token-id file")
        self.block_tokens, self.every = struct.unpack_from("<II", head, len(MAGIC))
        self.index, blocks, docs = struct.unpack_from("<QQQ", tail)
        data = self.file.read_at(8 * blocks + 17 * docs, self.index)
        self.offsets = np.append(np.frombuffer(data, "<u8", blocks), np.uint64(self.index)).astype(np.int64)
        ids = np.frombuffer(data, "<i8", docs, 8 * blocks).tolist()
        null = np.frombuffer(data, "u1", docs, 8 * blocks + 8 * docs).tolist()
        self.doc_ids = [None if x else d for d, x in zip(ids, null)]
        self.n_tokens = np.frombuffer(data, "<i8", docs, 8 * blocks + 9 * docs)
        self.starts = np.cumsum(self.n_tokens) - self.n_tokens

    def runs(self, first: int, last: int, blocks: int = 16) -> Iterator[np.ndarray]:
        """Ids from token ``first`` up to ``last``, some blocks at a time."""
        for k in range(first // self.block_tokens, -(-last // self.block_tokens), blocks):
            upto = min(k + blocks, -(-last // self.block_tokens))
            edges = self.offsets[k:upto + 1]
            data = self.file.read_at(int(edges[-1] - edges[0]), int(edges[0]))
            edges = edges - edges[0]
            ids = decode_blocks(self.code, [data[a:b] for a, b in zip(edges, edges[1:])], self.every)
            base = k * self.block_tokens
            yield ids[max(0, first - base):last - base]

    def documents(self, begin: int, end: int) -> Iterator[tuple[int, Iterator[np.ndarray]]]:
        """(number in the file, its ids in pieces) of documents begin..end-1, in order.
        The pieces of a document must be taken before the next document."""
        if begin >= end:
            return
        source = self.runs(int(self.starts[begin]), int(self.starts[end - 1] + self.n_tokens[end - 1]))
        held = np.empty(0, dtype=np.uint32)
        for d in range(begin, end):
            need = int(self.n_tokens[d])

            def pieces() -> Iterator[np.ndarray]:
                nonlocal held, need
                while need:
                    if not len(held):
                        held = next(source)
                    piece, held = held[:need], held[need:]
                    need -= len(piece)
                    yield piece

            yield d, pieces()


def _read(spark: SparkSession, folder: str, p: Params, fold, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """A row (doc_id, start, n_tokens, fold(pieces)) per document."""
    book = spark.read.parquet(f"{folder}/codebook").collect()  # at most one row per vocabulary entry
    lengths = np.zeros(max([r["id"] for r in book], default=0) + 1, dtype=np.uint8)
    for r in book:
        lengths[r["id"]] = r["bits"]
    handed = spark.sparkContext.broadcast(lengths)
    files = spark.read.schema("part int, uri string, n_docs long, n_tokens long").parquet(f"{folder}/manifest")
    parts = sorted((r["part"], r["n_tokens"], r["n_docs"]) for r in files.collect())  # one row per file
    offsets, units, total = {}, 0, 0
    for part, n, n_docs in parts:
        offsets[part] = total
        total += n
        units += -(-n_docs // p.unit_docs)
    based = F.element_at(F.array(*[F.lit(offsets.get(i, 0)).cast("long") for i in range(max(offsets, default=0) + 1)]),
                         F.col("part") + 1)
    todo = files.select("uri", "n_docs", based.alias("base"), F.explode(
        F.expr(f"sequence(0L, n_docs - 1, {p.unit_docs}L)")).alias("begin"))
    names = [c.split()[0] for c in schema.split(", ")]
    arrow = pa.schema(list(zip(names, kinds)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = None
        for b in batches:
            for uri, n_docs, base, begin in zip(*(b.column(c).to_pylist() for c in ("uri", "n_docs", "base", "begin"))):
                code = code or Code(handed.value)
                part = PartReader(uri, code)
                rows, size = [], 0
                for d, pieces in part.documents(begin, min(begin + p.unit_docs, n_docs)):
                    rows.append((part.doc_ids[d], base + int(part.starts[d]), int(part.n_tokens[d]), fold(pieces)))
                    size += rows[-1][2]
                    if size > 1 << 20:
                        yield record_batch(rows, arrow)
                        rows, size = [], 0
                if rows:
                    yield record_batch(rows, arrow)

    return todo.repartition(max(1, min(units, 20_000)), "uri", "begin").mapInArrow(run, schema)


def read(spark: SparkSession, folder: str, p: Params = Params()) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document; ``start`` counts the ids of all before it."""
    return _read(spark, folder, p, lambda pieces: np.concatenate([*pieces, np.empty(0, np.uint32)]),
                 "doc_id long, start long, n_tokens long, ids array<int>",
                 [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())])


def _crc32(pieces: Iterator[np.ndarray]) -> int:
    crc = 0
    for x in pieces:
        crc = zlib.crc32(x.astype("<u4").tobytes(), crc)
    return crc


def read_crc32(spark: SparkSession, folder: str, p: Params = Params()) -> DataFrame:
    """As ``read``, with the CRC-32 of the ids as little-endian 32-bit integers in place of the ids."""
    return _read(spark, folder, p, _crc32, "doc_id long, start long, n_tokens long, ids_crc32 long",
                 [pa.int64()] * 4)
