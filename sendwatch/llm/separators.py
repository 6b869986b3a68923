"""Token counts of documents in flat token files, by their separators.

A flat file holds ids as little-endian integers, one document after the other,
each followed by the end-of-document id; there is no index. A scan reads
blocks of the files in parallel, finds the separators of a block with one
vectorised comparison and emits their positions. A document may begin in one
block and end in any later one: a prefix scan over the blocks of a file (last
separator so far, separators so far) gives every block the position where its
first document began and that document's number.

Edge cases: null and empty texts are documents of 0 tokens; ids after the last
separator of a file are a last, unfinished document; an empty file has none; a
trailing partial id is an error; an empty table writes no documents; rows
without an id or with a repeated one are ordinary documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sendwatch.llm.common import local_path, materialize, text_slices
from sendwatch.llm.tokens import PartFile, part_number, record_batch, tokenizer

BLOCK_TOKENS = 1 << 20


def write(df: DataFrame, id_col: str, text: str, folder: str, model_path: str, end_id: int) -> DataFrame:
    """Write one flat file per task; per document (uri, place, doc_id), ``place``
    being its number in the file. Strings of special tokens are encoded as
    ordinary text, so the separator occurs nowhere else."""
    schema = pa.schema([("uri", pa.string()), ("place", pa.int64()), ("doc_id", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, place = None, 0
        tok = tokenizer(model_path, special_as_text=True)
        end = np.array([end_id], dtype=tok.dtype).tobytes()
        for whole in batches:
            for b in text_slices(whole, "text"):
                out = out or PartFile(folder, part_number(), ".bin")
                out.write(b"".join([x + end for x in tok.encode(b.column("text").to_pylist())]))
                yield record_batch([(out.uri, place + i, d) for i, d in enumerate(b.column("doc_id").to_pylist())],
                                   schema)
                place += b.num_rows
        if out:
            out.close()

    return materialize(df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                                 F.col(f"`{text}`").alias("text"))
                       .mapInArrow(run, "uri string, place long, doc_id long"))


def separators_in(data: bytes, dtype: np.dtype, end_id: int) -> np.ndarray:
    return np.flatnonzero(np.frombuffer(data, dtype=dtype) == end_id)


def scan(files: DataFrame, dtype: str, end_id: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(uri, place, start, n_tokens, finished) of every document in ``files``
    (uri): its number in the file, its first token and its tokens without the
    separator."""
    width = np.dtype(dtype).itemsize

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uri", pa.string()), ("tokens", pa.int64())])
        for b in batches:
            rows = []
            for uri in b.column("uri").to_pylist():
                fs, path = local_path(uri)
                size = fs.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{uri}: {size} bytes are no whole number of ids")
                rows.append((uri, size // width))
            yield record_batch(rows, schema)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("uri", pa.string()), ("block", pa.int64()), ("tokens", pa.int64()),
                            ("at", pa.list_(pa.int64()))])
        for b in batches:
            for uri, block, tokens in zip(*(b.column(c).to_pylist() for c in ("uri", "block", "tokens"))):
                fs, path = local_path(uri)
                first = block * block_tokens
                with fs.open_input_file(path) as f:
                    data = f.read_at(min(block_tokens, tokens - first) * width, first * width)
                at = separators_in(data, np.dtype(dtype), end_id) + first
                yield record_batch([(uri, block, tokens, at)], schema)

    sized = files.select("uri").mapInArrow(lengths, "uri string, tokens long").filter("tokens > 0")
    cut = materialize(sized.select("uri", "tokens", F.explode(
        F.expr(f"sequence(0L, (tokens - 1) div {block_tokens})")).alias("block")))
    n = cut.count()
    found = materialize(cut.repartition(max(1, min(n, 20_000)), "uri", "block")
                        .mapInArrow(find, "uri string, block long, tokens long, at array<long>"))
    # the prefix scan: one narrow row per block
    before = Window.partitionBy("uri").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    marks = found.select("uri", "block", F.size("at").alias("n"),
                         F.when(F.size("at") > 0, F.element_at("at", -1)).alias("last"))
    scanned = marks.select("uri", "block",
                           F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first_place"),
                           F.coalesce(F.max("last").over(before), F.lit(-1)).alias("previous"))
    stitched = found.join(scanned, ["uri", "block"])
    ends = stitched.select("uri", "first_place", "previous", "at", F.posexplode("at").alias("k", "end"))
    start = F.when(F.col("k") == 0, F.col("previous")).otherwise(F.expr("at[greatest(k - 1, 0)]")) + 1
    finished = ends.select("uri", (F.col("first_place") + F.col("k")).alias("place"), start.alias("start"),
                           (F.col("end") - start).alias("n_tokens"), F.lit(True).alias("finished"))
    tail = (found.groupBy("uri").agg(F.max("tokens").alias("tokens"), F.sum(F.size("at")).cast("long").alias("place"),
                                     F.coalesce(F.max(F.array_max("at")), F.lit(-1)).alias("last"))
            .filter("last < tokens - 1")
            .select("uri", "place", (F.col("last") + 1).alias("start"),
                    (F.col("tokens") - 1 - F.col("last")).alias("n_tokens"), F.lit(False).alias("finished")))
    return finished.unionByName(tail)
