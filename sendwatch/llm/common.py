"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sendwatch.session import ensure_checkpoint_dir, materialize

__all__ = ["ensure_checkpoint_dir", "fresh", "global_row_numbers", "local_path", "materialize",
           "null_safe_id", "scratch_dir", "share_package", "table",
           "text_slices"]

# characters of text that a Python task holds as objects at a time (or one text, if longer)
BATCH_CHARS = 1_000_000

# ids at or above this stand for rows whose id is null (see ``null_safe_id``)
NULL_ID_BASE = 1 << 62


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it (a
    local session, or nodes with the same installation; elsewhere the path is
    idle and the package comes by --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    environment = spark.sparkContext.environment
    known = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in known:
        environment["PYTHONPATH"] = os.pathsep.join([root, *known])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    share_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, base: str) -> str:
    """A column name derived from ``base`` that ``df`` does not use (names
    compare without case, as Spark resolves them)."""
    used = {c.lower() for c in df.columns}
    name = f"__{base}"
    while name.lower() in used:
        name += "_"
    return name


def scratch_dir(spark: SparkSession, kind: str) -> str:
    """A new folder name under the session's shared checkpoint folder."""
    import uuid

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{kind}/{uuid.uuid4().hex}"


def local_path(uri: str) -> tuple[object, str]:
    """(pyarrow filesystem, path) for a file that Spark listed."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def null_safe_id(id_col: Column, content: Column) -> Column:
    """``id_col``, or for a null id a stand-in that depends on the content
    only, larger than any real id (real ids stay below 2**62)."""
    return F.coalesce(id_col.cast("long"),
                      F.lit(NULL_ID_BASE) + F.xxhash64(content).bitwiseAND(F.lit(NULL_ID_BASE - 1)))


def global_row_numbers(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """``df`` sorted by ``order`` with gapless numbers from 0 in column ``name``.

    The sort is a range exchange (ties are split by the position in the input,
    so a value that holds a third of all rows still spreads over tasks). The
    sorted rows are written once; a row's number is its position inside its
    partition plus the partition's offset. Only one count per partition
    reaches the driver. Pass narrow frames: all columns are shuffled.
    """
    tie, pos = fresh(df, "tie"), fresh(df, "pos")
    spread = df.withColumn(tie, F.monotonically_increasing_id())
    ordered = spread.repartitionByRange(*order, tie).sortWithinPartitions(*order, tie)
    held = materialize(ordered.drop(tie).withColumn(pos, F.monotonically_increasing_id()))
    part, index = F.shiftright(pos, 33), F.col(pos).bitwiseAND(F.lit((1 << 33) - 1))
    counts = held.groupBy(part.alias("p")).agg((F.max(index) + 1).alias("n")).collect()
    offsets: dict[int, int] = {}
    total = 0
    for r in sorted(counts, key=lambda r: r["p"]):
        offsets[r["p"]] = total
        total += r["n"]
    if not offsets:
        return held.withColumn(name, F.lit(0).cast("long")).drop(pos)
    table_ = F.array(*[F.lit(offsets.get(i, 0)).cast("long") for i in range(max(offsets) + 1)])
    return held.withColumn(name, F.element_at(table_, (part + 1).cast("int")) + index).drop(pos)


def text_slices(batch: pa.RecordBatch, text: str, limit: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows of about ``limit`` characters (one row at least)."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    start = total = 0
    for i, n in enumerate(lengths.tolist()):
        if total and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)
