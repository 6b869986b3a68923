"""Reproducible shuffle into shards by a Feistel permutation of row numbers.

Rows are numbered 0..n-1 in ascending key order (``global_row_numbers``). A
balanced Feistel network permutes the smallest domain 4**h that holds n, and
cycle walking (apply again while the value is n or more) narrows it to a
permutation of 0..n-1. With p the permuted number, ``shard = p % shards`` and
``slot = p // shards``: shard sizes differ by at most one row, slots are
gapless from 0, and both directions can be computed from (row number, n,
shards, seed) alone, without looking at the data (``locate``, ``row_at``).

Edge cases: null and repeated ids are ordinary rows (nulls number first; equal
rows are interchangeable); null text counts as empty; an empty table gives no
rows; extra columns are kept out of the permutation and may have any name.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sendwatch.llm.common import fresh, global_row_numbers

ROUNDS = 6
PRIME = (1 << 31) - 1


def half_bits(n: int) -> int:
    """Smallest h with 4**h >= n (at least 1)."""
    h = 1
    while 1 << (2 * h) < n:
        h += 1
    if h > 31:
        raise ValueError("at most 2**62 rows")
    return h


def round_keys(seed: int) -> list[int]:
    return [int(k) for k in np.random.default_rng(seed).integers(1, PRIME, ROUNDS)]


def _mix(right: np.ndarray, key: int, mask: int) -> np.ndarray:
    v = (right + key) % PRIME
    v = (v * v + key) % PRIME
    return (v * (key | 1) % PRIME) & mask


def _network(x: np.ndarray, h: int, keys: list[int]) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = x >> h, x & mask
    for k in keys:
        left, right = right, left ^ _mix(right, k, mask)
    return (left << h) | right


def _network_back(x: np.ndarray, h: int, keys: list[int]) -> np.ndarray:
    mask = (1 << h) - 1
    left, right = x >> h, x & mask
    for k in reversed(keys):
        left, right = right ^ _mix(left, k, mask), left
    return (left << h) | right


def _walk(x: np.ndarray, n: int, keys: list[int], network) -> np.ndarray:
    h = half_bits(n)
    x = network(np.asarray(x, dtype=np.int64), h, keys)
    while (outside := x >= n).any():
        x[outside] = network(x[outside], h, keys)
    return x


def permute(rows: np.ndarray, n: int, seed: int) -> np.ndarray:
    """Permuted numbers of row numbers in 0..n-1."""
    return _walk(rows, n, round_keys(seed), _network)


def locate(row: int, n: int, shards: int, seed: int) -> tuple[int, int]:
    """(shard, slot) of a row number."""
    p = int(permute(np.array([row]), n, seed)[0])
    return p % shards, p // shards


def row_at(shard: int, slot: int, n: int, shards: int, seed: int) -> int:
    """Row number that sits at (shard, slot)."""
    p = np.array([slot * shards + shard])
    return int(_walk(p, n, round_keys(seed), _network_back)[0])


def _permute_column(number: Column, n: int, seed: int) -> Column:
    keys = round_keys(seed)

    @F.pandas_udf("long")
    def permuted(rows: pd.Series) -> pd.Series:
        return pd.Series(_walk(rows.to_numpy(np.int64), n, keys, _network))

    return permuted(number)


def assign(df: DataFrame, order: list[str], shards: int, seed: int = 0) -> DataFrame:
    """``df`` with ``row_number``, ``shard`` and ``slot`` (these names replace
    columns of ``df`` that have them). Pass the columns that are wanted: every
    column travels through the sort. Order by columns that tell rows apart."""
    if shards < 1:
        raise ValueError("shards must be positive")
    df = df.drop("row_number", "shard", "slot")
    numbered = global_row_numbers(df, order, "row_number")
    n = numbered.count()
    p = fresh(numbered, "p")
    return (numbered.withColumn(p, _permute_column(F.col("row_number"), max(n, 1), seed))
            .withColumn("shard", (F.col(p) % shards).cast("int"))
            .withColumn("slot", F.expr(f"`{p}` div {shards}"))
            .drop(p))


def write_shards(assigned: DataFrame, path: str) -> None:
    """One folder per shard, rows in slot order inside each file. Tasks are
    dealt by ranges of (shard, slot), so a shard may span several files."""
    (assigned.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.mode("errorifexists").partitionBy("shard").parquet(path))
