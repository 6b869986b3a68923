"""Typed readers for the driver's Parquet tables.

Schemas are declared. A declared Parquet schema gives NULLs for a column that
a file does not have, so the table's columns are checked by name when it is
opened (one footer), and tables that are not declared are refused. Only the columns a job touches are ever decoded (Catalyst
prunes the ``ReadSchema``), and comparisons on raw columns reach the scan as
``PushedFilters``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

SCHEMAS: dict[str, str] = {
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "benchmark": "item_id BIGINT, text STRING",
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in SCHEMAS:
        raise ValueError(f"undeclared table {name!r}")
    path = os.path.join(sf_dir, f"{name}.parquet")
    found = spark.read.parquet(path).columns
    missing = [f.name for f in StructType.fromDDL(SCHEMAS[name]) if f.name not in found]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    return spark.read.schema(SCHEMAS[name]).parquet(path)
