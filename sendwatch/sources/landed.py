"""Sources over landed tables: Parquet directories or CSV hand-offs.

Has the views of the fixture sources, so every job runs on it unchanged. A
table is a path; ``formats`` says which are CSV (with a header; an array
column is one field with commas between its elements). Schemas are declared
and columns checked by name, so a missing or renamed column is an error when
the source is opened, not a column of NULLs. A messages directory partitioned
by ``data_load_date`` is pruned by the jobs' load-day bounds.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

# --- fixed values: the views and their columns --------------------------------
VIEWS: dict[str, str] = {
    "messages": "sid BIGINT, account_id BIGINT, sent_date TIMESTAMP_NTZ, date_created TIMESTAMP_NTZ, "
                "date_updated TIMESTAMP_NTZ, data_load_date DATE, status STRING, error_code INT, flags INT, "
                "from_cc STRING, to_cc STRING, from_type STRING",
    "bodies": "sid BIGINT, body STRING",
    "complaints": "id BIGINT, account_id BIGINT, processed_ts TIMESTAMP_NTZ",
    "optout_log": "id BIGINT, account_id BIGINT, allowed INT, sender STRING, updated_ts TIMESTAMP_NTZ",
    "audit_events": "event_id BIGINT, account_id BIGINT, event_name STRING, details STRING, "
                    "date_created TIMESTAMP_NTZ",
    "accounts": "sid BIGINT, parent_sid BIGINT, friendly_name STRING, date_created TIMESTAMP_NTZ",
    "account_flags": "account_id BIGINT, is_internal BOOLEAN",
    "customer_link": "account_id BIGINT, customer_id BIGINT",
    "crm_accounts": "customer_id BIGINT",
    "isv_list": "id BIGINT",
    "risky_list": "sid BIGINT",
    "cannabis_list": "sid BIGINT",
    "tickets": "id BIGINT, account_id BIGINT, tags ARRAY<STRING>, created_at TIMESTAMP_NTZ, "
               "updated_at TIMESTAMP_NTZ, group_id BIGINT",
    "ticket_groups": "id BIGINT",
}
# -------------------------------------------------------------------------------


class LandedSources:
    def __init__(self, spark: SparkSession, paths: Mapping[str, str], formats: Mapping[str, str] | None = None):
        self.spark = spark
        self._tables = {name: self._open(name, path, (formats or {}).get(name, "parquet"))
                        for name, path in paths.items()}

    def _open(self, name: str, path: str, fmt: str) -> DataFrame:
        if name not in VIEWS:
            raise ValueError(f"unknown source table {name!r}")
        schema = StructType.fromDDL(VIEWS[name])
        if fmt == "csv":
            found = self.spark.read.option("header", True).csv(path).columns
            arrays = [f.name for f in schema if isinstance(f.dataType, ArrayType)]
            flat = StructType([StructField(f.name, StringType() if f.name in arrays else f.dataType) for f in schema])
            order = StructType([next((f for f in flat if f.name == c), StructField(c, StringType())) for c in found])
            df = self.spark.read.option("header", True).schema(order).csv(path)
            df = df.withColumns({c: F.split(c, ",") for c in arrays if c in found})
        elif fmt == "parquet":
            df = self.spark.read.parquet(path)
            found = df.columns
        else:
            raise ValueError(f"unsupported format {fmt!r}")
        missing = [f.name for f in schema if f.name not in found]
        if missing:
            raise ValueError(f"{name}: no column {', '.join(missing)} in {path}")
        return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    def __getattr__(self, name: str) -> DataFrame:
        if name == "internal_free":
            return self.account_flags.where(~F.col("is_internal")).select("account_id")
        try:
            return self.__dict__["_tables"][name]
        except KeyError:
            raise AttributeError(f"no source table {name!r} was given") from None
