"""Queries with a SQL oracle, against DuckDB on the smallest driver tables."""

import pytest

from sendwatch.llm import queries as Q
from tests.conftest import SF_SMALL


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_matches_oracle(spark, name):
    from tools.oracle_check import duck, rows_of

    df = Q.queries()[name](spark, SF_SMALL)
    rel = duck(SF_SMALL).sql(Q.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()], True) == rows_of(rel.columns, rel.fetchall(), True)


@pytest.mark.parametrize("name", sorted(set(Q.queries()) - set(Q.oracle_sql()) - {"op13_pivotal_grams"}))
def test_one_row_per_input_row(spark, name):
    table = "pages" if name.startswith("op2_") else "documents"
    key = "page_id" if table == "pages" else "doc_id"
    rows = spark.read.parquet(f"{SF_SMALL}/{table}.parquet")
    got = Q.queries()[name](spark, SF_SMALL)
    assert got.count() == rows.count()
    assert got.select(key).distinct().count() == rows.select(key).distinct().count()
