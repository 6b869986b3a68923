import numpy as np
import pytest

from sendwatch.llm import sharding as S


@pytest.mark.parametrize("n", [1, 2, 3, 16, 17, 1000, 4097])
def test_permutation_and_inverse(n):
    p = S.permute(np.arange(n), n, seed=3)
    assert sorted(p.tolist()) == list(range(n))
    for row in range(0, n, max(1, n // 7)):
        shard, slot = S.locate(row, n, 8, 3)
        assert S.row_at(shard, slot, n, 8, 3) == row


def test_seed_changes_order():
    assert S.permute(np.arange(1000), 1000, 1).tolist() != S.permute(np.arange(1000), 1000, 2).tolist()


def test_assign(spark):
    rows = [(5, "a", "x"), (None, None, "y"), (5, "a", "x"), (1, "", None), (9, "z" * 5000, "q")] * 21
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    out = S.assign(df, ["doc_id", "text"], shards=8, seed=0).toPandas()
    assert len(out) == len(rows)
    for k, part in out.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    sizes = out.groupby("shard").size()
    assert sizes.max() - sizes.min() <= 1 and len(sizes) == 8
    out = out.sort_values("row_number")
    assert out.row_number.tolist() == list(range(len(rows)))
    assert out.doc_id.isna().tolist() == [True] * 21 + [False] * 84  # nulls number first
    for r in out.itertuples():
        assert (r.shard, r.slot) == S.locate(r.row_number, len(rows), 8, 0)


def test_order_of_input_is_irrelevant_and_empty(spark):
    df = spark.range(500).selectExpr("id AS doc_id")
    a = S.assign(df, ["doc_id"], 8).orderBy("doc_id").collect()
    b = S.assign(df.repartition(7).orderBy("doc_id", ascending=False), ["doc_id"], 8).orderBy("doc_id").collect()
    assert a == b
    assert S.assign(df.limit(0), ["doc_id"], 8).count() == 0


def test_write_shards(spark, tmp_path):
    path = str(tmp_path / "shards")
    S.write_shards(S.assign(spark.range(100).toDF("doc_id"), ["doc_id"], 3), path)
    back = spark.read.parquet(path)
    assert back.count() == 100 and back.select("shard").distinct().count() == 3
