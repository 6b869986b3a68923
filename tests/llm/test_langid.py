import numpy as np
import pandas as pd

from sendwatch.llm import langid as L

P = L.Params()


def test_held_out_accuracy_and_edges(spark):
    from pyspark.sql import functions as F

    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").withColumn("held", L.held_out(F.col("doc_id")))
    prototypes = L.train(docs.filter("NOT held"), "text", "lang")
    assert sorted(prototypes) == ["de", "en", "es", "fr"]
    out = L.predict(docs, "text", prototypes, keep=["doc_id", "lang", "held"]).toPandas()
    assert len(out) == docs.count()
    held = out[out.held]
    assert (held.lang == held.lang_pred).mean() > 0.97
    assert out.score.between(0, 1).all()
    rows = [(None, None), (1, ""), (2, "1234 !?"), (3, "日本語"), (4, "a"), (4, "a")]
    odd = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    got = L.predict(odd, "text", prototypes, keep=["doc_id"]).toPandas()
    assert got.lang_pred[:3].tolist() == [L.UNKNOWN] * 3 and got.score[:3].tolist() == [0.0] * 3
    assert L.keep_known(odd, "text", prototypes, 0.0).count() == 3
    assert L.predict(odd.limit(0), "text", prototypes, keep=["doc_id"]).count() == 0
    assert L.train(docs.limit(0), "text", "lang") == {}
    assert L.predict(odd, "text", {}, keep=["doc_id"]).toPandas().lang_pred.tolist() == [L.UNKNOWN] * 6


def test_bundle_is_the_sum_of_bound_ngrams():
    text = "Ab, cab"
    letters = [0, *map(ord, "ab"), 0, *map(ord, "cab"), 0]
    v = L.Vectors(P)
    want = np.zeros(P.dimensions)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        want += np.roll(v.letter(a), 2) * np.roll(v.letter(b), 1) * v.letter(c)
    assert np.array_equal(L.bundles([text], P)[0], want)


def test_prediction_matches_brute_force():
    train = {"x": "abab baba abba", "y": "cdcd dcdc cddc"}
    protos = {k: L.bundles([t], P)[0] / np.linalg.norm(L.bundles([t], P)[0]) for k, t in train.items()}
    import pyarrow as pa

    names, scores = L.predictor(protos, P)(pa.array(["ab ba ab", "cd", "zz", None]))
    assert names[:2] == ["x", "y"] and names[3] == L.UNKNOWN
    v = L.bundles(["ab ba ab"], P)[0]
    assert abs(scores[0] - v @ protos["x"] / np.linalg.norm(v)) < 1e-5


def test_held_out_rule(spark):
    import zlib

    from pyspark.sql import functions as F

    df = spark.range(50).select("id", L.held_out(F.col("id")).alias("h")).toPandas()
    assert df.h.tolist() == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]
    assert isinstance(df, pd.DataFrame)
