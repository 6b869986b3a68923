import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sendwatch.llm import quality as Q
from tests.llm import brute

TEXTS = [None, "", "   \t\n ", "one", "a b c d e f g h i j", "a b c d e " * 3, "a a a a a a a",
         "x y z w v x y z w v\nx y z w v", "l1 a\nl1 a\n\n l1 a\nb", "tab\tsep\x0bvt\x0cff\rcr", "#$% && || <>",
         "é ñ ü ß 日本 語", " lead and trail ", "\u00a0nbsp is a word\u00a0char", "AAA BBB CCC " * 6,
         "w%d " % 1 * 7 + " ".join(f"u{i}" for i in range(50)), "long " + "x" * 50000, " ".join(map(str, range(20000)))]


def test_counts_match_brute_force(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = Q.with_counts(df, "text", "c").select("id", "c.*").collect()
    assert len(got) == len(TEXTS)
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == \
            brute.quality_counts(TEXTS[r.id]), TEXTS[r.id]


def _em(patterns, rounds=40, tolerance=1e-6, start=0.95):
    """numpy EM over (votes, n)."""
    v = np.array([p[:-1] for p in patterns])
    n = np.array([p[-1] for p in patterns], dtype=float)
    q = np.where((v == -1).any(axis=1), 1 - start, start)
    sg, sb = np.array(Q.GOOD_PRIOR), np.array(Q.BAD_PRIOR)
    last = None
    for _ in range(rounds):
        good, bad = (n * q).sum(), (n * (1 - q)).sum()
        prior = (good + 1) / (good + bad + 2)
        hit = np.stack([v == x for x in (-1, 0, 1)], axis=2)
        g = ((n * q)[:, None, None] * hit).sum(axis=0)
        b = ((n * (1 - q))[:, None, None] * hit).sum(axis=0)
        wg, wb = 10 * good + 1, 10 * bad + 1
        g, b = (g + wg * sg) / (good + wg), (b + wb * sb) / (bad + wb)
        flat = np.concatenate([[prior], g.ravel(), b.ravel()])
        if last is not None and abs(flat - last).max() < tolerance:
            break
        last = flat
        odds = math.log(prior) - math.log1p(-prior) + (hit * (np.log(g) - np.log(b))).sum(axis=(1, 2))
        q = 1 / (1 + np.exp(-odds))
    return prior, g, b


def test_em_matches_numpy(spark):
    rng = np.random.default_rng(0)
    rows = [(*(int(x) for x in rng.choice([-1, 0, 1], size=9, p=[.1, .2, .7])), int(rng.integers(1, 50)))
            for _ in range(60)]
    df = spark.createDataFrame(rows, ", ".join(f"{k} int" for k in Q.RULE_NAMES) + ", n long")
    model = Q.fit(df)
    prior, g, b = _em(rows)
    assert model.prior == pytest.approx(prior, rel=1e-9)
    assert np.allclose(model.good, g) and np.allclose(model.bad, b)
    assert all(0 <= a <= 1 for a in Q.accuracies(model).values())


def test_rule_accuracies_are_estimated(spark):
    """Rules that see 90, 70 and 60 % of the bad documents, and one that votes bad on 30 % of either kind."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(6000):
        bad = i % 10 < 3
        symbols, letters, capitals = (bool(x) for x in (rng.random(3) < (.9, .7, .6)) & bad)
        rows.append((i, 100, 500, 50 if symbols else 0, 0, 0, 10, 60, 300 if letters else 480,
                     290 if capitals else 5, 0, 60 if rng.random() < .3 else 0))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_unique",
             "n_letters", "n_upper", "n_digits", "n_marks")
    assert sorted(names) == sorted(Q.COUNTS)
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{k} long" for k in names))
    counted = df.select("id", F.struct(*Q.COUNTS).alias("counts"))
    out, model = Q._judged(counted, "counts", 0.5, "quality")
    seen = {k: (g[0], b[0]) for k, g, b in zip(Q.RULE_NAMES, model.good, model.bad)}
    for name, share in (("symbols", .9), ("letters", .7), ("capitals", .6)):
        assert seen[name][1] == pytest.approx(share, abs=0.05) and seen[name][0] < 0.01
    assert abs(math.log(seen["marks"][1] / seen["marks"][0])) < 0.2
    assert out.filter("quality.kept != (id % 10 >= 3)").count() < 0.02 * len(rows)


def test_judge_edges(spark):
    clean = "the quick brown fox jumps over some lazy dogs while many birds sing in tall trees today"
    junk = "wh%%% onn*** of%%% it%%% res$$$ and$$$ or%%% he### se*** ng&&& onn%%% so&&& up*** to###"
    rows = [(i, f"{clean} number {i}", "c") for i in range(30)] + [(100 + i, junk, None) for i in range(8)]
    rows += [(None, None, "n"), (7, "", "e"), (7, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality string")
    out, _ = Q.judge(df, "text", verdict="verdict")
    assert out.columns == ["doc_id", "text", "quality", "verdict"]
    kept = out.filter("verdict.kept").select("doc_id").toPandas().doc_id.tolist()
    assert sorted(kept) == list(range(30))
    assert out.filter("verdict.base_failed").count() == 3
    empty, model = Q.judge(df.limit(0), "text", verdict="verdict")
    assert model is None and empty.count() == 0


def test_labelled_documents(spark):
    from tests.conftest import SF_SMALL

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    out, _ = Q.judge(docs, "text", keep=["doc_id"])
    both = out.join(labels, "doc_id").filter(~F.col("quality.base_failed")) if "quality" not in labels.columns else \
        out.withColumnRenamed("quality", "v").join(labels, "doc_id").filter("NOT v.base_failed")
    right = both.filter("v.kept = (quality = 1)").count()
    assert right / both.count() >= 0.98


def test_no_python_in_plan(spark):
    df = spark.createDataFrame([(1, "a b")], "id int, text string")
    plan = Q.with_counts(df, "text", "c")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
