import random

import numpy as np

from sendwatch.llm import neardup as N
from sendwatch.llm import words as H
from sendwatch.llm.components import connected_components
from tests.llm import brute


def _check(spark, docs, p=N.Params()):
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in docs], "doc_id long, text string, node string, n int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.groups(df, "doc_id", "text", p).collect()}
    want = brute.groups(docs, p.percent)
    assert got == {d: (n, c, c == d) for d, (n, c) in want.items()}


def test_against_brute_force(spark):
    r = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    docs = []
    for _ in range(12):
        base = [r.choice(vocabulary) for _ in range(r.randint(40, 120))]
        docs.append(" ".join(base))
        for _ in range(6):  # near copies, some of copies: chains
            near = list(base)
            for _ in range(r.randint(0, 2)):
                near[r.randrange(len(near))] = r.choice(vocabulary)
            docs.append(" ".join(near) if r.random() < .7 else "\n".join(near).upper())
            if r.random() < .3:
                base = near
    docs += [None, "", "  \n", "short one", "Short ONE", "short two", "a b c d e", "a b c d e", "a b c d"]
    r.shuffle(docs)
    _check(spark, list(enumerate(docs)))


def test_documents_table(spark):
    from tests.conftest import SF_SMALL

    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    _check(spark, docs)


def test_large_groups(spark):
    r = random.Random(1)
    base = [f"v{r.randrange(10 ** 6)}" for _ in range(120)]
    docs = [" ".join(base)] * 400
    for i in range(400):
        near = list(base)
        near[r.randrange(120)] = f"changed{i}"
        docs.append(" ".join(near))
    docs += [" ".join(f"q{i}-{j}" for j in range(30)) for i in range(50)]
    _check(spark, list(enumerate(docs)))


def test_cloud_around_the_threshold(spark):
    """Near copies of a text that is not there: similarities lie on both sides of the threshold,
    so pivots join few and chunks of the large buckets are compared."""
    r = random.Random(2)
    base = [f"v{r.randrange(10 ** 6)}" for _ in range(150)]
    docs = []
    for i in range(90):
        near = list(base)
        for k in r.sample(range(150), r.choice([1, 2, 3])):
            near[k] = f"changed{i}-{k}"
        docs.append(" ".join(near))
    _check(spark, list(enumerate(docs)), N.Params(percent=94, small_bucket=2, chunk_nodes=20))


def test_null_and_repeated_ids(spark):
    t = "one two three four five six seven"
    rows = [(None, t), (None, "lonely text of some seven other words"), (4, t), (9, t), (9, t), (12, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.groups(df, "doc_id", "text").collect()),
                 key=repr)
    assert got == sorted([(None, 3, 4, False), (None, 3, None, True), (4, 3, 4, True), (9, 3, 4, False),
                          (9, 3, 4, False), (12, 0, 12, True), (None, 0, None, True)], key=repr)
    left = N.deduplicate(df, "doc_id", "text")
    assert left.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted(
        [(4, t), (None, "lonely text of some seven other words"), (12, None), (None, "")], key=repr)
    same = spark.createDataFrame([(1, t), (1, t), (1, t)], "doc_id long, text string")
    assert N.deduplicate(same, "doc_id", "text").count() == 1
    assert N.groups(df.limit(0), "doc_id", "text").count() == 0
    assert N.deduplicate(df.limit(0), "doc_id", "text").count() == 0


def test_signature_estimates_similarity():
    p = N.Params()
    rng = np.random.default_rng(0)
    pool = H.mix(rng.integers(0, 1 << 63, 3000).astype(np.uint64))
    a, b = pool[:2000], pool[500:2500]
    sa, sb = N.signatures([a, b], p)
    assert abs((sa == sb).mean() - 1500 / 2500) < 0.12


def test_intersections():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64)) for _ in range(12)]
    x, y = np.triu_indices(12, 1)
    want = [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert N._intersections(sets, x, y).tolist() == want


def test_pruning_keeps_links():
    p = N.Params()
    for n, m in N.fewest_matches(p):
        assert m < p.percent / 100 * n  # the expected matches at the threshold are never pruned
    n, m = N.fewest_matches(p)[-1]
    assert m > 0.6 * n


def test_components(spark):
    path = [(i, i + 1) for i in range(100, 160)] + [(5, 300), (300, 7), (8, 8)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 300: 5, 7: 5, 8: 8}
    none = connected_components(spark.createDataFrame([], "a long, b long"))
    assert none.count() == 0
