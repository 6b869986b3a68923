import random
from collections import Counter

import numpy as np

from sendwatch.llm import decontam as D
from tests.llm import brute


def _run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, node string")
    b = spark.createDataFrame(items, "item_id long, text string")
    return {(r.doc_id, r.item_id): (r.similarity, r.start)
            for r in D.matches(d, "doc_id", "text", b, "item_id", "text").collect()}


def test_against_brute_force(spark):
    r = random.Random(3)
    vocabulary = [f"w{i}" for i in range(300)]
    make = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(make(n))) for i, n in enumerate([1, 3, 5, 6, 14, 20, 33, 59])]
    items += [(20, None), (21, " \n"), (22, items[5][1]), (23, "go go go go go go go go go go")]
    docs = []
    for k in range(60):
        ws = make(r.randint(0, 150))
        if k % 2:
            leak = items[r.randrange(2, 8)][1].split()
            if k % 3 == 0 and len(leak) > 12:
                leak[0], leak[-1] = "changed", "Too"  # similarity under 1
            at = r.randint(0, len(ws))
            ws[at:at] = [w.upper() for w in leak]
        docs.append((k, "\n".join(ws) if k % 5 == 0 else " ".join(ws)))
    docs += [(900, None), (901, ""), (902, "Go " * 12), (903, items[7][1]), (904, "x " * 3000 + items[6][1])]
    got, want = _run(spark, docs, items), brute.leaks(docs, items)
    assert set(got) == set(want)
    for k in want:
        assert abs(got[k][0] - want[k][0]) < 1e-12 and got[k][1] == want[k][1]


def _short_leaks(docs, items, percent=80):
    """{(doc_id, item_id): similarity} of documents shorter than the item, as one window."""
    out = {}
    for d, t in docs:
        for i, it in items:
            ws, iw = brute.words(t), brute.words(it)
            k = min(5, len(iw))
            if k <= len(ws) < len(iw):
                got, want = Counter(brute.shingles(ws, k)), Counter(brute.shingles(iw, k))
                common, union = sum((got & want).values()), sum((got | want).values())
                if 100 * common >= percent * union:
                    out[d, i] = common / union
    return out


def test_documents_shorter_than_an_item(spark):
    r = random.Random(5)
    items = [(i, " ".join(f"w{r.randrange(400)}" for _ in range(n))) for i, n in enumerate([3, 5, 8, 9, 10, 14, 20, 40, 59])]
    items += [(30, "go " * 12), (31, None)]
    docs = []
    for i, t in items[:-1]:
        ws = t.split()
        for cut in range(1, 14):
            docs += [(len(docs), " ".join(ws[:-cut])), (len(docs) + 1, " ".join(ws[cut:]).upper())]
        docs.append((len(docs), " ".join(["changed", *ws[1:-1]])))
    docs += [(9000, None), (9001, "")]
    want = _short_leaks(docs, items) | {k: s for k, (s, _) in brute.leaks(docs, items).items()}
    got = _run(spark, docs, items)
    assert set(got) == set(want) and all(abs(got[k][0] - want[k]) < 1e-12 for k in want)
    short = _short_leaks(docs, items)
    assert len(short) > 40 and all(got[k][1] == 0 for k in short)
    item = items[7][1]
    d = spark.createDataFrame([(1, " ".join(item.split()[:-3])), (2, " ".join(item.split()[:20]))], "doc_id long, text string")
    b = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert [x.doc_id for x in D.clean(d, "doc_id", "text", b, "item_id", "text").collect()] == [2]


def test_sql_reports_documents_shorter_than_an_item(spark):
    import duckdb
    import pandas as pd

    from sendwatch.llm.queries import OP8_SQL

    item = " ".join(f"w{i}" for i in range(40))
    docs = [(1, " ".join(item.split()[:37])), (2, "x y " + item + " z"), (3, " ".join(item.split()[:30])), (4, "a b c"), (5, None)]
    items = [(7, item), (8, "a b c"), (9, "b c")]
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text"]))
    rel = con.sql(OP8_SQL)
    got = {(r[0], r[1]): (r[2], r[3]) for r in rel.project("doc_id, item_id, similarity, start").fetchall()}
    assert got == brute.leaks(docs, items) and (1, 7) in got and got[1, 7][1] == 0


def test_clean_and_edges(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, "so " + item, 0), (2, "nothing here", 0), (None, item, 0), (3, None, 0), (3, None, 0)],
                                 "doc_id long, text string, similarity int")
    b = spark.createDataFrame([(None, item), (5, item)], "item_id long, text string")
    left = D.clean(docs, "doc_id", "text", b, "item_id", "text")
    assert left.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect()) == [(2, "nothing here"), (3, ""), (3, "")]
    assert D.clean(docs, "doc_id", "text", b.limit(0), "item_id", "text").count() == 5
    assert D.clean(docs.limit(0), "doc_id", "text", b, "item_id", "text").count() == 0


def test_blocks_guarantee_the_radius():
    p = D.Params()
    rng = np.random.default_rng(1)
    for _ in range(300):
        x = int(rng.integers(0, 1 << 63))
        y = x
        for bit in rng.choice(64, size=p.radius, replace=False).tolist():
            y ^= 1 << bit
        assert any(((y >> at) & ((1 << bits) - 1)) in D.flips_of((x >> at) & ((1 << bits) - 1), bits, p.flips)
                   for at, bits in p.cuts())


def test_weighted_similarity_as_sets():
    a = np.array([1, 1, 2, 3], dtype=np.uint64)
    b = np.array([1, 2, 2, 3, 1, 1], dtype=np.uint64)
    x, y = set(D.tagged(a).tolist()), set(D.tagged(b).tolist())
    assert len(x & y) == 4 and len(x | y) == 6
