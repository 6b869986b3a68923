import random
import re
import zlib
from collections import Counter

import pytest

from sendwatch.llm import spelling as S

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counts(rows):
    out = Counter()
    for d, t in rows:
        for run in RUN.findall(t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        got = sorted((-m, o) for o, m in words.items() if near(w, o))
        form = got[0][1] if got and -got[0][0] >= 2 * n else None
        out[w] = (form, n, len(got), words[form] if form else None)
    root = {}
    for w in words:
        r = w
        while out[r][0]:
            r = out[r][0]
        root[w] = r
    return {w: (f, root[w], n, k, m) for w, (f, n, k, m) in out.items()}


def found(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize("alphabet, size", [("ab", 8), ("aé", 6), ("abcdefghé×", 6)])
def test_dense_vocabularies(spark, alphabet, size):
    """Few letters: equal bigrams at many places, ties in the order everywhere."""
    rng = random.Random(size)
    words = {"".join(rng.choices(alphabet, k=rng.randrange(4, size + 1))): rng.randrange(1, 60) for _ in range(400)}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    assert found(S.variants(df)) == brute(words)


def test_chains_and_long_words(spark):
    words = {"kitten": 3, "kittens": 6, "kitens": 13, "kitenss": 27, "kitenzs": 60, "kytenzs": 130,
             "a" * 70_000: 9, "a" * 69_999 + "b": 40, "alone": 5}
    got = found(S.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert got == brute(words)
    assert got["kitten"][1] == "kytenzs"


def test_texts(spark):
    rng = random.Random(9)
    base = ["letter", "Lettre", "WINDOW", "windows", "naïveté", "naivete", "señor", "senora", "fünfzig", "ab", "a"]
    rows = [(i, " ".join(rng.choices(base, k=40)) + ",x1" + rng.choice(base)) for i in range(150)]
    rows += [(None, "letter " * 30), (None, None), (7, ""), (151, "İstanbul ×÷×÷× " * 4),
             (152, "Letter " * 50_000)]
    rows += rows[:9]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS word", "2 AS n").repartition(4)
    assert found(S.group_variants(df, "doc_id", "text")) == brute(counts(rows))


def test_pivots_are_the_cheapest_disjoint_pair():
    rng = random.Random(2)
    for _ in range(500):
        places = sorted(rng.sample(range(9), rng.randrange(3, 7)))
        cost = [rng.randrange(1, 9) for _ in places]
        got = S.pivots_of(places, cost)
        price = dict(zip(places, cost))
        best = min(price[a] + price[b] for a in places for b in places if b - a >= 2)
        assert len(got) == 2 and abs(got[0] - got[1]) >= 2 and sum(price[p] for p in got) == best


def test_matches_brute_force_on_the_small_table(spark):
    """The registered query over the whole smallest table, pairs found by dropping each code point."""
    from collections import defaultdict

    from sendwatch.llm import queries as Q
    from tests.conftest import SF_SMALL

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()]
    words = counts(rows)
    meet = defaultdict(set)
    for w in words:
        meet[w].add(w)
        for i in range(len(w)):
            meet[w[:i] + w[i + 1:]].add(w)
    links = defaultdict(set)
    for some in meet.values():
        for a in some:
            links[a] |= {b for b in some if near(a, b)}
    form = {}
    for w, n in words.items():
        got = sorted((-words[o], o) for o in links[w])
        form[w] = got[0][1] if got and -got[0][0] >= 2 * n else None
    want = {}
    for w in words:
        r = w
        while form[r]:
            r = form[r]
        want[w] = (form[w], r, words[w], len(links[w]), words.get(form[w]))
    assert found(Q.queries()["op13_pivotal_grams"](spark, SF_SMALL)) == want


def test_empty_and_bounds(spark):
    assert found(S.group_variants(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text")) == {}
    with pytest.raises(ValueError):
        S.group_variants(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", shortest=3)


def test_no_side_that_grows_with_the_words_is_broadcast(spark, monkeypatch):
    """Small by its file, a side of the joins may be dozens of times that in memory: also far below Spark's bound."""
    words = spark.createDataFrame([("letter", 9), ("lettre", 3), ("leter", 4), ("window", 8), ("windov", 2)], "word string, n long")
    plans = []
    held = S.materialize
    monkeypatch.setattr(S, "materialize", lambda df: (plans.append(df), held(df))[1])
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").rstrip("b")) >= 1 << 20
    plans.append(S.variants(held(words)))
    texts = [df._jdf.queryExecution().executedPlan().toString() for df in plans]
    assert sum(t.count("SortMergeJoin") for t in texts) >= 4
    assert not any("BroadcastHashJoin" in t for t in texts)
