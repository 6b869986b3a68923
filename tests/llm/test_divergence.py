import random
import re
from collections import Counter, defaultdict

from sendwatch.llm import divergence as D

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(rows, top=200, least=3):
    """rows: (text, lang, source). Returns {(lang, source, part, item): (value, rank)}."""
    docs = [(terms(t), la or "", so or "") for t, la, so in rows]
    out = {}
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(t for ts, _, _ in mine for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        by = defaultdict(Counter)
        for ts, _, so in mine:
            by[so].update(t for t in ts if df[t] >= least)
        whole = sum(by.values(), Counter())

        def shares(counts):
            n = sum(counts.values())
            return {t: 1 + 10**9 * (counts[t] + 1) // (n + len(kept)) for t in kept}

        p = {so: shares(c) for so, c in by.items()}
        q = shares(whole)
        f = lambda a, b: (a - b) ** 2 // b
        for so in by:
            pairs = [(o, sum(f(p[so][t], p[o][t]) for t in kept)) for o in by if o != so]
            found = [(t, f(p[so][t], q[t])) for t in kept if by[so][t] and p[so][t] > q[t]]
            for part, got in (("pair", pairs), ("term", found)):
                got.sort(key=lambda x: (-x[1], x[0].encode()))
                for k, (item, value) in enumerate(got, 1):
                    if part == "pair" or k <= top:
                        out[lang, so, part, item] = (value, k)
    return out


def audit(df, **k):
    pairs, terms_ = D.audit(df, **k)
    out = {(r.lang, r.source, "pair", r["item"]): (r.value, r["rank"]) for r in pairs.collect()}
    return out | {(r.lang, r.source, "term", r["item"]): (r.value, r["rank"]) for r in terms_.collect()}


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["w%s" % "abcdefghij"[i % 10] * (1 + i // 10) for i in range(60)] + ["Éa", "ЖЗ", "x y", "ß"]
    rows = []
    for i in range(300):
        source = None if i % 50 == 0 else "s%d" % min(rng.randrange(9), 6)
        lang = rng.choice(["en", "en", "en", "fr", None])
        text = " 1-".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(len(vocabulary))], k=rng.randrange(30)))
        rows.append((text.upper() if i % 7 == 0 else text, lang, source))
    rows += [(None, "en", "quiet"), ("", "lonely", "a"), ("rare words", "lonely", "b"), ("the " * 200_000, "en", "s1")]
    rows += rows[:40]
    df = spark.createDataFrame(rows, "text string, lang string, source string") \
        .selectExpr("*", "1 AS n", "2 AS term", "3 AS kept").repartition(5)
    assert audit(df) == brute(rows)
    assert audit(df, top=3) == brute(rows, top=3)


def test_tree_is_the_same_at_any_cut(spark, monkeypatch):
    """Prefixes that span tasks, and combinations computed a few at a time."""
    rng = random.Random(1)
    rows = [(" ".join(rng.choices([a + b for a in "abcdefg" for b in "abcdefg"], k=12)), "en", "s%d" % rng.randrange(12))
            for _ in range(200)]
    df = spark.createDataFrame(rows, "text string, lang string, source string")
    want = brute(rows)
    assert audit(df) == want
    monkeypatch.setattr(D, "HELD_PAIRS", 5)
    monkeypatch.setattr(D, "HELD_TERMS", 20)
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    try:
        assert audit(df.repartition(9)) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_shares_beyond_64_bits(spark):
    """A count of 10**12 times the scale does not fit a long."""
    from pyspark.sql import functions as F

    got = spark.range(1).select(D.share(F.lit(10**12), F.lit(3 * 10**12), F.lit(7)).alias("p")).first().p
    assert got == 1 + 10**9 * (10**12 + 1) // (3 * 10**12 + 7)


def test_empty_table(spark):
    assert audit(spark.createDataFrame([], "text string, lang string, source string")) == {}
