import hashlib
import math
import subprocess
import sys
import unicodedata
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as C
from sendwatch.llm import langid
from tests.conftest import SF_SMALL
from tests.llm import brute

ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def steps(spark):
    from sendwatch.llm.common import materialize

    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    out = [docs]
    for _, stage in C.STAGES:
        out.append(materialize(stage(spark, out[-1], SF_SMALL)))
    return out


def _texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_stages_against_brute_force(spark, steps):
    for step in steps[:-1]:
        assert step.columns == steps[0].columns
    every, good, known, unique, clean = map(_texts, steps[:-1])
    for d in set(every) - set(good):
        n, _, symbols, _, repeat = brute.quality_counts(every[d])
        assert n < 10 or 100 * repeat > 20 * n or symbols > 0.05 * n
    assert set(known) <= set(good)
    groups = brute.groups(sorted(known.items()), percent=80)
    assert set(unique) == {d for d, (_, c) in groups.items() if c == d}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    assert set(unique) - set(clean) == {d for d, _ in brute.leaks(sorted(unique.items()), items)}
    assert {r.doc_id for r in steps[-1].collect()} == set(clean)


def _votes(text):
    """Votes of the nine rules, written out."""
    t = text or ""
    ws = brute.WORD.findall(t)
    n, chars, symbols, dup, repeat = brute.quality_counts(t)
    lines = sum(bool(brute.WORD.search(x)) for x in t.split("\n"))
    letters = [c for c in t if unicodedata.category(c)[0] == "L"]
    upper = sum(unicodedata.category(c) == "Lu" for c in letters)
    digits, marks = sum(c in "0123456789" for c in t), sum(c in "!?" for c in t)
    per = lambda a, b: a / max(b, 1)
    vote = lambda bad, good: -1 if bad else 1 if good else 0
    x, a, u, v, w = per(symbols, n), per(len(letters), chars), per(upper, len(letters)), per(len(set(ws)), n), per(chars, n)
    d, r, g, m = per(dup, lines), per(repeat, n), per(digits, chars), per(marks, n)
    return (vote(x > .1, x <= .02), vote(a < .8, a >= .9), vote(u > .5, u <= .2), vote(n >= 50 and v < .2, v >= .4),
            vote(w < 2.5 or w > 12, 3.5 <= w <= 8), vote(d > .5, d <= .2), vote(r > .2, r <= .1),
            vote(g > .5, g <= .2), vote(m > .5, m <= .1))


def _good(every):
    votes = {d: _votes(t) for d, t in every.items()}
    q = {d: .05 if -1 in v else .95 for d, v in votes.items()}
    last = None
    for _ in range(40):
        good = sum(q.values())
        bad = len(q) - good
        sums = Counter()
        for d, v in votes.items():
            for k, x in enumerate(v):
                sums[1, k, x] += q[d]
                sums[0, k, x] += 1 - q[d]
        rate = {(c, k, x): (sums[c, k, x] + 10 * p) / (n + 10) for k in range(9)
                for c, n, prior in ((1, good, (.001, .049, .95)), (0, bad, (.1, .1, .8))) for x, p in zip((-1, 0, 1), prior)}
        share = (good + 1) / (good + bad + 2)
        flat = [share, *rate.values()]
        if last and max(abs(a - b) for a, b in zip(flat, last)) < 1e-6:
            break
        last = flat
        q = {d: 1 / (1 + math.exp(-math.log(share / (1 - share)) - sum(
            math.log(rate[1, k, x] / rate[0, k, x]) for k, x in enumerate(v)))) for d, v in votes.items()}
    counts = {d: brute.quality_counts(t) for d, t in every.items()}
    return {d for d in every if q[d] >= .5 and counts[d][0] >= 10 and 100 * counts[d][4] <= 20 * counts[d][0]}


def _vector(text, v, memo):
    codes = [0]
    for c in (text or "").lower():
        code = ord(c) if unicodedata.category(c)[0] == "L" else 0
        if code or codes[-1]:
            codes.append(code)
    codes += [0] * bool(codes[-1])
    out = np.zeros(1024)
    for g, n in Counter(zip(codes, codes[1:], codes[2:])).items():
        if g not in memo:
            memo[g] = np.roll(v.letter(g[0]), 2) * np.roll(v.letter(g[1]), 1) * v.letter(g[2])
        out += n * memo[g].astype(float)
    return out


def _known(good, langs):
    v, memo = langid.Vectors(langid.Params()), {}
    vectors = {d: _vector(t, v, memo) for d, t in good.items()}
    prototypes = {}
    for d, x in vectors.items():
        if langs[d] is not None and zlib.crc32(str(d).encode()) % 4 != 2:
            prototypes[langs[d]] = prototypes.get(langs[d], 0) + x
    cosine = lambda a, b: a @ b / max(np.linalg.norm(a) * np.linalg.norm(b), 1e-30)
    return {d for d, x in vectors.items() if max(cosine(x, y) for y in prototypes.values()) >= C.LEAST_LANGUAGE_SCORE}


def test_kept_ids_and_digests_against_plain_python(spark, steps):
    import sentencepiece

    every, good, known = map(_texts, steps[:3])
    assert set(good) == _good(every)
    langs = {r.doc_id: r.lang for r in steps[1].select("doc_id", "lang").collect()}
    assert set(known) == _known(good, langs)
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {}
    for d, t in _texts(steps[-2]).items():
        ids = sp.encode(t or "", add_eos=True)
        want[d] = (len(ids), sha(" ".join(map(str, ids))), sha(sp.decode(ids)), ids)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256, list(r.ids)) for r in steps[-1].collect()} == want


def test_labels(spark, steps):
    """Documents of good quality that are no copies survive the filters."""
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    every, _, known = (_texts(s) for s in steps[:3])
    base_ok = {d for d, t in every.items() if (c := brute.quality_counts(t))[0] >= 10 and 100 * c[4] <= 20 * c[0]}
    good = {d for d, q in labels.items() if q == 1} & base_ok
    assert len(good & set(known)) >= 0.99 * len(good)
    assert not {d for d, q in labels.items() if q == 0} & set(known)


def test_odd_rows_pass_through_every_stage(spark):
    text = "the quick brown fox jumps over some lazy dogs while many birds sing in tall trees near number {}"
    rows = [(i, text.format(f"x{i} y{i} z{i}"), "en", "s", 1) for i in range(40)]
    rows += [(None, None, None, None, None), (None, text.format("q"), None, None, None), (5, "", "en", "s", 0),
             (50, "word " * 30000, "en", "s", 1), (3, rows[3][1], "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long") \
        .selectExpr("*", "1 AS quality", "2 AS node", "3 AS score", "4 AS __verdict")
    df = docs
    for _, stage in C.STAGES[:-1]:
        df = stage(spark, df, SF_SMALL)
        assert df.columns == docs.columns
    assert 0 < df.count() <= 41
    empty = docs.limit(0)
    for _, stage in C.STAGES:
        assert stage(spark, empty, SF_SMALL).count() == 0
    assert langid.UNKNOWN == "und"


def test_entry_works_without_the_subpackage(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name == 'corpus_pipeline' or name.startswith('sendwatch.llm'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "names = e.queries()\n"
        "assert 'account_rates' in names and not any(n.startswith('op') and n[2].isdigit() for n in names)\n"
        "assert 'pipeline' not in names and set(e.oracle_sql()) <= set(names)\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_registered():
    import __spark_entry__ as e

    names = list(e.queries())
    assert [n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()] == [f"op{i}" for i in range(1, 11)]
    assert "pipeline" in names
