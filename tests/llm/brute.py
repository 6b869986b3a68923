"""Plain-Python versions of the operators, for small inputs."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(ws, k=5):
    if not ws:
        return []
    k = min(k, len(ws))
    return [tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)]


def quality_counts(text):
    t = text or ""
    ws = WORD.findall(t)
    grams = [tuple(ws[i:i + 5]) for i in range(len(ws) - 4)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))


def groups(docs, percent=85):
    """docs: (doc_id, text), ids unique. {doc_id: (n_shingles, component)}"""
    sets = {d: frozenset(shingles(words(t))) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in ids}


def leaks(docs, items, percent=80):
    """{(doc_id, item_id): (similarity, start)} of the best window of the item's size (or the whole shorter document)."""
    out = {}
    for d, t in docs:
        ws = words(t)
        for i, it in items:
            iw = words(it)
            k = min(5, len(iw))
            if not iw or len(ws) < k:
                continue
            want = Counter(shingles(iw))
            for s in range(max(1, len(ws) - len(iw) + 1)):  # a shorter document is one window
                got = Counter(shingles(ws[s:s + len(iw)], k))
                common, union = sum((want & got).values()), sum((want | got).values())
                if 100 * common >= percent * union:
                    out[d, i] = max(out.get((d, i), (0, 0)), (common / union, -s))
    return {k: (v, -s) for k, (v, s) in out.items()}
