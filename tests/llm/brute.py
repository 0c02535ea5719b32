"""Plain versions of the operators, for small fixtures."""

import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def substring_dedup(docs, window=13):
    words = [(i, WORD.findall(t or "")) for i, t in docs]
    own = {}
    for i, w in words:
        for j in range(len(w) - window + 1):
            key = tuple(w[j:j + window])
            own[key] = min(own.get(key, i), i)
    out = []
    for i, w in words:
        gone = set()
        for j in range(len(w) - window + 1):
            if own[tuple(w[j:j + window])] < i:
                gone.update(range(j, j + window))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return out


def suffix_dedup(docs, length=50):
    raw = [(i, (t or "").encode()) for i, t in docs]
    own = {}
    for i, b in raw:
        for j in range(len(b) - length + 1):
            own[b[j:j + length]] = min(own.get(b[j:j + length], i), i)
    out = []
    for i, b in raw:
        gone = [False] * len(b)
        for j in range(len(b) - length + 1):
            if own[b[j:j + length]] < i:
                gone[j:j + length] = [True] * length
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def shingles(text, width=5):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[j:j + width]) for j in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def near_duplicates(docs, percent=80):
    sets = [(i, shingles(t)) for i, t in docs]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[a + 1:]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    return [(i, len(s), find(i)) for i, s in sets]


def top_k(vectors, k=5, scale=256):
    import math

    rows = [(i, [math.floor(scale * x) for x in v]) for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q in rows:
        if i % 50 == 0:
            best = sorted(((-sum(a * b for a, b in zip(q, x)), j) for j, x in rows if j != i))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return out
