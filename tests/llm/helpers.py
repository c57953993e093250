"""Small documents with every edge case, and brute-force versions of the operators."""

import collections
import hashlib
import random
import re

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, `rank` int, key string, fp long"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7))) for _ in range(150)]
    passage = " ".join(rng.choice(words) for _ in range(30))
    out = []
    for i in range(n):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(5, 120)))
        if i % 4 == 0:
            t = t[: len(t) // 2] + "\n" + passage + "\n" + t[len(t) // 2 :]
        if i % 7 == 0:
            t = t.replace(" ", rng.choice(["  ", "\t", "\n"]), 3)
        out.append(t)
    out += [out[5], out[5], out[8] + " end", "", None, " ", "\n\n", "a", "THE The the", "x" * 300, " lead", "trail ", "## $$ %% && ||", "a b\na b\na b\n\na b"]
    out.append(" ".join(words * 40))  # a long one
    return out


def rows(seed=3, n=60):
    out = []
    for i, t in enumerate(texts(seed, n)):
        out.append((i, t, [None, "en", "de"][i % 3], [None, "a", "b"][i % 3], None, i, 0.5, 1, "k", 7))
    out.append((3, out[3][1], "en", "a", None, 3, 0.5, 1, "k", 7))  # a repeated row
    return out


def frame(spark, data):
    return spark.createDataFrame(data, DOCS)


def base_counts(t):
    t = t or ""
    ws = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    win = collections.Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    cov = [False] * len(ws)
    for i in range(len(ws) - 7):
        if win[tuple(ws[i : i + 8])] > 1:
            cov[i : i + 8] = [True] * 8
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in t), dup, sum(cov)


def fingerprint(t, size=3):
    ws = WORD.findall(lower(t))
    if not ws:
        return 0
    g = [" ".join(ws[i : i + size]) for i in range(len(ws) - size + 1)] or [" ".join(ws)]
    h = np.array([xxhash.xxh64_intdigest(x.encode(), 42) for x in g], dtype=np.uint64)
    ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=int)
    return sum(1 << i for i in range(64) if ones[i] * 2 > len(h))


def groups(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def removed(docs, length=50):
    """docs: {doc_id: text}. Per doc_id: kept bytes, removed bytes, spans."""
    first = {}
    for i in sorted(docs):
        b = (docs[i] or "").encode()
        for k in range(len(b) - length + 1):
            first.setdefault(b[k : k + length], i)
    out = {}
    for i, t in docs.items():
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if first[b[k : k + length]] < i:
                gone[k] += 1
                gone[k + length] -= 1
        m = np.cumsum(gone)[:-1] > 0
        spans = int(m[:1].sum()) + int((m[1:] & ~m[:-1]).sum())
        out[i] = (np.frombuffer(b, np.uint8)[~m].tobytes(), int(m.sum()), spans)
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()
