"""Periodic runs against a scan of every period."""

import hashlib
import random
import zlib

import pytest

from sigmill.llm import periodic_runs as R

from . import helpers as H


def all_runs(x):
    """start, period, length of every maximal run with that smallest period."""
    n, out = len(x), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j > i and j - i + q >= max(12, 2 * q):
                block = x[i : i + q]
                if not any(q % d == 0 and block == block[:d] * (q // d) for d in range(1, q)):
                    out.append((i, q, j - i + q))
            i = j + 1
    return sorted(out)


def collapse(x, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(x) if i not in gone)


def tail(doc_id, text):
    x = H.WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not x:
        return x
    g, n = h // 10, len(x)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [x[i] if i < a else x[a + (i - a) % p] for i in range(n)]


def periodic_texts():
    rng = random.Random(8)
    out = ["", None, "a", " ".join(["ha"] * 400), "\n".join(["one two three"] * 200), " ".join("ab" for _ in range(11)), " ".join(["x"] * 12)]
    for k in range(120):
        n, letters = rng.choice([20, 60, 150, 400]), "ab" if k % 3 else "abcdefgh"
        x = [rng.choice(letters) for _ in range(n)]
        for _ in range(rng.randint(0, 4)):
            p, times, at = rng.randint(1, 60), rng.randint(2, 8), rng.randrange(n)
            block = [rng.choice(letters) for _ in range(p)]
            x[at:at] = block * times + block[: rng.randint(0, p)]
        out.append(" ".join(x))
    fib = ["a", "b"]
    for _ in range(13):
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join(str(i) for i in range(3000)), " ".join(list("pqrst" * 30) + [str(i) for i in range(500)] + list("pqrst" * 30))]


@pytest.mark.parametrize("planted", [False, True])
def test_runs_against_brute_force(spark, planted):
    data = [(i if i % 11 else None, t, "en", "a", None, 1, 0.5, 1, "k", 7) for i, t in enumerate(periodic_texts())] + [(3, " ".join(["ha"] * 400), "en", "a", None, 1, 0.5, 1, "k", 7)] * 2 + H.rows(n=20)
    docs = H.frame(spark, data).repartition(3)
    words = [tail(d, t) if planted else H.WORD.findall(t or "") for d, t, *_ in data]
    want = sorted(((d, [tuple(r) for r in all_runs(x)], x) for (d, *_), x in zip(data, words)), key=repr)
    rows = R.analyse(R.with_periodic_tails(docs) if planted else docs, keep_text=True).collect()
    got = sorted(((r.doc_id, [(x.start, x.period, x.length) for x in r.runs], r.collapsed, r.collapsed_sha256, r.n_words) for r in rows), key=lambda r: repr(r))
    expect = sorted(((d, runs, collapse(x, runs), hashlib.sha256(collapse(x, runs).encode()).hexdigest(), len(x)) for d, runs, x in want), key=lambda r: repr(r))
    assert got == expect
    assert sum(len(r[1]) for r in got) > 300
    if planted:
        flat = sorted(((r.doc_id, r.n_runs, r.start, r.length, r.period, r.exponent_milli, r.runs_sha256, r.collapsed_sha256) for r in R.digests(docs).collect()), key=repr)
        told = []
        for d, runs, x in want:
            top = min(((-n, s, q) for s, q, n in runs), default=None)
            four = (None,) * 4 if top is None else (top[1], -top[0], top[2], 1000 * -top[0] // top[2])
            text = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
            told.append((d, len(runs), *four, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapse(x, runs).encode()).hexdigest()))
        assert flat == sorted(told, key=repr)


def test_long_document_is_many_tiles(spark):
    """A run longer than any tile's reach is stitched from fragments of many tiles."""
    block = [f"w{i}" for i in range(37)]
    x = [f"u{i}" for i in range(100)] + block * 900 + ["end"]
    docs = H.frame(spark, [(1, " ".join(x), None, None, None, 1, 0.5, 1, "k", 7)])
    (row,) = R.analyse(docs).collect()
    assert [(r.start, r.period, r.length) for r in row.runs] == [(100, 37, 37 * 900)]
    cut = R._cut(docs, False).selectExpr("explode(tiles) as t").selectExpr("t.octave").collect()
    assert len(cut) > 100


def test_empty_table(spark):
    assert R.digests(H.frame(spark, [])).count() == 0
