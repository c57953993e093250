"""The Merkle manifest against trees built in plain Python."""

import random
import zlib
from hashlib import sha256

import pytest

from sigmill.llm import merkle as M

from . import helpers as H


def H_(s):
    return sha256(s.encode()).hexdigest()


def leaf(row, text):
    parts = [row["doc_id"], row["source"], row["lang"], row["n_chars"], text]
    return H_("".join("-" if p is None else f"{len(str(p).encode())}:{p}" for p in parts))


def tree(nodes):
    """Levels from the nodes to the root."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H_("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def steps(levels, at):
    out = []
    for nodes in levels[:-1]:
        k = at - at % 8
        out.append(("".join(nodes[k:at]), "".join(nodes[at + 1 : k + 8])))
        at //= 8
    return out


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r["lang"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"]), r))
    langs = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in langs:
        groups[g].sort(key=lambda x: x[:3])
        trees[g] = tree([x[2] for x in groups[g]])
    top = tree([trees[g][-1][0] for g in langs])
    out = []
    for t, g in enumerate(langs):
        for k, (_, _, h, r) in enumerate(groups[g]):
            path = steps(trees[g], k) + steps(top, t)
            low = r["text"]
            if r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 0:
                low = None if low is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in low)
            cur = leaf(r, low)
            for a, z in path:
                cur = H_(a + cur + z)
            root = top[-1][0]
            out.append((r["doc_id"], h, trees[g][-1][0], root, H_("".join(a + z for a, z in path)), cur, cur == root))
    return sorted(out, key=repr)


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, node string, left int, grp int"


def table(rng, sizes):
    rows = []
    for lang, n in sizes.items():
        for _ in range(n):
            rows.append({"doc_id": rng.choice([None, 5, *range(10, 4000)]), "source": rng.choice([None, "a", "ü"]), "lang": lang, "n_chars": rng.choice([None, 3]), "text": rng.choice([None, "", "Ab É", "low", f"T{rng.random()}"]), "node": "x", "left": 1, "grp": 2})
    rows += rows[:3]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 4])
@pytest.mark.parametrize("sizes", [{None: 9, "de": 1, "en": 700, "fr": 64, "é": 65}, {f"l{k}": 1 + k % 3 for k in range(75)}, {"en": 2}, {"en": 1}])
def test_manifest_against_brute_force(spark, levels, sizes):
    """Small blocks make several rounds of the exchange, with incomplete last subtrees."""
    rows = table(random.Random(levels), sizes)
    docs = spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA).repartition(3)
    got = M.manifest(docs, proofs=True, levels=levels).collect()
    want = brute(rows)
    assert sorted([tuple(r)[:7] for r in got], key=repr) == want
    assert all(M.fold(r.leaf, [(p.left, p.right) for p in r.proof]) == r.root for r in got)


def test_edges(spark):
    assert M.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    data = H.rows(n=20)
    rows = [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in data]
    assert sorted([tuple(r) for r in M.manifest(H.frame(spark, data)).collect()], key=repr) == brute(rows)
