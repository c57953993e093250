import base64
import collections
import hashlib
import zlib

import numpy as np
import pandas as pd
import pytest

from sigmill.llm import language_id, line_crf, near_copies, ngram_model, packing, pieces, posting_lists, quality_rules, simhash, suffix_dedup, warc

from . import helpers as H


@pytest.fixture(scope="module")
def data():
    return H.rows()


@pytest.fixture(scope="module")
def docs(spark, data):
    return H.frame(spark, data).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return H.frame(spark, [])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_quality_counts_and_verdict(docs, data, empty):
    got = quality_rules.judge(docs, min_group=5)
    found = by_id(got)
    assert got.count() == len(data)
    for i, t, *_ in data:
        n, chars, symbols, dup, rep = H.base_counts(t)
        r = found[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, rep), i
        assert r.base_failed == (n < 20 or 100 * rep > 30 * n)
        assert not (r.base_failed and r.kept)
    assert quality_rules.judge(empty).count() == 0


def test_quality_rejects_an_outlier(spark):
    rng = np.random.RandomState(1)
    good = [(i, " ".join("abcdefg"[: 2 + k % 5] for k in rng.randint(0, 99, rng.randint(60, 140))) + f" w{i}", "en", "s", None, 0, 0.0, 0, "", 0) for i in range(200)]
    bad = [(999, " ".join(["##$$%%", "&&||<>"] * 20) + " a b c d e f g h", "en", "s", None, 0, 0.0, 0, "", 0)]
    got = by_id(quality_rules.judge(H.frame(spark, good + bad)).select("doc_id", "kept", "base_failed"))
    assert sum(got[i].kept for i in range(200)) >= 198 - sum(got[i].base_failed for i in range(200))
    assert not got[999].kept


def _least_determinant(x, share, starts=300):
    """Exact C-steps from many random starts."""
    rng, best = np.random.RandomState(0), None
    h = int(np.ceil(share * len(x)))
    for k in range(starts):
        s = x if not k else x[rng.choice(len(x), 12, replace=False)]
        m, c = s.mean(0), np.cov(s.T, bias=True) + quality_rules.ERROR
        for _ in range(50):
            d = np.einsum("ni,ij,nj->n", x - m, np.linalg.inv(c), x - m)
            near = x[np.argsort(d)[:h]]
            m, c = near.mean(0), np.cov(near.T, bias=True) + quality_rules.ERROR
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = (det, m, c - quality_rules.ERROR)
    return best


def test_quality_distances_match_a_brute_force_determinant_search(spark):
    rng = np.random.RandomState(3)
    rows = []
    for i in range(160):
        n = int(np.exp(rng.normal(4.6, 0.5))) + 20
        words = ["abcdefghijkl"[: 2 + k] + f"{j}" for j, k in enumerate(rng.randint(0, 8, n))]
        if i % 10 == 3:  # moderate outliers: longer words and symbols
            words = [w + "#" * (j % 3 == 0) + "zzz" for j, w in enumerate(words)]
        rows.append((i, " ".join(words), "en", "s", None, 0, 0.0, 0, "", 0))
    base = quality_rules.counts(H.frame(spark, rows)).withColumn("base_failed", quality_rules.F.lit(False))
    x, params = quality_rules.mcd(base)
    (p,) = params.collect()
    table = x.toPandas().sort_values("doc_id")
    at = table[["x0", "x1", "x2", "x3", "x4"]].to_numpy()
    det, m, c = _least_determinant(at, 0.75)
    assert p.log_det == pytest.approx(det, abs=0.03)
    free = max(np.trace(c @ np.linalg.inv(c + quality_rules.ERROR)), 1)
    c = c * 0.75 / quality_rules.chi2_cdf(quality_rules.chi2_quantile(0.75, free), free + 2) + quality_rules.ERROR
    d2 = np.einsum("ni,ij,nj->n", at - m, np.linalg.inv(c), at - m)
    cut = quality_rules.chi2_quantile(0.999999, free)
    assert p.cutoff == pytest.approx(cut, rel=0.05)
    got = by_id(quality_rules.judge(H.frame(spark, rows)))
    for i in range(160):
        assert got[i].d2 == pytest.approx(d2[i], rel=0.05, abs=0.2)
        if abs(np.log(d2[i] / cut)) > 0.06:
            assert got[i].kept == (d2[i] <= cut)
        assert got[i].kept == (i % 10 != 3)
    clean = np.array([got[i].d2 for i in range(160) if i % 10 != 3])
    assert abs(np.median(clean) - quality_rules.chi2_quantile(0.5, free)) < 0.6


def test_determinants_never_rise(spark):
    """C-steps of two groups, from a start that has all documents and goes far."""
    from pyspark.sql import functions as F

    rng = np.random.RandomState(8)
    x = rng.standard_t(2, (3000, 5)) * [0.5, 1, 2, 3, 1]
    x[:900, 2:4] += 9
    rows = [("=a" if i % 3 else "=b", "=s", *map(float, r)) for i, r in enumerate(x)]
    good = spark.createDataFrame(rows, "g_lang string, g_source string, x0 double, x1 double, x2 double, x3 double, x4 double").cache()
    params, dets = quality_rules._step(good.withColumn("start", F.lit(0)).withColumn("bin", F.lit(0)), 0.75), []
    for _ in range(8):
        found = params.collect()
        dets.append([r.log_det for r in sorted(found)])
        params = quality_rules._step(quality_rules._binned(good, spark.createDataFrame(found, params.schema)), 0.75)
    fall = -np.diff(np.array(dets), axis=0)
    assert (fall > -1e-3).all() and (fall[0] > 0.1).all()
    best = spark.createDataFrame(found, params.schema).withColumn("falls", F.lit(True))
    kept = quality_rules._better(best, params).collect()
    assert all(r.log_det <= d for r, d in zip(sorted(kept), dets[-1]))


def test_chi_squared():
    assert quality_rules.chi2_quantile(0.75, 5) == pytest.approx(6.6257, abs=1e-4)
    assert quality_rules.chi2_quantile(0.999999, 5) == pytest.approx(35.888, abs=1e-3)
    assert quality_rules.chi2_cdf(2.0, 2) == pytest.approx(1 - np.exp(-1))


def test_posting_lists_match_brute_force(spark):
    rng = np.random.RandomState(5)
    x = rng.randn(900, 12).astype(np.float32)
    x[100:400] = x[100]  # a third share one vector
    rows = [(i, [float(v) for v in r], i, "s") for i, r in enumerate(x)]
    rows += [(2000, None, 0, ""), (2001, [0.0] * 12, 0, ""), (2002, [float("nan")] * 12, 0, ""), (2003, [None] * 12, 0, ""), (2004, [1.0], 0, ""), (None, [1.0] * 12, 0, ""), rows[7]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int, cluster string")
    from pyspark.sql import functions as F

    got = posting_lists.search(df, F.col("query_id") % 50 == 0, list_size=30).toPandas()
    y = x.astype(float)
    s = y @ y.T / np.outer(np.linalg.norm(y, axis=1), np.linalg.norm(y, axis=1))
    hit = 0
    assert sorted(got.query_id.unique()) == list(range(0, 900, 50))
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == [1, 2, 3, 4, 5] and q not in set(g.vec_id)
        assert np.allclose(g.score, s[q, g.vec_id], atol=1e-12)
        row = np.round(s[q].copy(), 12)
        row[q] = -9
        hit += len(set(np.lexsort((np.arange(900), -row))[:5]) & set(g.vec_id))
    assert hit / (5 * 18) >= 0.9
    few = posting_lists.search(df.filter("vec_id < 3"), F.col("query_id") == 0).toPandas()
    assert list(few["rank"]) == [1, 2]
    assert posting_lists.search(df.filter("vec_id < 0"), F.col("query_id") == 0).count() == 0
    short = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 2.0]), (4, [1.0])], "vec_id long, embedding array<double>")
    odd = posting_lists.search(df.select("vec_id", F.col("embedding").cast("array<double>")).filter("vec_id = 0").unionAll(short), F.col("query_id") < 5)
    assert sorted((r.query_id, r["rank"], r.vec_id) for r in odd.collect()) == [(1, 1, 2), (1, 2, 3), (2, 1, 1), (2, 2, 3), (3, 1, 2), (3, 2, 1)]


@pytest.mark.parametrize("spread", [None, 0.3])
def test_posting_lists_reach_their_recall(spread):
    """Lists and visits of vectors without clusters (None) and with them, against brute force over all."""
    rng = np.random.RandomState(3)
    n, lists, asked = 24_000, 160, 150
    x = rng.randn(n, 64) if spread is None else rng.randn(200, 64)[rng.randint(0, 200, n)] + spread * rng.randn(n, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    router = posting_lists.Router(posting_lists.clusters(x[:20_000], lists))
    parts = [router.lists(x[a : a + 4000]) for a in range(0, n, 4000)]
    held = np.zeros((n, lists), bool)
    for a, (row, c) in enumerate(parts):
        held[4000 * a + row, c] = True
    row, c = router.visited(x[:asked])
    sees = np.zeros((asked, lists), bool)
    sees[row, c] = True
    s = x[:asked] @ x.T
    s[np.arange(asked), np.arange(asked)] = -9
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([(sees[i] & held[b]).any() for i in range(asked) for b in best[i]]) >= 0.95
    # no list within the ratio is left out, however many there are
    d = posting_lists.distances(x[:asked] @ router.graph.centroids.T)
    within = d <= router.ratio * d.min(axis=1, keepdims=True)
    assert (within & sees).sum() / within.sum() > 0.98
    if spread is None:
        assert within.sum(axis=1).max() > 64


def test_graph_search_finds_the_nearest_centroids():
    rng = np.random.RandomState(2)
    c = rng.randn(500, 16)
    c /= np.linalg.norm(c, axis=1, keepdims=True)
    x = rng.randn(64, 16)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, _ = posting_lists.Graph(c).search(x, 8)
    want = np.argsort(-(x @ c.T), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, want)]) > 0.9


def test_suffix_dedup_is_exact(docs, data, empty):
    want = H.removed({i: t for i, t, *_ in data})
    got = suffix_dedup.digests(docs)
    assert got.count() == len(data)
    for r in got.collect():
        kept, gone, spans = want[r.doc_id]
        assert (r.n_removed, r.n_spans, r.kept_sha256) == (gone, spans, H.sha(kept)), r.doc_id
    cut = {r.doc_id: r for r in suffix_dedup.dedup(docs).collect()}
    assert set(docs.columns) < set(cut[0].asDict())
    for i, t, *_ in data:
        assert (cut[i].text is None) == (t is None)
        assert (cut[i].text or "") == want[i][0].decode(errors="ignore")
    assert suffix_dedup.digests(empty).count() == 0


def test_suffix_dedup_null_ids_and_short_texts(spark):
    t = "q" * 70
    rows = [(None, t), (None, t), (2, t), (5, t + "z"), (1, "short"), (4, "short")]
    df = spark.createDataFrame([(i, x, None, None, None, 0, 0.0, 0, "", 0) for i, x in rows], H.DOCS)
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix_dedup.digests(df).collect()]
    assert sorted(got, key=str) == sorted([(None, 70, 0), (None, 70, 0), (2, 70, 0), (5, 71, 70), (1, 5, 0), (4, 5, 0)], key=str)


@pytest.mark.parametrize("seed", range(4))
def test_loser_tree_merges_and_knows_prefixes(seed):
    rng = np.random.RandomState(seed)
    runs = []
    for _ in range(rng.randint(1, 9)):
        rows = rng.randint(97, 99 + seed, (rng.randint(0, 40), 50)).astype(np.uint8)
        rows = rows[np.lexsort(rows.T[::-1])] if len(rows) else rows
        common, tails = suffix_dedup.front_code(rows)
        assert suffix_dedup.front_decode(common, tails) == [r.tobytes() for r in rows]
        runs.append((suffix_dedup.front_decode(common, tails), common.tolist()))
    flat = [s for r, _ in runs for s in r]
    order, commons = suffix_dedup.merge_runs(runs)
    assert [flat[i] for i in order] == sorted(flat)
    for k in range(1, len(flat)):
        a, b = flat[order[k - 1]], flat[order[k]]
        assert commons[k] == next((i for i in range(50) if a[i] != b[i]), 50)


def test_kneser_ney_matches_brute_force(docs, data, empty, monkeypatch):
    monkeypatch.setattr(ngram_model, "SHARD_BYTES", 5_000)  # several shards and tasks
    monkeypatch.setattr(ngram_model, "TASK_BYTES", 5_000)
    tokens = [(i, H.WORD.findall(H.lower(t)) + ["\n"]) for i, t, *_ in data]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
    one, two = collections.Counter(), collections.Counter()
    for i, t in tokens:
        if not held[i]:
            one.update(t)
            two.update(zip(["\t"] + t, t))
    n, v = sum(one.values()), len(one)
    before = collections.Counter(w for _, w in two)
    total, kinds = collections.Counter(), collections.Counter()
    for (a, _), c in two.items():
        total[a] += c
        kinds[a, min(c, 3)] += 1
    cc = lambda x: [sum(1 for c in x.values() if c == k) for k in (1, 2, 3, 4)]
    d2, d1 = ngram_model.discounts(*cc(two)), ngram_model.discounts(*cc(before))
    rest = sum(d1[min(c, 3)] for c in before.values()) / len(two)

    def p(a, w):
        low = (before[w] - d1[min(before[w], 3)]) / len(two) + rest / (v + 1)
        if not total[a]:
            return low
        return (two[a, w] - d2[min(two[a, w], 3)]) / total[a] + sum(d2[k] * kinds[a, k] for k in (1, 2, 3)) / total[a] * low

    got = ngram_model.score_corpus(docs)
    assert got.count() == len(data)
    found = by_id(got)
    for i, t in tokens:
        r = found[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(t), sum(one[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(np.log10((one[w] + 1) / (n + v + 1)) for w in t))
        assert r.score == pytest.approx(sum(np.log10(p(a, w)) for a, w in zip(["\t"] + t, t)))
    assert sum(p("a", w) for w in one) + (p("a", "unseen") if not before["unseen"] else 0) == pytest.approx(1.0)
    assert ngram_model.score_corpus(empty).count() == 0


def test_language_id(spark, empty):
    rng = np.random.RandomState(3)
    syl = {"xx": ["ba", "do", "ki", "lu"], "yy": ["sch", "ung", "ein", "ter"]}
    rows = [(i, " ".join("".join(rng.choice(syl[lang], 2)) for _ in range(20)), lang, "s", None, 0, 0.0, 0, "", 0) for i in range(80) for lang in [["xx", "yy"][i % 2]]]
    rows += [(900, None, "xx", "", None, 0, 0.0, 0, "", 0), (901, "12 34 ..", "yy", "", None, 0, 0.0, 0, "", 0), (902, "", None, "", None, 0, 0.0, 0, "", 0), (903, "baki " * 20000 + "q" * 500, None, "", None, 0, 0.0, 0, "", 0)]
    found = by_id(language_id.identify(H.frame(spark, rows)))
    assert all(found[i].lang_pred == ["xx", "yy"][i % 2] for i in range(80))
    assert all(found[i].lang_pred == "und" and found[i].score == 0 for i in (900, 901, 902))
    assert found[903].lang_pred == "xx" and 0 <= found[903].score <= 1
    assert language_id.identify(empty).count() == 0


def test_forward_sums_all_segmentations():
    model = language_id.fit({"a": ["the then thenthe et"], "b": ["ten net tent"]})
    words, begin, size, _, _ = language_id.distinct_words(np.frombuffer(b"then", np.uint8), np.array([0, 4]))
    got = model.word_scores(words, begin, size)[0]
    table = {}
    v = pieces.vocabulary()
    for b in {bytes(language_id.LOWER[np.frombuffer(x, np.uint8)]) for x in v.bytes if x} | {bytes([k]) for k in range(256)}:
        table[b] = None
    names = sorted(table)
    where = {t: k for k, t in enumerate(names)}

    def total(s, k):
        if not s:
            return 1.0
        return sum(np.exp(model.log_p[where[s[:n]], k]) * total(s[n:], k) for n in range(1, len(s) + 1) if s[:n] in where)

    for k in range(2):
        assert got[k] == pytest.approx(np.log(total(b" then", k)))


def test_long_pieces_and_long_words_are_summed_whole():
    model = language_id.fit({"a": ["the then internationalisation the"], "b": ["ten net tent"]})
    p = language_id.Pieces()
    assert p.lengths[-1] > 16
    v = pieces.vocabulary()
    names = sorted({bytes(language_id.LOWER[np.frombuffer(x, np.uint8)]) for x in v.bytes if x} | {bytes([k]) for k in range(256)})
    where = {t: k for k, t in enumerate(names)}
    longest = max((t for t in names if t.isascii() and b" " not in t.strip() and t.strip()), key=len)
    assert len(longest) >= 16
    rng = np.random.RandomState(4)
    tests = [longest.strip(), b"x" + longest.strip() * 2, bytes(rng.choice(list(b"thenxyz"), 200)), b"the" * 30, b"q" * 300, b"a" * 39, b"a" * 40]
    for word in tests:
        words, begin, size, which, _ = language_id.distinct_words(np.frombuffer(word, np.uint8), np.array([0, len(word)]))
        assert len(begin) == 1
        got = model.word_scores(words, begin, size)[0]
        s = b" " + word
        for k in range(2):
            log_a = [0.0]
            for end in range(1, len(s) + 1):
                terms = [log_a[a] + model.log_p[where[s[a:end]], k] for a in range(end) if s[a:end] in where]
                log_a.append(max(terms) + np.log(sum(np.exp(x - max(terms)) for x in terms)))
            assert got[k] == pytest.approx(log_a[-1], rel=1e-9)


def test_language_id_predicts_as_brute_force_does(spark, data, docs):
    """The whole query once more in plain Python, from the operator's piece probabilities."""
    held = {i: zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in data}
    texts = {}
    for i, (t, lang) in {i: (t, lang) for i, t, lang, *_ in data if not held[i] and lang and t}.items():
        texts.setdefault(lang, []).append((i, t))
    model = language_id.fit({k: [t for _, t in sorted(x)] for k, x in texts.items()})
    v = pieces.vocabulary()
    names = sorted({bytes(language_id.LOWER[np.frombuffer(x, np.uint8)]) for x in v.bytes if x} | {bytes([k]) for k in range(256)})
    log_p = {t: model.log_p[k] for k, t in enumerate(names)}
    memo = {}

    def score(word):
        if word not in memo:
            s, a = b" " + word, [np.zeros(len(model.langs))]
            for end in range(1, len(s) + 1):
                a.append(np.logaddexp.reduce([a[b] + log_p[s[b:end]] for b in range(end) if s[b:end] in log_p]))
            memo[word] = a[-1]
        return memo[word]

    for r in language_id.identify(docs).collect():
        t = dict((i, t) for i, t, *_ in data)[r.doc_id]
        if not any(c.isalpha() for c in t or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        total = sum((score(w.encode()) for w in H.WORD.findall(H.lower(t))), np.zeros(len(model.langs))) + model.prior
        p = np.exp(total - total.max())
        p /= p.sum()
        assert r.held_out == held[r.doc_id] and r.lang_pred == model.langs[int(p.argmax())]
        assert r.score == pytest.approx(p.max(), rel=1e-6)


def test_simhash_components_are_exact(docs, data, empty):
    got = simhash.components(docs)
    assert got.count() == len(data)
    fps = [H.fingerprint(t) for _, t, *_ in data]
    roots = H.groups(len(data), lambda i, j: bin(fps[i] ^ fps[j]).count("1") <= 3)
    least = {}
    for (i, *_), g in zip(data, roots):
        least[g] = min(least.get(g, i), i)
    found = by_id(got)
    for (i, *_), f, g in zip(data, fps, roots):
        assert (found[i].fingerprint, found[i].component_id) == (f"{f:016x}", least[g])
    assert simhash.components(empty).count() == 0


def test_bk_tree_and_block_masks_lose_no_link():
    rng = np.random.RandomState(8)
    base = rng.randint(0, 2**63, 20).astype(np.uint64)
    words = np.unique(np.concatenate([base, *[b ^ np.bitwise_or.reduce(np.uint64(1) << rng.randint(0, 64, (3, 60)).astype(np.uint64), axis=0) for b in base]]))
    near = np.bitwise_count(words[:, None] ^ words[None, :]) <= 3
    found = np.zeros_like(near)
    for a, b in simhash.BKTree(words).within(3):
        found[a, b] = found[b, a] = True
    np.fill_diagonal(near, False)
    assert (found == near).all()
    for count in (100, 10**8, 10**11):
        masks = np.array(simhash.block_masks(3, count), np.uint64)
        for i, j in zip(*np.nonzero(near)):
            assert ((words[i] & masks) == (words[j] & masks)).any()


def test_trees_hold_the_shards_of_a_table(spark):
    """Nearly all fingerprints of a whole table lie in shards whose tree has edges, of bounded size and depth."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = np.unique(np.array([r.fp for r in simhash.fingerprints(docs).collect()], np.int64)).view(np.uint64)
    masks = simhash.block_masks(3, len(words))
    searched = 0
    for m in masks:
        keys = words & np.uint64(m)
        for key in np.unique(keys):
            tree = simhash.BKTree(words[keys == key])
            edges = sum(len(below) for pivot, below in tree.nodes if pivot is not None)
            assert edges == len(tree.nodes) - 1
            searched += len(tree.words) * (edges > 0)
    assert searched > 0.9 * len(words) * len(masks)


def test_chain_components(spark):
    from sigmill.llm.components import connected

    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 90), (90, 95), (5, 5), (None, 3)], "a long, b long")
    got = {r.node: r.root for r in connected(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, 90: 90, 95: 90, 100: 90}


def test_pieces_round_trip_and_stream(docs, data, empty):
    got = pieces.digests(docs)
    assert got.count() == len(data) and all(r.round_trip for r in got.collect())
    ids = pieces.encode(docs)
    back = {r.doc_id: r.text for r in pieces.decode(ids.drop("text")).collect()}
    assert back == {i: t for i, t, *_ in data}
    e = pieces.Encoder()
    for t in [t for _, t, *_ in data if t] + ["▁ ▁x", "the" * 100, "é" * 90, "a   b  c "]:
        want, s, out = np.frombuffer(e(t), "<u4").tolist(), pieces.StreamingViterbi(e.v), []
        for k in range(0, len(t), 5):
            out += s.feed(t[k : k + 5])
            assert len(s.open) <= e.v.longest
            assert len(s.raw) < 250 or len(set(t)) < 3  # a run of one character has no boundary that all paths share
        assert out + s.finish() == want
    assert pieces.digests(empty).count() == 0


def _best_path(v, raw):
    """Plain dynamic programming over all pieces that end at each character."""
    text = raw.replace("▁", "\0").replace(" ", "▁")
    score, back = [0], [None]
    for end in range(1, len(text) + 1):
        found = [(score[end - 1] + v.byte_score * len(raw[end - 1].encode()), end - 1, None)]
        for begin in range(max(0, end - v.longest), end):
            i = v.ids.get(text[begin:end])
            if i is not None:
                found.append((score[begin] + v.scores[i], begin, i))
        best = max(x[0] for x in found)
        ties = [x for x in found if x[0] == best]
        ties = [x for x in ties if x[2] is not None] or ties
        score.append(best)
        back.append(min(ties, key=lambda x: x[1])[1:])
    out, end = [], len(text)
    while end:
        begin, i = back[end]
        out += [i] if i is not None else [v.byte_ids[b] for b in reversed(raw[begin:end].encode())]
        end = begin
    return out[::-1]


def test_pieces_are_the_best_path(data):
    e = pieces.Encoder()
    odd = ["wait... and, so,on.", "a.b ,c ..d", "x\n\ny.\n", "3.14, 2,718", "end.", ",", "It's U.S.A. !?.,", "\x1f a.b", "Thé.\nCafé, ñ. ▁."]
    for t in [t for _, t, *_ in data if t] + odd:
        assert np.frombuffer(e(t[:2000]), "<u4").tolist() == _best_path(e.v, t[:2000]), t[:80]


def test_ids_are_committed_where_backpointers_converge(data):
    e, plain = pieces.Encoder(), pieces.StreamingViterbi(pieces.vocabulary())
    texts = [t for _, t, *_ in data if t] + ["one two three. " * 40, "x" * 300 + " y, z.", "a  b" * 30, "\n\n,,..  " * 20]
    total = fed = 0
    for t in texts:
        ids = np.frombuffer(e(t), "<u4").tolist()
        total += len(ids)
        committed = []
        for c in t:  # the same stream, character by character, without any table
            committed += plain.feed(c) + plain.settle()
        fed += len(committed)
        assert committed + plain.finish() == ids
    assert fed > 0.9 * total and e.at_end < 0.1 * total  # most ids are certain before their text ends


def test_each_state_and_part_goes_through_the_stream_once(data):
    e = pieces.Encoder()
    texts = [t for _, t, *_ in data if t]
    first = [e(t) for t in texts]
    went = e.streamed
    assert went >= sum(len(k) for k in e.known) / 2 and all(len(k) <= e.SPAN for k in e.known)
    assert [e(t) for t in texts] == first
    long = sum(len(p) for t in texts for p in pieces._parts(t) if len(p) > e.SPAN)
    assert e.streamed - went <= 2 * long  # what is longer is searched again


def test_a_run_of_one_character_takes_linear_time():
    import time

    e = pieces.Encoder()
    took = []
    for n in (100_000, 1_000_000):
        began = time.perf_counter()
        ids = np.frombuffer(e("x" * n), "<u4")
        took.append(time.perf_counter() - began)
        assert e.decode(ids.tolist()) == "x" * n
    assert took[1] < 25 * took[0] + 1


def test_packing_covers_every_id_once(docs, data, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    tk = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs).toPandas()
    counts = collections.Counter(i for i, *_ in data)
    for i, t, *_ in data:
        ids = tk.encode(t or "", add_special_tokens=False).ids + [0]
        part = got[got.doc_id == i].sort_values("start")
        assert part.length.sum() == len(ids) * counts[i] and (part.doc_tokens == len(ids)).all()
        for x in part.itertuples():
            assert zlib.crc32(np.array(ids[x.start : x.start + x.length], "<u4").tobytes()) == x.ids_crc32
    s = got.sort_values(["sequence_id", "offset"])
    assert (s.groupby("sequence_id").length.cumsum() == s.offset + s.length).all()
    assert s.groupby("sequence_id").length.sum().max() <= 1024
    assert packing.pack(empty).count() == 0


def test_special_token_text_and_odd_spacing():
    from tokenizers import Tokenizer

    ids = packing.Ids()
    tk = Tokenizer.from_file(ids.file)
    for t in ["a<|endoftext|>b", "  a  b ", "a\n b", "x \ny", "don't we'll", " a b", "a 　b", "", "é ß ñ 123 !!!"]:
        assert np.frombuffer(ids(t), "<u4").tolist() == tk.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize("seed", range(3))
def test_plan_places_each_length_once(seed):
    rng = np.random.RandomState(seed)
    h = rng.poisson(40, 1024) * (rng.rand(1024) < [1.0, 0.3, 0.02][seed])
    h[0] = 9
    segments, count = packing.plan(h)
    fill = np.zeros(count, int)
    seen = collections.Counter()
    for n, a, b, seq, off, m in segments:
        assert a == seen[n]
        seen[n] += b - a
        for g in range(b - a):
            fill[seq + g // m] += n
    assert all(seen[n] == h[n] for n in range(1, 1024))
    assert fill.max(initial=0) <= 1024
    if seed == 0:
        assert fill.sum() / (1024 * count) > 0.98


def test_warc_round_trip(spark):
    html = ["<p>a</p>", None, "", "<p>a</p>", "é" * 5000, "<p>a</p>", "x"]
    rows = [(10 - i, f"http://h/{i}\r\nX: y" if i else None, t, "x", 1) for i, t in enumerate(html)] + [(10, None, "<p>a</p>", "x", 1), (None, "u", "x", "x", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string, size int").repartition(3)
    got = collections.Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.round_trip(df).collect())
    least = {}
    for i, _, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    want = collections.Counter()
    for i, _, t, *_ in rows:
        b, first = (t or "").encode(), least[t or ""]
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == first else "revisit", None if i == first else first] += 1
    assert got == want
    assert warc.round_trip(df.filter("page_id < 0")).count() == 0


def test_archives_hold_a_dictionary(tmp_path):
    import io

    class Kept(io.BytesIO):
        def close(self):
            pass

    out = Kept()
    a = warc.Archive(out)
    for i in range(300):
        a.add(warc.record(i, f"http://x/{i}", (f"<html><body>common words {i} " * 20).encode(), False, None))
    a.close()
    raw = out.getvalue()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC and int.from_bytes(raw[4:8], "little") > 100
    assert [h["warc-record-id"] for h, _ in warc.read_archive(io.BytesIO(raw))] == [f"<urn:page:{i}>" for i in range(300)]


def test_line_crf_learns(spark, empty):
    rng = np.random.RandomState(4)
    words = ["".join(rng.choice(list("abcdefgh"), rng.randint(2, 8))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        lines = [" ".join(rng.choice(words, 12)) + "." for _ in range(rng.randint(1, 8))]
        if i % 3 == 0:
            lines = [x.upper().replace(" ", "!! ") if k % 2 else " ".join(w + " " + w for w in x.split()) for k, x in enumerate(lines)]
        rows.append((i, "\n".join(lines), "en", "s", None, 0, 0.0, 0, "", 0))
        labels.append((i, int(i % 3 != 0), 0))
    rows += [(900, None, None, None, None, 0, 0.0, 0, "", 0), (901, "\n\n", None, None, None, 0, 0.0, 0, "", 0), (902, "ab cd.\n" * 5000, None, None, None, 0, 0.0, 0, "", 0)]
    lab = spark.createDataFrame(labels + [(5, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = by_id(line_crf.classify(H.frame(spark, rows), lab))
    held = [i for i in range(240) if found[i].held_out]
    assert held and np.mean([found[i].predicted == (i % 3 != 0) for i in held]) > 0.9
    assert found[900].score == found[901].score == 0 and 0 <= found[902].score <= 1
    assert all(found[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in found)
    assert line_crf.classify(empty, lab).count() == 0
    none = line_crf.classify(H.frame(spark, rows[:3]), lab.filter("doc_id < 0"))
    assert [r.score for r in none.collect()] == [0.5] * 3


def test_forward_backward_matches_enumeration():
    rng = np.random.RandomState(6)
    scores, moves, row = rng.randn(7, 2), rng.randn(2, 2), np.array([0, 0, 0, 2, 3, 3, 3])
    p, pairs = line_crf.marginals(scores, moves, row)
    for doc in np.unique(row):
        at = np.flatnonzero(row == doc)
        total, want, both = 0.0, np.zeros((len(at), 2)), np.zeros((len(at), 2, 2))
        for code in range(2 ** len(at)):
            y = [(code >> k) & 1 for k in range(len(at))]
            w = np.exp(sum(scores[i, s] for i, s in zip(at, y)) + sum(moves[a, b] for a, b in zip(y, y[1:])))
            total += w
            for k, s in enumerate(y):
                want[k, s] += w
            for k, (a, b) in enumerate(zip(y, y[1:])):
                both[k, a, b] += w
        assert np.allclose(p[at], want / total) and np.allclose(pairs[at], both / total)


def test_near_copies_keep_one(spark, empty):
    rng = np.random.RandomState(9)
    words = ["".join(rng.choice(list("abcdefghij"), rng.randint(2, 8))) for _ in range(500)]
    rows, want = [], set()
    for i in range(60):
        t = list(rng.choice(words, 200))
        rows.append((10 * i, " ".join(t)))
        want.add(10 * i)
        if i % 3 == 0:
            rows.append((10 * i + 1, " ".join(t)))
            near = list(t)
            near[50] = "changed"
            near[120] = "twice"
            rows.append((10 * i + 2, " ".join(near)))
            far = list(t)
            far[::9] = ["other"] * len(far[::9])
            rows.append((10 * i + 3, " ".join(far)))
            want.add(10 * i + 3)
    rows += [(None, "x y z"), (None, "x y z"), (7001, ""), (7000, None)]
    want |= {None, 7000}
    df = H.frame(spark, [(i, t, None, None, None, 1, 0.0, 1, "k", 2) for i, t in rows]).repartition(3)
    kept = near_copies.keep_one(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) == want and len(ids) == len(want) + 1
    assert near_copies.keep_one(empty).count() == 0


def _near_groups(texts):
    sets = [set(zip(*(t.split()[k:] for k in range(5)))) for t in texts]
    return H.groups(len(texts), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))


def test_near_copies_find_each_pair_near_the_threshold(spark):
    rng = np.random.RandomState(10)
    texts = []
    for i in range(400):
        t = [f"w{k}" for k in rng.randint(0, 10**6, 104)]
        near = list(t)
        for at in (20, 50)[: 1 + i % 2]:  # 100 shingles of which 5 or 10 differ: 0.905 or 0.818
            near[at] = f"other{i}"
        texts += [" ".join(t), " ".join(near)]
    docs = H.frame(spark, [(i, t, None, None, None, 1, 0.0, 1, "k", 2) for i, t in enumerate(texts)]).repartition(3)
    got = by_id(near_copies.groups(docs))
    assert [got[i].group_id for i in range(len(texts))] == [i - i % 2 for i in range(len(texts))]


def test_near_copies_in_a_dense_family_are_exact(spark, monkeypatch):
    monkeypatch.setattr(near_copies, "BLOCK", 40, raising=False)  # shards of several blocks
    rng = np.random.RandomState(11)
    base = [f"w{k}" for k in range(104)]
    texts = []
    for i in range(150):  # templated pages: all alike, and near copies only now and then
        t = list(base)
        for at in rng.choice(104, rng.randint(1, 5), replace=False):
            t[at] = f"v{rng.randint(0, 10**6)}"
        texts.append(" ".join(t))
    docs = H.frame(spark, [(i, t, None, None, None, 1, 0.0, 1, "k", 2) for i, t in enumerate(texts)]).repartition(3)
    want = _near_groups(texts)
    assert 1 < len(set(want)) < 140
    got = by_id(near_copies.groups(docs))
    assert [got[i].group_id for i in range(len(texts))] == want


@pytest.mark.parametrize("hot", [False, True])
def test_kneser_ney_of_three_words_matches_brute_force(docs, data, monkeypatch, hot):
    monkeypatch.setattr(ngram_model, "SHARD_BYTES", 5_000)  # several shards and tasks
    monkeypatch.setattr(ngram_model, "TASK_BYTES", 5_000)
    monkeypatch.setattr(ngram_model, "HOT_SHARE", 500 if hot else 1)  # words of ten occurrences and more are split, or none
    found_hot, find_hot = [], ngram_model.hot_words
    monkeypatch.setattr(ngram_model, "hot_words", lambda *x: found_hot.append(find_hot(*x)) or found_hot[-1])
    tokens = [(i, H.WORD.findall(H.lower(t)) + ["\n"]) for i, t, *_ in data]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in tokens}
    one, three = collections.Counter(), collections.Counter()
    grams = lambda t: zip(["\t", "\t"] + t, ["\t"] + t, t)
    for i, t in tokens:
        if not held[i]:
            one.update(t)
            three.update(grams(t))
    two = collections.Counter((v, w) for _, v, w in three)
    before = collections.Counter(w for _, w in two)
    n, v = sum(one.values()), len(one)

    def level(counts):
        d = ngram_model.discounts(*(sum(1 for c in counts.values() if c == k) for k in (1, 2, 3, 4)))
        total, kinds = collections.Counter(), collections.Counter()
        for (*a, _), c in counts.items():
            total[tuple(a)] += c
            kinds[tuple(a), min(c, 3)] += 1
        return lambda a, w, low: low if not total[a] else (counts[(*a, w)] - d[min(counts[(*a, w)], 3)] + sum(d[k] * kinds[a, k] for k in (1, 2, 3)) * low) / total[a]

    d1 = ngram_model.discounts(*(sum(1 for c in before.values() if c == k) for k in (1, 2, 3, 4)))
    rest = sum(d1[min(c, 3)] for c in before.values()) / len(two)
    p3, p2 = level(three), level(two)

    def p(u, a, w):
        return p3((u, a), w, p2((a,), w, (before[w] - d1[min(before[w], 3)]) / len(two) + rest / (v + 1)))

    found = by_id(ngram_model.score_corpus(docs, order=3))
    assert (len(found_hot[0]) > 1) == hot
    pairs = by_id(ngram_model.score_corpus(docs))
    for i, t in tokens:
        r = found[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (len(t), pairs[i].n_known, n, pytest.approx(pairs[i].base_score))
        assert r.score == pytest.approx(sum(np.log10(p(*g)) for g in grams(t)))
    u, a, _ = max(three, key=three.get)
    assert sum(p(u, a, w) for w in one) + p(u, a, "unseen") == pytest.approx(1.0)


def test_coded_rows_come_back():
    rng = np.random.RandomState(5)
    values = [np.concatenate([rng.geometric(0.01, 5_000), [1 << 40, 0, 70_000]]) for _ in range(4)]
    for some in (values[:1], values, [v[:0] for v in values]):
        coded = ngram_model.code_rows(*some)
        at = rng.permutation(len(some[0]))
        assert (ngram_model.decode_rows(*(coded[k] for k in ("code", "rows", "places", "others")), at) == np.stack(some, 1)[at]).all()


def test_blobs_of_triples_do_not_grow_with_the_shards():
    rng = np.random.RandomState(5)
    u, a, w = (np.minimum(rng.zipf(1.2, 200_000), 5_000_000) for _ in range(3))
    size = {}
    for shards in (4, 64):
        blobs = dict(ngram_model._blobs([u, a, w], np.ones(len(u), np.int64), shards, np.zeros(0, np.int64)))
        size[shards] = sum(map(len, blobs.values()))
        back = [ngram_model.unpack_grams(b, 3) for b in blobs.values()]
        got = np.concatenate([np.stack(c, 1) for c, _ in back])
        assert sorted(map(tuple, got.tolist())) == sorted(zip(u.tolist(), a.tolist(), w.tolist()))
    assert size[64] < 1.2 * size[4]


@pytest.mark.parametrize("shards", [1, 7])
def test_words_are_numbered_by_count(docs, tmp_path, shards):
    text = docs.select("text")
    found = ngram_model.number_words(text, f"file://{tmp_path}", shards)
    counts = collections.Counter(w for r in text.collect() for w in H.WORD.findall(H.lower(r.text)) + ["\n"])
    words = ngram_model.Vocabulary(f"file://{tmp_path}", shards, found)
    assert (words.size, words.tokens) == (len(counts), sum(counts.values()))
    raw = "a A unseen-word b".encode()
    out = ngram_model.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))[0]
    number, n = words.numbers(out, counted=True)
    assert n.tolist() == [counts["a"], counts["a"], 0, counts["b"], counts["\n"]] and number[2] == ngram_model.UNKNOWN and number[0] == number[1]
    every = np.concatenate([np.load(f"{r.path}/rank.npy").astype(np.int64) * shards + r.shard for r in found])
    assert len(set(every.tolist())) == len(counts) + 1  # the start has a number too
