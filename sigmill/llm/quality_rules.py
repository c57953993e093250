"""Quality rules with robust multivariate outliers (minimum covariance determinant).

Every document gets length, symbol and repetition counts, which become a vector of transformed statistics:

* the logarithm of its words, and its mean word length against the group's median in units of that mean's own error;
* Freeman-Tukey roots (sqrt(k) + sqrt(k + 1), whose error is about one for any count) of symbols, repeated lines and
  repeated windows, as counts in a text of up to a thousand words.

For each (language, source) group the share `share` of documents whose covariance has the least determinant is searched
for from several starts: the moments of all documents, and of random subsets. C-steps (the share of nearest documents
gives the next mean and covariance; of the bin at the edge of the share a part counts, so that the share never changes) go
on from the start with the least determinant. A group goes on as long as its determinant falls and keeps its best
estimate; groups that have settled are not read again, and no number of steps ends the others. The result is made
consistent for normal data, and a document whose squared Mahalanobis distance lies above the chi-squared quantile `level`
is rejected. A statistic that most documents share exactly has no variance; so that no distance is infinite, every
covariance gets the variance of the statistics' own rounding and counting error (ERROR), and the degrees of freedom of the
quantile count only what variance there is besides.

A C-step is one aggregation over (group, distance bin): the bins hold counts and moments, so a group that holds a third
of all rows is combined map-side and no task or driver ever holds a group's documents.

Edge cases: null or wordless text has zero counts and fails the base rules; null lang or source form their own groups;
groups of fewer than `min_group` documents that pass the base rules are pooled by language, then over all languages, and a
pool that is still smaller rejects nothing; repeated rows count as often as they occur; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import exp, lgamma, log

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialize
from .textops import STARTS_CHAR, Words, chunks, mix, prefix_hash, row_sums, span_hash, texts_of, window_hash

SYMBOLS = "#*$%&|<>"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")

_is_symbol = np.zeros(256, bool)
_is_symbol[[ord(c) for c in SYMBOLS]] = True


def count_rows(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The five counts of each text of a slice."""
    w = Words(raw, offsets)
    rows = w.rows
    prefix = prefix_hash(raw)
    out = {
        "n_words": w.count,
        "word_chars": row_sums(w.inside & STARTS_CHAR[raw], offsets),
        "n_symbols": row_sums(_is_symbol[raw], offsets),
    }
    # lines: from a row's start or behind a line feed to the next one or the row's end
    feeds = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    feed_row = np.searchsorted(offsets, feeds, side="right") - 1
    row = np.sort(np.concatenate([np.arange(rows), feed_row]))
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    last = np.flatnonzero(np.diff(row, append=rows))
    end[last] = offsets[1:]
    filled = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(w.inside, out=filled[1:])
    full = filled[end] > filled[begin]
    begin, end, row = begin[full], end[full], row[full]
    key = mix(span_hash(prefix, begin, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    out["n_dup_lines"] = np.bincount(row, minlength=rows) - np.bincount(row[first], minlength=rows)
    # windows of words
    covered = np.zeros(len(w.begin) + 1, np.int64)
    if len(w.begin) >= WINDOW:
        h = window_hash(span_hash(prefix, w.begin, w.end), WINDOW)
        at = np.flatnonzero(w.row[: len(h)] == w.row[WINDOW - 1 :])
        key = mix(h[at] + w.row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key)
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        np.add.at(covered, at[twice], 1)
        np.add.at(covered, at[twice] + WINDOW, -1)
    inside = np.cumsum(covered[:-1]) > 0
    out["n_repeat_words"] = np.bincount(w.row[inside], minlength=rows)
    return out


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five counts, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            found = count_rows(*texts_of(b.column("text")))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("lang"), b.column("source"), *(pa.array(found[c].astype(np.int64)) for c in COUNTS)],
                names=["doc_id", "lang", "source", *COUNTS],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in COUNTS))


_ROOT = "sqrt({0}) + sqrt({0} + 1)"
_RATE = "{0} / (1 + n_words / 1000)"
#: Transformed statistics, and the variance of each one's own error.
FEATURES = {
    "x0": ("ln(1 + n_words)", 0.01),
    "x1": ("(word_length - median_length) / sqrt(1 / greatest(n_words, 1) + 0.005)", 0.01),
    "x2": (_ROOT.format(_RATE.format("n_symbols")), 1.0),
    "x3": (_ROOT.format(_RATE.format("n_dup_lines")), 1.0),
    "x4": (_ROOT.format(_RATE.format(f"n_repeat_words / {WINDOW}")), 1.0),
}
_X = list(FEATURES)
ERROR = np.diag([v for _, v in FEATURES.values()])
_PAIRS = [(i, j) for i in range(len(_X)) for j in range(i, len(_X))]
_BIN = 24.0  # bins for each unit of ln(1 + d2)
SUBSET = 24  # documents of a random start, about
SETTLED = 1e-3  # a log-determinant that falls by no more has settled
_PARAMS = "g_lang string, g_source string, start int, g_n long, log_det double, cutoff double, " + ", ".join(
    [*(f"m{i} double" for i in range(len(_X))), *(f"v{i}_{j} double" for i, j in _PAIRS)]
)


def chi2_cdf(x: float, k: float) -> float:
    """Chi-squared distribution with k degrees of freedom, by the series of the incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= x / n
        total += term
    return min(total * exp(a * log(x) - x - lgamma(a)), 1.0)


def chi2_quantile(q: float, k: float) -> float:
    low, high = 0.0, 10.0
    while chi2_cdf(high, k) < q:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, k) < q else (low, middle)
    return high


def _estimate(rows: pd.DataFrame, share: float) -> pd.DataFrame:
    """Mean and inverse covariance of the nearest share of a group; the last bin counts with the part that fills it."""
    rows = rows.sort_values("bin")
    held = rows["n"].to_numpy(float)
    n = held.sum()
    weight = np.clip((share * n - (held.cumsum() - held)) / held, 0, 1)
    m = weight @ held
    p = len(_X)
    mean = np.array([weight @ rows[f"s{i}"].to_numpy() / m for i in range(p)])
    cov = np.zeros((p, p))
    for i, j in _PAIRS:
        cov[i, j] = cov[j, i] = weight @ rows[f"s{i}_{j}"].to_numpy() / m - mean[i] * mean[j]
    keys = {k: rows[k].iloc[:1].to_list() for k in ("g_lang", "g_source", "start")}
    return pd.DataFrame(keys | {"g_n": [int(n)]} | _columns(mean, cov, 0.0))


def _columns(mean: np.ndarray, cov: np.ndarray, cutoff: float) -> dict[str, list]:
    inverse = np.linalg.inv(cov + ERROR)
    out = {"log_det": [float(np.linalg.slogdet(cov + ERROR)[1])], "cutoff": [cutoff]}
    return out | {f"m{i}": [float(v)] for i, v in enumerate(mean)} | {f"v{i}_{j}": [float(inverse[i, j])] for i, j in _PAIRS}


def _step(binned: DataFrame, share: float) -> DataFrame:
    """Parameters of each group and start, from rows with a bin."""
    sums = binned.groupBy("g_lang", "g_source", "start", "bin").agg(
        F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(f"s{i}") for i, c in enumerate(_X)),
        *(F.sum(F.col(_X[i]) * F.col(_X[j])).alias(f"s{i}_{j}") for i, j in _PAIRS),
    )
    return sums.groupBy("g_lang", "g_source", "start").applyInPandas(lambda rows: _estimate(rows, share), _PARAMS)


def _consistent(params: DataFrame, share: float, level: float) -> DataFrame:
    """Each group's covariance made consistent for normal data, and its cutoff."""

    def one(row: pd.Series) -> pd.DataFrame:
        inverse = np.zeros((len(_X), len(_X)))
        for i, j in _PAIRS:
            inverse[i, j] = inverse[j, i] = row[f"v{i}_{j}"]
        cov = np.linalg.inv(inverse) - ERROR
        free = max(float(np.trace(cov @ inverse)), 1.0)
        held = min(share, 0.9999)
        # the mean of squared distances within the nearest share of a normal cloud is less than all of its mean
        cov *= held / chi2_cdf(chi2_quantile(held, free), free + 2)
        found = _columns(np.array([row[f"m{i}"] for i in range(len(_X))]), cov, chi2_quantile(level, free))
        return pd.DataFrame(found | {k: [row[k]] for k in ("g_lang", "g_source", "start", "g_n", "log_det")})[list(row.index)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield from (one(row) for _, row in b.iterrows())

    return params.mapInPandas(run, _PARAMS)


def _grouped(stats: DataFrame, min_group: int) -> DataFrame:
    """Adds g_lang, g_source: the group, or the pool of a small one, by what passed the base rules."""
    sizes = stats.groupBy("lang", "source").agg(F.count_if(~F.col("base_failed")).alias("g0"))
    sizes = sizes.withColumn("p_source", F.when(F.col("g0") < min_group, F.lit("(small)")).otherwise(F.concat(F.lit("="), F.coalesce("source", F.lit("(null)")))))
    sizes = sizes.withColumn("p_lang", F.concat(F.lit("="), F.coalesce("lang", F.lit("(null)"))))
    pooled = sizes.groupBy("p_lang", "p_source").agg(F.sum("g0").alias("g1"))
    sizes = sizes.join(pooled, ["p_lang", "p_source"]).select(
        F.col("lang").alias("k_lang"), F.col("source").alias("k_source"),
        F.when(F.col("g1") < min_group, F.lit("(small)")).otherwise(F.col("p_lang")).alias("g_lang"),
        F.when(F.col("g1") < min_group, F.lit("(small)")).otherwise(F.col("p_source")).alias("g_source"),
    )
    return stats.join(sizes, F.col("lang").eqNullSafe(F.col("k_lang")) & F.col("source").eqNullSafe(F.col("k_source")), "left").drop("k_lang", "k_source")


def mcd(stats: DataFrame, starts: int = 5, share: float = 0.75, level: float = 0.999999, min_group: int = 50) -> tuple[DataFrame, DataFrame]:
    """The rows with their group (g_lang, g_source) and transformed statistics, and each group's parameters."""
    keys = ["g_lang", "g_source"]
    x = _grouped(stats, min_group).withColumn("word_length", F.expr("ln(greatest(word_chars, 1) / greatest(n_words, 1))"))
    x = materialize(x, "quality-groups")
    middle = x.filter("not base_failed").groupBy(*keys).agg(F.expr("percentile(round(word_length, 3), 0.5)").alias("median_length"), F.count(F.lit(1)).alias("all"))
    x = x.join(middle, keys, "left").withColumns({k: F.expr(e) for k, (e, _) in FEATURES.items()})
    every = F.greatest(F.floor(F.col("all") / SUBSET), F.lit(1)).cast("long")
    begins = F.array(*(F.when(F.lit(s) == 0, F.lit(True)).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(s)), every) == 0) for s in range(starts)))
    x = materialize(x.withColumn("begins", begins).drop("word_length", "median_length", "all"), "quality-stats")
    good = x.filter("not base_failed")
    begun = good.withColumn("start", F.explode(F.filter(F.sequence(F.lit(0), F.lit(starts - 1)), lambda s: F.element_at("begins", s + 1))))
    params = materialize(_step(begun.withColumn("bin", F.lit(0)), share), "quality-mcd")
    for _ in range(2):
        params = materialize(_step(_binned(good, params), share), "quality-mcd")
    best = params.groupBy(*keys).agg(_least(params, "start")).select(*keys, "p.*", F.lit(True).alias("falls"))
    best = materialize(best, "quality-mcd")
    while not best.filter("falls").isEmpty():
        best = materialize(_better(best, _step(_binned(good, best.filter("falls")), share)), "quality-mcd")
    return x, materialize(_consistent(best.drop("falls"), share, level), "quality-mcd")


def _least(params: DataFrame, *ties: str) -> Column:
    return F.min_by(F.struct(*(c for c in params.columns if c not in ("g_lang", "g_source", "falls"))), F.struct("log_det", *ties)).alias("p")


def _better(best: DataFrame, stepped: DataFrame) -> DataFrame:
    """The estimate of the lesser determinant of each group, and whether it still falls."""
    keys = ["g_lang", "g_source"]
    falls = F.col("was") - F.col("log_det") > SETTLED
    stepped = stepped.join(best.select(*keys, F.col("log_det").alias("was")), keys).withColumn("falls", falls).drop("was")
    both = best.withColumn("falls", F.lit(False)).unionByName(stepped)
    return both.groupBy(*keys).agg(_least(best), F.max("falls").alias("falls")).select(*keys, "p.*", "falls")


def _distance() -> Column:
    d = {i: F.col(_X[i]) - F.col(f"m{i}") for i in range(len(_X))}
    return F.greatest(sum((d[i] * d[j] * F.col(f"v{i}_{j}") * (1 if i == j else 2) for i, j in _PAIRS), F.lit(0.0)), F.lit(0.0))


def _binned(x: DataFrame, params: DataFrame) -> DataFrame:
    joined = x.join(params, ["g_lang", "g_source"])
    return joined.select("g_lang", "g_source", "start", *_X, F.floor(F.log1p(_distance()) * _BIN).cast("int").alias("bin"))


def judge(docs: DataFrame, starts: int = 5, share: float = 0.75, level: float = 0.999999, min_group: int = 50) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the robust distance d2 and the group's cutoff (null where no group is large
    enough)."""
    base = counts(docs).withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    base = materialize(base, "quality-counts")  # one pass over the texts
    x, params = mcd(base, starts, share, level, min_group)
    x = x.join(params.filter(F.col("g_n") >= min_group), ["g_lang", "g_source"], "left")
    d2 = F.when(F.col("cutoff").isNotNull(), _distance())
    return x.select("doc_id", *COUNTS, "base_failed", (~F.col("base_failed") & ~F.coalesce(d2 > F.col("cutoff"), F.lit(False))).alias("kept"), d2.alias("d2"), "cutoff")
