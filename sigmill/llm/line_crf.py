"""Quality classifier: a linear-chain conditional random field over a document's lines.

Each line with a word is good or bad. Its features are its own shape (length, capitals, punctuation, symbols, digits,
repeated words, repeated line) and that of the lines before and after. Forward-backward gives each line's marginal
probability of being good; the mean of the marginals weighted by the lines' lengths is the document's quality, which a
fitted slope and intercept turn into the probability of label 1.

The field is fitted on a bounded sample of labelled documents (`most` of them, the first by a hash of doc_id), whose
lines all take the document's label. Scoring is one pass over the texts.

Edge cases: null, empty or wordless text has no line and scores 0; labels are the smallest of a doc_id's labels, null
labels are left out; with no usable label every text scores 0.5; repeated rows are scored each; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import STARTS_CHAR, Words, chunks, mix, prefix_hash, span_hash, texts_of

OWN = 11
NEAR = 6  # of these, the first ones behind length are also taken from the neighbouring lines
FEATURES = OWN + 2 * NEAR

_codes = np.arange(256)
_UPPER = (_codes >= 65) & (_codes <= 90)
_DIGIT = (_codes >= 48) & (_codes <= 57)
_STOP = np.isin(_codes, [ord(c) for c in ".,;:'\"-!?()"])
_SYMBOL = (_codes > 32) & (_codes < 127) & ~_UPPER & ~_DIGIT & ~((_codes >= 97) & (_codes <= 122)) & ~_STOP


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features, weight (characters in words) and row of each line with a word."""
    w = Words(raw, offsets)
    prefix = prefix_hash(raw)
    feeds = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([offsets[:-1], feeds + 1]))
    row = np.sort(np.concatenate([np.arange(w.rows), np.searchsorted(offsets, feeds, side="right") - 1]))
    end = np.empty_like(begin)
    end[:-1] = begin[1:] - 1
    last = np.flatnonzero(np.diff(row, append=w.rows))
    end[last] = offsets[1:]

    def total(mask: np.ndarray) -> np.ndarray:
        t = np.zeros(len(raw) + 1, np.int64)
        np.cumsum(mask, out=t[1:])
        return t[end] - t[begin]

    chars = total(w.inside & STARTS_CHAR[raw])
    full = chars > 0
    begin, end, row, chars = begin[full], end[full], row[full], chars[full].astype(float)
    n = len(begin)
    x = np.zeros((n, FEATURES), np.float32)
    if not n:
        return x, chars, row
    hashes = span_hash(prefix, w.begin, w.end)
    line = np.searchsorted(begin, w.begin, side="right") - 1
    words = np.bincount(line, minlength=n).astype(float)

    def repeats(lag: int) -> np.ndarray:
        if len(hashes) <= lag:
            return np.zeros(n)
        again = (hashes[lag:] == hashes[:-lag]) & (line[lag:] == line[:-lag])
        return np.bincount(line[lag:][again], minlength=n) / words

    key = mix(span_hash(prefix, begin, end) + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(key, return_index=True)
    again = np.ones(n)
    again[first] = 0
    x[:, 0] = 1
    x[:, 1] = np.log1p(words) / 3
    x[:, 2] = total(_UPPER[raw]) / chars
    x[:, 3] = np.sqrt(total(_STOP[raw]) / chars)
    x[:, 4] = np.sqrt(total(_SYMBOL[raw]) / chars)
    x[:, 5] = repeats(1)
    x[:, 6] = repeats(2)
    x[:, 7] = total(_DIGIT[raw]) / chars
    x[:, 8] = np.log(chars / words)
    x[:, 9] = again
    x[:, 10] = total((raw > 127) & STARTS_CHAR[raw]) / chars
    same = row[1:] == row[:-1]
    own = x[:, 1 : 1 + NEAR]
    x[1:, OWN : OWN + NEAR] = own[:-1] * same[:, None]
    x[:-1, OWN + NEAR :] = own[1:] * same[:, None]
    return x, chars, row


def _steps(row: np.ndarray) -> list[np.ndarray]:
    """For each place in a document, the lines that stand there; line i + 1 follows line i of a document."""
    begin = np.flatnonzero(np.diff(row, prepend=-1))
    sizes = np.diff(begin, append=len(row))
    order = np.argsort(-sizes, kind="stable")
    begin, sizes = begin[order], sizes[order]
    return [begin[: np.searchsorted(-sizes, -t, side="left")] + t for t in range(int(sizes[0]) if len(sizes) else 0)]


def marginals(scores: np.ndarray, moves: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state) of each line and P(state, next state) of each line that has a next one (zero elsewhere).
    scores: lines x 2, moves: 2 x 2, both logarithms."""
    steps = _steps(row)
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    move = np.exp(moves - moves.max())
    ahead = np.empty_like(local)
    behind = np.ones_like(local)
    pairs = np.zeros((len(local), 2, 2))
    for t, at in enumerate(steps):
        a = local[at] if not t else local[at] * (ahead[at - 1] @ move)
        ahead[at] = a / a.sum(axis=1, keepdims=True)
    for at in reversed(steps[1:]):
        follow = local[at] * behind[at]
        b = follow @ move.T
        behind[at - 1] = b / b.sum(axis=1, keepdims=True)
        p = ahead[at - 1][:, :, None] * move[None] * follow[:, None, :]
        pairs[at - 1] = p / p.sum(axis=(1, 2), keepdims=True)
    p = ahead * behind
    return p / p.sum(axis=1, keepdims=True), pairs


def fit(x: np.ndarray, row: np.ndarray, good: np.ndarray, rounds: int = 150, penalty: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (features x 2) and transition scores (2 x 2) of largest penalised likelihood. good: of each line."""
    weights, moves = np.zeros((FEATURES, 2)), np.zeros((2, 2))
    target = np.stack([1 - good, good], axis=1).astype(float)
    next_same = np.append(row[1:] == row[:-1], False)
    inner = np.zeros((2, 2))
    inner[0, 0], inner[1, 1] = (next_same & (good == 0)).sum(), (next_same & (good == 1)).sum()
    docs = len(np.unique(row))
    mean = [np.zeros_like(weights), np.zeros_like(moves)]
    square = [np.zeros_like(weights), np.zeros_like(moves)]
    for k in range(1, rounds + 1):
        p, pairs = marginals(x @ weights, moves, row)
        grads = [x.T @ (target - p) / docs - penalty * weights, (inner - pairs.sum(axis=0)) / docs - penalty * moves]
        for i, (value, g) in enumerate(zip((weights, moves), grads)):
            mean[i] = 0.9 * mean[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            value += 0.1 * (mean[i] / (1 - 0.9**k)) / (np.sqrt(square[i] / (1 - 0.99**k)) + 1e-8)
    return weights, moves


def document_quality(p_good: np.ndarray, weight: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Mean marginal of each row's lines, weighted by their lengths; 0 for rows without a line."""
    return np.bincount(row, weight * p_good, rows) / np.maximum(np.bincount(row, weight, rows), 1)


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def calibrate(quality: np.ndarray, good: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Slope and intercept that turn a document's quality into the probability of label 1 (Newton steps, slope >= 0)."""
    z = np.stack([_logit(quality), np.ones(len(quality))], axis=1)
    line = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ line, -40, 40)))
        slope = z.T @ (good - p) - 1e-2 * (line - [1.0, 0.0])
        curve = (z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2)
        line = line + np.clip(np.linalg.solve(curve, slope), -1, 1)
    return np.array([max(line[0], 0.0), line[1]])


def is_held_out(doc_id, modulus: int, remainder: int):
    """crc32 of doc_id as text has this remainder; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, most: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """Fits on the texts of at most `most` labelled rows, the first by a hash of doc_id."""
    chosen = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x, weight, row = line_features(*texts_of(b.column("text")))
            x = np.concatenate([x, weight[:, None]], axis=1).astype(np.float32)
            ends = np.searchsorted(row, np.arange(b.num_rows + 1))
            blobs = [x[i:j].tobytes() for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(blobs, pa.binary())], names=["doc_id", "quality", "x"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = texts.select("doc_id", "quality", "text").mapInArrow(run, "doc_id long, quality int, x binary").filter("length(x) > 0")
    rows = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "x")).alias("r")).orderBy("doc_id").select("r.*").collect()
    if not rows:
        return None
    parts = [np.frombuffer(r.x, np.float32).reshape(-1, FEATURES + 1) for r in rows]
    row = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    good = np.array([r.quality for r in rows])
    x = np.concatenate(parts).astype(float)
    x, weight = x[:, :FEATURES], x[:, FEATURES]
    weights, moves = fit(x, row, good[row])
    p, _ = marginals(x @ weights, moves, row)
    return weights, moves, calibrate(document_quality(p[:, 1], weight, row, len(good)), good)


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray] | None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns of keep, and score. One pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            x, weight, row = line_features(*texts_of(b.column("text")))
            out = np.zeros(b.num_rows)
            if model is None:
                out[:] = 0.5
            elif len(row):
                p, _ = marginals(x.astype(float) @ model[0], model[1], row)
                quality = document_quality(p[:, 1], weight, row, b.num_rows)
                out = 1 / (1 + np.exp(-np.clip(_logit(quality) * model[2][0] + model[2][1], -40, 40)))
                out[np.bincount(row, minlength=b.num_rows) == 0] = 0.0
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(np.clip(out, 0.0, 1.0))], names=[*keep, "score"])

    text = F.col("text").cast("string").alias("text")
    fields = [f for f in docs.schema.fields if f.name in keep]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    keep = tuple(f.name for f in fields)
    return docs.select(*(c for c in keep if c != "text"), text).mapInArrow(run, schema)


#: A document is predicted good from this score on.
THRESHOLD = 0.3


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, most: int = 4000) -> DataFrame:
    """doc_id, held_out, score, predicted; learns from labels of documents that are not held out."""
    model = train(docs, labels.filter(~is_held_out("doc_id", 5, 0)), most)
    scored = score(docs.withColumn("doc_id", F.col("doc_id").cast("long")), model)
    return scored.select("doc_id", is_held_out("doc_id", 5, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
