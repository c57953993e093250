"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary (and for every byte, so that any text has
a segmentation). The probability of a word is the sum over all its segmentations into pieces, found by the forward
algorithm; a text's is the product over its words. The forward pass runs once for each different word of a slice, over
all words and languages at the same time; words of more than LONG bytes, which are few, come one by one, with sums that
are rescaled as they grow, so that a word of any length is scored by all its segmentations.

Piece probabilities are fitted by expectation-maximisation on a bounded sample of labelled training texts (the first
`most` of each language by a hash of doc_id) and their words of up to LONG bytes.

Edge cases: null text or text without a letter is `und` with score 0; without training texts every text is `und`; null
lang is not learned; rows that repeat a doc_id count once in the sample and are scored each; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .line_crf import is_held_out
from .pieces import vocabulary
from .textops import LOWER, Words, chunks, powers, prefix_hash, span_hash, texts_of

SLICE_BYTES = 2 << 20
LONG = 40  # bytes with the space; shorter words' sums need no rescaling
UND = "und"
_SCALE = np.log(24.0)  # about the inverse probability of a byte: keeps forward sums near 1


class Pieces:
    """Bytes of the vocabulary's pieces (a word start is a space; ASCII letters in lower case), found by hash."""

    def __init__(self, path: str | None = None):
        v = vocabulary(path)
        texts = sorted({bytes(LOWER[np.frombuffer(b, np.uint8)]) for b in v.bytes if b} | {bytes([b]) for b in range(256)})
        self.count, self.lengths = len(texts), sorted({len(t) for t in texts})
        joined = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.array([len(t) for t in texts])
        ends = np.cumsum(sizes)
        h = span_hash(prefix_hash(joined), ends - sizes, ends)
        order = np.argsort(h)
        self.hashes, self.ids, self.sizes = h[order], order, sizes
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def lattice(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """For each end position: (length, words, pieces) of the pieces that end there. Words must come with falling size."""
        prefix = prefix_hash(words)
        out: list = [[]]
        for end in range(1, int(size[0]) + 1 if len(size) else 1):
            n = int(np.searchsorted(-size, -end, side="right"))
            here = []
            for length in self.lengths:
                if length > end:
                    break
                b = begin[:n] + (end - length)
                h = span_hash(prefix, b, b + length)
                w = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
                if not len(w):
                    continue
                at = np.minimum(np.searchsorted(self.hashes, h[w]), self.count - 1)
                hit = self.hashes[at] == h[w]
                if hit.any():
                    here.append((length, w[hit], self.ids[at[hit]]))
            out.append(here)
        return out


    def ends(self, word: np.ndarray) -> Iterator[list[tuple[int, int]]]:
        """For each end position of one word: (length, piece) of the pieces that end there."""
        prefix = prefix_hash(word)
        found = []
        for length in self.lengths:
            if length > len(word):
                break
            b = np.arange(len(word) - length + 1)
            h = span_hash(prefix, b, b + length)
            w = np.flatnonzero(self.maybe[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[w]), self.count - 1)
            hit = self.hashes[at] == h[w]
            found.append(np.stack([w[hit] + length, np.full(hit.sum(), length), self.ids[at[hit]]]))
        end, length, piece = np.concatenate(found, axis=1)
        order = np.argsort(end, kind="stable")
        upto = np.searchsorted(end[order], np.arange(1, len(word) + 2))
        length, piece = length[order].tolist(), piece[order].tolist()
        for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
            yield list(zip(length[a:b], piece[a:b]))


def forward_long(pieces: Pieces, word: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Log-probability of one word in each language, by a window of forward sums that is rescaled at each end position.
    p: pieces x languages, scaled by exp(_SCALE) a byte."""
    width = pieces.lengths[-1]
    alpha = np.zeros((width, p.shape[1]))
    alpha[0] = 1  # of end position e, in row e % width
    log_scale = np.zeros(p.shape[1])
    for end, here in enumerate(pieces.ends(word), 1):
        now = sum((alpha[(end - length) % width] * p[piece] for length, piece in here), np.zeros(p.shape[1]))
        alpha[end % width] = now
        if end % 8 == 0:
            top = np.maximum(alpha.max(axis=0), 1e-300)
            alpha /= top
            log_scale += np.log(top)
    return np.log(alpha[len(word) % width]) + log_scale - _SCALE * len(word)


def forward(lattice: list, n: int, p: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward sums (end, word, language), scaled by exp(_SCALE) a byte, and the log-probability of each word.
    p: pieces x languages, already scaled."""
    alpha = np.zeros((len(lattice), n, p.shape[1]))
    alpha[0] = 1
    for end, here in enumerate(lattice):
        for length, w, ids in here:
            alpha[end, w] += alpha[end - length, w] * p[ids]
    return alpha, np.log(alpha[size, np.arange(n)]) - _SCALE * size[:, None]


def distinct_words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of the different words (a space, then the word in lower case), begin and size of each with falling size,
    which of them each word is, and the row of each word."""
    raw = LOWER[raw]
    w = Words(raw, offsets)
    begin, end, row = w.begin, w.end, w.row
    _, at, back = np.unique(span_hash(prefix_hash(raw), begin, end), return_index=True, return_inverse=True)
    size = end[at] - begin[at]
    order = np.argsort(-size, kind="stable")
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    begin, size = begin[at][order], size[order]
    out = np.full(int((size + 1).sum()), 0x20, np.uint8)
    to = np.cumsum(size + 1) - size - 1
    inner = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to + 1, size) + inner] = raw[np.repeat(begin, size) + inner]
    return out, to, size + 1, place[back], row


class Model:
    def __init__(self, langs: list[str], log_p: np.ndarray, prior: np.ndarray, path: str | None):
        self.langs, self.log_p, self.prior, self.path = langs, log_p, prior, path

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "pieces"}

    def word_scores(self, words: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        if not hasattr(self, "pieces"):
            self.pieces = Pieces(self.path)
            self.p = np.exp(self.log_p + _SCALE * self.pieces.sizes[:, None])
        out = np.zeros((len(begin), len(self.langs)))
        long = int(np.searchsorted(-size, -LONG, side="left"))
        for k in range(long):
            out[k] = forward_long(self.pieces, words[begin[k] : begin[k] + size[k]], self.p)
        for a in range(long, len(begin), 20_000):
            b, s = begin[a : a + 20_000], size[a : a + 20_000]
            out[a : a + 20_000] = forward(self.pieces.lattice(words, b, s), len(b), self.p, s)[1]
        return out


def fit(texts: dict[str, list[str]], rounds: int = 4, path: str | None = None) -> Model | None:
    """Expectation-maximisation over the words of each language's texts. Probabilities never fall below a floor."""
    langs = sorted(texts)
    if not langs:
        return None
    pieces = Pieces(path)
    log_p = []
    for lang in langs:
        joined = "\n".join(texts[lang]).encode()
        raw = np.frombuffer(joined, np.uint8)
        powers(len(raw) + 1)
        words, begin, size, which, _ = distinct_words(raw, np.array([0, len(raw)]))
        count = np.bincount(which, minlength=len(begin)).astype(float)
        long = int(np.searchsorted(-size, -LONG, side="left"))
        begin, size, count = begin[long:], size[long:], count[long:]
        p = np.full(pieces.count, 1.0 / pieces.count)
        # words of at most 15,000 at a time, so that the lattices stay small
        parts = [(slice(a, a + 15_000), pieces.lattice(words, begin[a : a + 15_000], size[a : a + 15_000])) for a in range(0, len(begin), 15_000)]
        scale = np.exp(_SCALE * pieces.sizes)
        for _ in range(rounds):
            expected = np.full(pieces.count, 0.01)
            for part, lattice in parts:
                s, n = size[part], len(size[part])
                q = (p * scale)[:, None]
                alpha, _ = forward(lattice, n, q, s)
                alpha = alpha[:, :, 0]
                beta = np.zeros((len(lattice), n))
                beta[s, np.arange(n)] = 1
                z = np.maximum(alpha[s, np.arange(n)], 1e-300)
                for end in range(len(lattice) - 1, 0, -1):
                    for length, w, ids in lattice[end]:
                        flow = beta[end, w] * q[ids, 0]
                        beta[end - length, w] += flow
                        np.add.at(expected, ids, alpha[end - length, w] * flow / z[w] * count[part][w])
            p = expected / expected.sum()
        log_p.append(np.log(p))
    return Model(langs, np.stack(log_p, axis=1), np.full(len(langs), -np.log(len(langs))), path)


def train(docs: DataFrame, most: int = 250, path: str | None = None) -> Model | None:
    """Fits on at most `most` texts of each language, the first by a hash of doc_id."""
    rows = docs.filter("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "doc_id")
    by = Window.partitionBy("lang").orderBy("h", "doc_id")
    chosen = rows.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= most).select("doc_id")
    texts: dict[str, list[str]] = {}
    sample = docs.filter("lang is not null and text is not null").select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(chosen.distinct()), "doc_id").groupBy("doc_id").agg(F.min(F.struct("lang", "text")).alias("x"))
    for r in sample.orderBy("doc_id").select("x.lang", "x.text").collect():
        if r.text:
            texts.setdefault(str(r.lang), []).append(r.text)
    return fit(texts, path=path)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score."""
    letters = np.zeros(256, bool)
    letters[[*range(65, 91), *range(97, 123)]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches, most=SLICE_BYTES):
            raw, offsets = texts_of(b.column("text"))
            n = b.num_rows
            has = np.add.reduceat(np.append(letters[raw], False), offsets[:-1]) > 0 if n else np.zeros(0, bool)
            has &= np.diff(offsets) > 0
            for i in np.flatnonzero(~has & (np.diff(offsets) > 0)).tolist():
                has[i] = any(c.isalpha() for c in raw[offsets[i] : offsets[i + 1]].tobytes().decode())
            names, scores = [UND] * n, np.zeros(n)
            if model is not None and len(raw):
                words, begin, size, which, row = distinct_words(raw, offsets)
                each = model.word_scores(words, begin, size)
                total = np.stack([np.bincount(row, each[which, k], n) for k in range(len(model.langs))], axis=1) + model.prior
                p = np.exp(total - total.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                scores = np.where(has, p[np.arange(n), best], 0.0)
                names = [model.langs[k] if ok else UND for k, ok in zip(best.tolist(), has.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learns from documents that are not held out."""
    held = is_held_out("doc_id", 4, 2)
    return predict(docs, train(docs.filter(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
