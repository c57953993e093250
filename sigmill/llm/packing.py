"""Packing token sequences by non-negative least squares over a length histogram.

Documents are tokenised once. A document is cut into whole windows, each a sequence of its own, and a remainder shorter
than the window. Only the histogram of remainder lengths (at most window - 1 bins, whatever the corpus) reaches the
driver, which enumerates the pairs and triples of lengths that fill a window exactly, solves their repeat counts
against the histogram by non-negative least squares, rounds them, and packs what is left greedily, longest first.
The plan is a short list of (length, rank range) segments, so each piece finds its place from its rank among the pieces
of its length. Ranks come from windows over (length, salt), so a length that a third of all documents share is spread.

Edge cases: null or empty text is the end token alone; each row is a document of its own, so repeated rows are packed
each; null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize
from .textops import chunks

WINDOW = 1024
SALTS = 64
END_ID = 0

_touching = re.compile(r" \s|\s ")


class Ids:
    """Little-endian 32-bit ids of texts under the byte-level BPE vocabulary.

    A single space between two non-spaces always begins a pretoken, so the text is split there and the ids of each part
    are kept (a bounded number of them). Texts with other spacing are encoded whole; a text that spells the vocabulary's
    special token goes to the tokenizers library, which has a rule for it."""

    MOST = 400_000
    SPECIAL = "<|endoftext|>"

    def __init__(self, vocabulary: str | None = None):
        import public_tokenizers
        import tiktoken

        self.file = vocabulary or public_tokenizers.path("byte_bpe_50k.json")
        with open(self.file.replace(".json", ".tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.parts: dict[str, bytes] = {}
        self.whole = None

    def _plain(self, text: str) -> bytes:
        return np.array(self.encoding.encode_ordinary(text), "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.SPECIAL in text:
            if self.whole is None:
                from tokenizers import Tokenizer

                self.whole = Tokenizer.from_file(self.file)
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if _touching.search(text) or text[:1].isspace():
            return self._plain(text)
        first, *rest = text.split(" ")
        known = self.parts
        try:
            return self._plain(first) + b"".join([known[p] for p in rest])
        except KeyError:
            pass
        if len(known) > self.MOST:
            known.clear()
        for p in rest:
            if p not in known:
                known[p] = self._plain(" " + p)
        return self._plain(first) + b"".join([known[p] for p in rest])


def token_pieces(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, n (ids with the end token), crcs (of each whole window, then of the remainder if there is one)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end, width = Ids(vocabulary), np.array([END_ID], "<u4").tobytes(), 4 * window
        for b in chunks(batches):
            sizes, crcs = [], []
            for text in b.column("text").to_pylist():
                blob = (ids(text) if text else b"") + end
                sizes.append(len(blob) // 4)
                crcs.append([zlib.crc32(blob[i : i + width]) for i in range(0, len(blob), width)])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))], names=["doc_id", "n", "crcs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n long, crcs array<long>")


def exact_fills(window: int) -> np.ndarray:
    """All pairs and triples of lengths that sum to the window; a pair has 0 in its third place."""
    a, b = np.meshgrid(np.arange(1, window), np.arange(1, window), indexing="ij")
    c = window - a - b
    triples = (a <= b) & (b <= c)
    pairs = np.arange(1, window // 2 + 1)
    return np.concatenate([np.stack([pairs, window - pairs, 0 * pairs], 1), np.stack([a[triples], b[triples], c[triples]], 1)])


def repeat_counts(histogram: np.ndarray, fills: np.ndarray, passes: int = 80) -> np.ndarray:
    """Non-negative least squares: x >= 0 that minimises |A x - histogram|, A's columns being the fills.

    Coordinate descent; each pass takes the exact step for the fills of largest gain that share no length."""
    left = histogram.astype(float).copy()
    left[0] = 0
    a, b, c = fills.T
    norm = 3.0 + 2.0 * (a == b) + 2.0 * (b == c) + 2.0 * (a == c) - (c == 0)
    x = np.zeros(len(fills))
    for _ in range(passes):
        grad = left[a] + left[b] + left[c]
        step = np.maximum(grad / norm, -x)
        gain = step * grad - 0.5 * norm * step * step
        best = np.argpartition(-gain, min(2000, len(gain) - 1))[:2000]
        best = best[np.argsort(-gain[best], kind="stable")]
        used: set[int] = {0}
        moved = 0.0
        for j in best.tolist():
            lengths = {int(a[j]), int(b[j]), int(c[j])} - {0}
            if gain[j] > 0 and not lengths & used:
                used |= lengths
                x[j] += step[j]
                for k in (a[j], b[j], c[j]):
                    if k:
                        left[k] -= step[j]
                moved = max(moved, abs(step[j]))
        if moved < 0.25:
            break
    return x


def plan(histogram: np.ndarray, window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Segments (length, first rank, end rank, first sequence, offset, copies in a sequence), and the sequence count.
    histogram[n]: how many pieces of length n < window there are."""
    left = histogram.astype(np.int64).copy()
    left[0] = 0
    patterns: list[tuple[dict[int, int], int]] = []
    if left.any():
        fills = exact_fills(window)
        x = repeat_counts(left, fills)
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            need: dict[int, int] = {}
            for n in fills[j].tolist():
                if n:
                    need[n] = need.get(n, 0) + 1
            times = min(int(x[j] + 0.5), *(int(left[n]) // m for n, m in need.items()))
            if times > 0:
                patterns.append((need, times))
                for n, m in need.items():
                    left[n] -= m * times
    while left.any():
        need, space = {}, window
        while space and len(fit := np.flatnonzero(left[1 : space + 1])):
            n = int(fit[-1]) + 1
            if n in need:
                fit = fit[fit + 1 < n]
                if not len(fit):
                    break
                n = int(fit[-1]) + 1
            need[n] = min(space // n, int(left[n]))
            space -= n * need[n]
            if n == 1:
                break
        times = min(int(left[n]) // m for n, m in need.items())
        patterns.append((need, times))
        for n, m in need.items():
            left[n] -= m * times
    used = np.zeros(window + 1, np.int64)
    segments, sequence = [], 0
    for need, times in patterns:
        offset = 0
        for n, m in need.items():
            segments.append((n, int(used[n]), int(used[n]) + m * times, sequence, offset, m))
            used[n] += m * times
            offset += n * m
        sequence += times
    return sorted(segments), sequence


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = token_pieces(docs, vocabulary, window).withColumns(
        {"rest": (F.col("n") % window).cast("int"), "whole": F.floor(F.col("n") / window), "salt": F.pmod(F.xxhash64("doc_id", "crcs"), F.lit(SALTS)).cast("int")}
    )
    pieces = materialize(pieces, "token-pieces")
    groups = pieces.groupBy("rest", "salt").agg(F.count(F.lit(1)).alias("k"), F.sum("whole").alias("w")).orderBy("rest", "salt").toPandas()  # at most window * SALTS rows
    count, whole = np.zeros((2, window, SALTS), np.int64)
    count[groups["rest"], groups["salt"]] = groups["k"]
    whole[groups["rest"], groups["salt"]] = groups["w"]
    segments, first_whole = plan(count.sum(axis=1), window)
    table = np.array(segments, np.int64).reshape(-1, 6)
    rank_base = np.cumsum(count, axis=1) - count
    whole_base = first_whole + np.cumsum(whole.ravel()).reshape(whole.shape) - whole
    big = int(count.sum()) + 1
    key = table[:, 0] * big + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, rest, salt, rank, before = (b.column(c).to_numpy().astype(np.int64) for c in ("n", "rest", "salt", "rank", "before"))
            at = n // window
            many = at + (rest > 0)
            doc = np.repeat(np.arange(len(n)), many)
            k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            last = k == at[doc]
            sequence = (whole_base[rest, salt] + before)[doc] + k
            offset = np.zeros(len(doc), np.int64)
            d = doc[last]
            g = rank_base[rest[d], salt[d]] + rank[d]
            s = table[np.searchsorted(key, rest[d] * big + g, side="right") - 1]
            inside = g - s[:, 1]
            sequence[last] = s[:, 3] + inside // s[:, 5]
            offset[last] = s[:, 4] + inside % s[:, 5] * rest[d]
            crcs = b.column("crcs").flatten()
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(doc)), pa.array(k * window), pa.array(np.where(last, rest[doc], window)), crcs, pa.array(n[doc]), pa.array(sequence), pa.array(offset)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"],
            )

    by = Window.partitionBy("rest", "salt").orderBy("doc_id", "n", "crcs")
    ranked = pieces.withColumns({"rank": F.row_number().over(by) - 1, "before": F.sum("whole").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("whole")})
    return ranked.mapInArrow(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
