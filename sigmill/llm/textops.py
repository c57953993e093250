"""Vectorised byte-level text helpers used inside Arrow tasks.

Texts stay in Arrow's UTF-8 buffer: words, lines and windows are found with numpy over the bytes of a bounded slice of
rows, so no Python string is made per word. A null text counts as empty."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
U64 = np.uint64

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
STARTS_CHAR = (np.arange(256) & 0xC0) != 0x80

_rng = np.random.RandomState(20240607)
_BYTE = _rng.randint(0, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = U64(0xC2B2AE3D27D4EB4F)
_powers: list[np.ndarray] = [np.ones(1, U64), np.ones(1, U64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P^i and P^-i modulo 2^64 for i < n."""
    if len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        for k, base in enumerate((_P, _P_INV)):
            steps = np.full(size, base, U64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=U64)
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a polynomial hash are usable."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows in them; null rows are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of at most `most` bytes of text (a longer row comes alone), so that working memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > begin and (held + n > most or i - begin >= 20_000):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += n
        yield batch.slice(begin)


class Words:
    """Words ([^\\x20\\x09-\\x0D]+) of a slice: begin and end byte, and the row of each."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        self.raw, self.offsets, self.rows = raw, offsets, len(offsets) - 1
        self.inside = ~IS_SPACE[raw]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = self.inside[:-1], self.inside[1:]
        self.begin = np.flatnonzero(self.inside & (~before | edge[:n]))
        self.end = np.flatnonzero(self.inside & (~after | edge[1:])) + 1
        self.row = np.searchsorted(offsets, self.begin, side="right") - 1
        self.count = np.bincount(self.row, minlength=self.rows).astype(np.int64)


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """Prefix sums from which span_hash takes the hash of any span."""
    p, _ = powers(len(raw) + 1)
    out = np.zeros(len(raw) + 1, U64)
    np.cumsum(_BYTE[raw] * p[: len(raw)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    _, inverse = powers(len(prefix))
    return mix((prefix[end] - prefix[begin]) * inverse[begin] + (end - begin).astype(U64) * _Q)


def row_sums(mask: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row the mask marks."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def window_hash(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = words[:n].copy()
    for k in range(1, size):
        out *= _Q
        out += words[k : k + n]
    return mix(out)
