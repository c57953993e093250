"""Interpolated modified Kneser-Ney model of word n-grams of any order from two.

Counting: a first exchange of each task's different words makes the vocabulary: a shard has the words of its hashes, and a
word's number is its rank by count there, times the shards, plus the shard, so that frequent words have small numbers. Then
each task combines its n-grams of the highest order, as word numbers, over a few million tokens and sends them to shards. A
shard sums them and writes them as a sorted hash array with counts, its contexts with the number of followers seen once,
twice and more often, and derives how many different words stood before each shorter n-gram. These continuation counts are
the counts of the lower orders. Triples are dealt by their middle word, so that a shard has all triples of a context and all
triples that end in the same pair: it counts the pairs too, without another exchange. Words that would fill a shard alone
(the vocabulary knows them; their number is bounded by that of the shards) are split: their triples are dealt by context, and
the pairs that they begin are exchanged once more. The last exchange is by word: continuation counts and followers. The
arrays' names travel through the same exchanges. Longer n-grams are dealt by context, and each order sends on the one below.
Nothing whole passes the driver: it gets one short row of sums and split words for each shard.
Scoring: workers map the arrays of the shared folder into memory and look up each different n-gram of a slice once, at
every order.

What is sent is small because n-grams are sorted and sent as differences of word numbers, whose bytes are compressed by their
rank: a blob names no words, so an n-gram costs about the same however many shards there are. What is stored is small because
a shard's keys are dealt by their upper bits to buckets of some 16 to 32, and only the 32 bits that follow are kept of each (an n-gram that is
not there is taken for one that is with a chance of less than one in a hundred million), and counts are single bytes that
stand for the shard's 255 most frequent ones; others have a list.

Edge cases: null, empty or wordless text is the end token alone; words before a text's first are start tokens; repeated
rows are counted and scored each; a null doc_id is not held out; with no training text all probabilities are uniform over
one unknown word (score 0); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import io
import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .line_crf import is_held_out
from .shared import materialize, new_path
from .textops import LOWER, U64, Words, chunks, mix, prefix_hash, span_hash, texts_of

SLICE_BYTES = 2 << 20
COMBINE_TOKENS = 2 << 20
TASK_BYTES = 18 << 20  # text of a counting task: small input files are read together, so that blobs have many n-grams
SHARD_BYTES = 20 << 20
HOT_SHARE = 16  # a word that stands before others once for every 16 bytes of a shard is dealt to several
HASH_BITS = 56
START, END = (U64(0x51A9C0FFEE1234 + k) for k in (0, 1))
_PAIR = U64(0xD6E8FEB86659FD93)
UNKNOWN = np.iinfo(np.int64).max  # the number of words that are not in the vocabulary


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(v * _PAIR + w)


def gram_key(columns: list[np.ndarray]) -> np.ndarray:
    """One key for the words of each n-gram, given by their numbers, which are mixed first as they are small."""
    key = mix(columns[0].astype(U64))
    for c in columns[1:]:
        key = pair_key(key, c.astype(U64))
    return key


def tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens, 56-bit hashes of the words of each row, then its end; each token's row and place there."""
    raw = LOWER[raw]
    w = Words(raw, offsets)
    out = np.full(len(w.begin) + w.rows, END, U64)
    out[np.arange(len(w.begin)) + w.row] = span_hash(prefix_hash(raw), w.begin, w.end) >> U64(64 - HASH_BITS)
    row = np.repeat(np.arange(w.rows), w.count + 1)
    place = np.arange(len(out)) - np.repeat(np.cumsum(w.count + 1) - w.count - 1, w.count + 1)
    return out, row, place


def grams_of(ids: np.ndarray, place: np.ndarray, order: int, start: int) -> list[np.ndarray]:
    """The n-gram that ends at each token, oldest word first."""
    columns = [ids]
    for lag in range(1, order):
        before = np.full(len(ids), start, ids.dtype)
        before[lag:] = ids[:-lag]
        before[place < lag] = start
        columns.insert(0, before)
    return columns


def pack_columns(*columns: np.ndarray) -> bytes:
    """Columns of one blob, each in the smallest type that holds it; 64-bit hashes lose their empty top byte. The lowest
    bytes of all values come first, then the next ones, as upper bytes are alike and compress well."""
    parts = []
    for c in columns:
        if c.dtype == U64:
            kind, c = "h", np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, : HASH_BITS // 8]
        else:
            c = _least(c)
            kind = str(c.dtype.itemsize)
            c = np.ascontiguousarray(c).view(np.uint8).reshape(len(c), -1) if len(c) else c
        z = zstandard.compress(c.T.tobytes(), 1)
        parts.append(kind.encode() + len(z).to_bytes(4, "little") + z)
    return b"".join(parts)


def unpack_columns(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = blob[at : at + 1], int.from_bytes(blob[at + 1 : at + 5], "little")
        raw = zstandard.decompress(blob[at + 5 : at + 5 + n])
        at += 5 + n
        width = HASH_BITS // 8 if kind == b"h" else int(kind)
        full = np.zeros((len(raw) // width, 8), np.uint8)
        full[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, -1).T
        out.append(full.view(U64 if kind == b"h" else np.int64).ravel())
    return out


def _least(x: np.ndarray) -> np.ndarray:
    return x.astype(np.min_scalar_type(int(x.max(initial=0))))


def _sorting(columns: list[np.ndarray]) -> np.ndarray:
    """Sorts by the first column, then the next; as many as fit one number are compared at once."""
    bits = max(max(int(c.max(initial=0)) for c in columns).bit_length(), 1)
    some = max(64 // bits, 1)
    keys = [reduce(lambda a, c: a << U64(bits) | c, (c.astype(U64) for c in columns[k : k + some])) for k in range(0, len(columns), some)]
    return np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])


def pack_grams(columns: list[np.ndarray], *counts: np.ndarray) -> bytes:
    """N-grams in the order of their words' numbers, those of a triple by the middle one, and the counts. The first column is
    stored as steps; the others as steps as long as the columns before them stay the same."""
    columns = _middle_first(columns)
    order = _sorting(columns)
    out, same = [], np.zeros(len(order), bool)
    same[1:] = True
    for c in columns:
        c = c[order].astype(np.int64)
        step = np.diff(c, prepend=0)
        out.append(np.where(same, step, c))
        same = same & (step == 0)
    return pack_columns(*out, *(c[order] for c in counts))


def unpack_grams(blob: bytes, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    packed = unpack_columns(blob)
    columns, n = [], len(packed[0])
    same = np.zeros(n, bool)
    same[1:] = True
    for c in packed[:size]:
        run = np.cumsum(c)
        begin = np.flatnonzero(~same)  # here the sum starts anew
        columns.append(run - np.repeat(run[begin] - c[begin], np.diff(begin, append=n)))
        same[1:] &= columns[-1][1:] == columns[-1][:-1]
    return _middle_first(columns), packed[size:]


def _joined(blobs: list[bytes], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The n-grams of all blobs and their counts, in the smallest types, without holding every blob's twice."""
    columns: list[list[np.ndarray]] = [[] for _ in range(size)]
    counts: list[np.ndarray] = []
    for b in blobs:
        words, (n,) = unpack_grams(b, size)
        for k, c in enumerate(words):
            columns[k].append(_least(c))
        counts.append(_least(n))
    out = []
    for k in range(size):
        out.append(np.concatenate(columns[k]))
        columns[k].clear()
    return out, np.concatenate(counts)


def _middle_first(columns: list[np.ndarray]) -> list[np.ndarray]:
    """A triple's columns with the first two exchanged; others as they are."""
    return [columns[1], columns[0], columns[2]] if len(columns) == 3 else columns


def combine(keys: np.ndarray, values: Iterable[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Sorted different keys, a row of each, and the sums of their values, which are asked for one after the other."""
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    keys = keys[first]
    return keys, order[first], *(np.add.reduceat(v[order], first, dtype=np.int64) if len(first) else v.astype(np.int64) for v in values)


def save(folder: str, name: str, **arrays: np.ndarray) -> str:
    system, base = fs.FileSystem.from_uri(folder)
    at = f"{base}/{name}-{uuid.uuid4().hex}"
    system.create_dir(at, recursive=True)
    for key, value in arrays.items():
        with system.open_output_stream(f"{at}/{key}.npy") as out:
            buffer = io.BytesIO()
            np.save(buffer, value)
            out.write(buffer.getbuffer())
    return at


def load(folder: str, at: str, key: str) -> np.ndarray:
    """Maps an array into memory; from a store without local paths, through an unlinked temporary file."""
    system, _ = fs.FileSystem.from_uri(folder)
    if system.type_name == "local":
        return np.load(f"{at}/{key}.npy", mmap_mode="r")
    with system.open_input_stream(f"{at}/{key}.npy") as source, tempfile.NamedTemporaryFile(suffix=".npy", delete=False) as local:
        local.write(source.read())
    array = np.load(local.name, mmap_mode="r")
    os.unlink(local.name)
    return array


def is_hot(words: np.ndarray, hot: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(hot, words), max(len(hot) - 1, 0))
    return hot[at] == words if len(hot) else np.zeros(len(words), bool)


def shards_of(columns: list[np.ndarray], shards: int, hot: np.ndarray) -> np.ndarray:
    """The shard of each n-gram: that of its word, a pair's first word, a triple's middle word, or a longer one's context.
    Pairs that a hot word begins are dealt to shards of their own; triples around a hot word by their context."""
    size = len(columns)
    if size > 3:
        by = gram_key(columns[:-1])
    else:
        by = columns[1] if size == 3 else columns[0]
    many = is_hot(by, hot) if size in (2, 3) else np.zeros(len(by), bool)
    if many.any():
        by = by.astype(U64)
        by[many] = gram_key([c[many] for c in columns[:2]])
    return (by.astype(U64) % U64(shards)).astype(np.int64) + (shards * many if size == 2 else 0)


def _blobs(columns: list[np.ndarray], n: np.ndarray, shards: int, hot: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Shard and packed n-grams."""
    for k, some in _dealt(shards_of(columns, shards, hot)):
        yield k, pack_grams([c[some] for c in columns], n[some])


def _dealt(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(_least(shard), kind="stable")
    begin = np.flatnonzero(np.diff(shard[order], prepend=-1))
    for some in np.split(order, begin[1:]) if len(begin) else ():
        yield int(shard[some[0]]), some


_SHARD = "kind string, shard int, path string, blob binary, sums array<long>"


class Arrays:
    """Arrays of the shared folder, by kind and shard; they are mapped when first asked for."""

    def __init__(self, folder: str, paths: dict[int, dict[int, str]]):
        self.folder, self.paths = folder, paths

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "open"}

    def array(self, kind: int, shard: int, key: str) -> np.ndarray | None:
        if not hasattr(self, "open"):
            self.open: dict = {}
        at = self.paths[kind].get(shard)
        if at is None:
            return None
        if (kind, shard, key) not in self.open:
            self.open[kind, shard, key] = load(self.folder, at, key)
        return self.open[kind, shard, key]

    def rows(self, kind: int, shard: int, name: str, at: np.ndarray) -> np.ndarray:
        return decode_rows(*(self.array(kind, shard, f"{name}-{k}") for k in ("code", "rows", "places", "others")), at)


class Vocabulary(Arrays):
    """The numbers and counts of all words and of the start, whose count is 0."""

    def __init__(self, folder: str, shards: int, found: list[Row]):
        super().__init__(folder, {0: {r.shard: r.path for r in found}})
        self.shards = shards
        self.size, self.tokens = sum(r.words for r in found), sum(r.tokens for r in found)
        self.small = (max((r.words for r in found), default=0) + 1) * shards < 1 << 32  # a number of four bytes

    def numbers(self, words: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The number of each word, and its count if asked for."""
        number, n = np.full(len(words), UNKNOWN, np.int64), np.zeros(len(words), np.int64)
        for k, some in _dealt((words % U64(self.shards)).astype(np.int64)):
            if (known := self.array(0, k, "word")) is not None:
                at = np.minimum(np.searchsorted(known, words[some]), len(known) - 1)
                hit = known[at] == words[some]
                number[some[hit]] = self.array(0, k, "rank")[at[hit]].astype(np.int64) * self.shards + k
                if counted:
                    n[some[hit]] = self.rows(0, k, "n", at[hit])[:, 0]
        return number, n

    def start(self) -> int:
        return int(self.numbers(np.array([START]))[0][0])


def _words(shards: int):
    """Each task's different words, packed by shard, and their counts; that of the start is the number of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            words, n = (np.concatenate(x) for x in zip(*held))
            held.clear()
            words, _, n = combine(words, [n])
            for k, some in _dealt((words % U64(shards)).astype(np.int64)):
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pack_columns(words[some], n[some])], pa.binary())], names=["shard", "blob"])

        for b in chunks(batches, most=SLICE_BYTES):
            words, n = np.unique(tokens(*texts_of(b.column("text")))[0], return_counts=True)
            held.append((np.append(words, START), np.append(n, b.num_rows)))
            if sum(len(w) for w, _ in held) >= COMBINE_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    return run


def _number_words(folder: str, shards: int):
    """Writes a shard's words with their ranks by count. A word that stands before others SHARD_BYTES / HOT_SHARE / 2 times or
    more is a hot one; at most 2 * HOT_SHARE for each shard can, as a token has a byte."""
    least = max(SHARD_BYTES // HOT_SHARE // 2, 1)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        words, n = (np.concatenate(x) for x in zip(*map(unpack_columns, rows["blob"])))
        words, _, n = combine(words, [n])
        order, shard = np.argsort(-n, kind="stable"), int(key[0])
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        hot = rank[(n >= least) & (words != END)] * shards + shard
        n[words == START] = 0
        path = save(folder, "vocabulary", word=words, rank=_least(rank), **_coded("n", n))
        return pd.DataFrame([(shard, path, int((n > 0).sum()), int(n.sum()), hot.tolist())], columns=["shard", "path", "words", "tokens", "hot"])

    return run


def number_words(text: DataFrame, folder: str, shards: int) -> list[Row]:
    """A row a shard: path, words, tokens and hot words."""
    found = text.mapInArrow(_words(shards), "shard int, blob binary").groupBy("shard").applyInPandas(_number_words(folder, shards), "shard int, path string, words long, tokens long, hot array<long>")
    return materialize(found, "ngram-words").collect()


def hot_words(found: list[Row]) -> np.ndarray:
    """The sorted numbers of the hot words. Which are found only decides where n-grams are counted."""
    return np.sort(np.array([w for r in found for w in r.hot], np.int64))


def _grams(order: int, vocabulary: Vocabulary, hot: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        start = vocabulary.start()

        def flush() -> Iterator[pa.RecordBatch]:
            columns = grams_of(*(np.concatenate(x) for x in zip(*held)), order, start)
            held.clear()
            _, at, n = combine(gram_key(columns), [np.ones(len(columns[0]), np.uint8)])
            for k, blob in _blobs([c[at] for c in columns], n, vocabulary.shards, hot):
                yield pa.RecordBatch.from_arrays([pa.array(["grams"]), pa.array([k], pa.int32()), pa.array([None], pa.string()), pa.array([blob], pa.binary()), pa.array([None], pa.list_(pa.int64()))], names=["kind", "shard", "path", "blob", "sums"])

        for b in chunks(batches, most=SLICE_BYTES):
            out, _, place = tokens(*texts_of(b.column("text")))
            words, back = np.unique(out, return_inverse=True)
            number = vocabulary.numbers(words)[0].astype(np.uint32 if vocabulary.small else np.int64)
            held.append((number[back], np.minimum(place, order).astype(np.uint8)))
            if sum(len(x) for x, _ in held) >= COMBINE_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    return run


def split_keys(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted keys: where the bucket of each value of their upper bits ends, led by 0, and the 32 bits that follow."""
    bits = max(len(key).bit_length() - 5, 1)
    ends = np.searchsorted(key >> U64(64 - bits), np.arange((1 << bits) + 1, dtype=U64))
    return ends.astype(np.min_scalar_type(len(key))), (key >> U64(32 - bits)).astype(np.uint32)


def find_keys(ends: np.ndarray, low: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the wanted keys are there, and where: all bisect their buckets at once."""
    bits = (len(ends) - 1).bit_length() - 1
    bucket = (wanted >> U64(64 - bits)).astype(np.int64)
    bits32 = (wanted >> U64(32 - bits)).astype(np.uint32)
    at, end = ends[bucket].astype(np.int64), ends[bucket + 1].astype(np.int64)
    after = end.copy()
    left = np.flatnonzero(at < end)
    while len(left):
        middle = (at[left] + end[left]) >> 1
        less = low[middle] < bits32[left]
        at[left[less]] = middle[less] + 1
        end[left[~less]] = middle[~less]
        left = left[at[left] < end[left]]
    hit = at < after
    hit[hit] = low[at[hit]] == bits32[hit]
    return hit, at


def code_rows(*values: np.ndarray) -> dict[str, np.ndarray]:
    """The 255 most frequent rows of the values, a byte for each row that names one of them or is 255, and the rows that
    are none of them, with their places."""
    width = min(64 // len(values), 62)
    fits = np.ones(len(values[0]), bool)
    for v in values:
        fits &= v >> width == 0
    packed = values[0][fits].astype(U64)
    for v in values[1:]:
        packed = packed << U64(width) | v[fits].astype(U64)
    _, first, back, n = np.unique(packed, return_index=True, return_inverse=True, return_counts=True)
    del packed
    top = np.argsort(-n, kind="stable")[:255]
    rank = np.full(len(n), 255, np.uint8)
    rank[top] = np.arange(len(top))
    code = np.full(len(fits), 255, np.uint8)
    code[fits] = rank[back]
    kinds, others = np.flatnonzero(fits)[first[top]], np.flatnonzero(code == 255)
    return {"code": code, "rows": _least(np.stack([v[kinds] for v in values], 1)), "places": _least(others), "others": _least(np.stack([v[others] for v in values], 1))}


def decode_rows(code: np.ndarray, rows: np.ndarray, places: np.ndarray, others: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The rows at some places."""
    found = code[at]
    out = np.zeros((len(at), others.shape[1]), np.int64)
    plain = found < 255
    out[plain] = rows[found[plain]]
    out[~plain] = others[np.searchsorted(places, at[~plain])]
    return out


def _coded(name: str, *values: np.ndarray) -> dict[str, np.ndarray]:
    return {f"{name}-{k}": v for k, v in code_rows(*values).items()}


def _keyed(name: str, key: np.ndarray) -> dict[str, np.ndarray]:
    return dict(zip((f"{name}-ends", f"{name}-low"), split_keys(key)))


def _followers(n: np.ndarray) -> Iterator[np.ndarray]:
    """What a context sums: its total, and whether a follower was seen once, twice or more often."""
    yield n
    yield from (x.view(np.uint8) for x in (n == 1, n == 2, n > 2))


def _sums(n: np.ndarray) -> list[int]:
    return [len(n), *(int((n == k).sum()) for k in (1, 2, 3, 4))]


_COLUMNS = ["kind", "shard", "path", "blob", "sums"]


def _finish_pairs(folder: str, shards: int, shard: int, columns: list[np.ndarray], n: np.ndarray) -> list[tuple]:
    """Writes a shard's pairs, which come by key, and sends what it knows of words: words before, and followers."""
    path = save(folder, "grams2", **_keyed("gram", gram_key(columns)), **_coded("n", n))
    last, _, of_last = combine(columns[1], [np.ones(len(n), np.uint8)])
    first, _, *of_first = combine(columns[0], _followers(n))
    values = [np.concatenate([of_last, np.zeros(len(first), np.int64)]), *(np.concatenate([np.zeros(len(last), np.int64), v]) for v in of_first)]
    words, _, *values = combine(np.concatenate([last, first]).astype(np.int64), values)
    out: list[tuple] = [("order2", shard, path, None, _sums(n))]
    for k, some in _dealt(words % shards):
        out.append(("words", k, None, pack_columns(np.diff(words[some], prepend=0), *(v[some] for v in values)), None))
    return out


def _count_grams(folder: str, shards: int, hot: np.ndarray, size: int):
    """Counts the n-grams of a shard. Of the highest order the counts are those in the text, of lower ones the number of
    words seen before."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grams = rows["kind"] == "grams"
        out = list(rows[~grams].itertuples(index=False, name=None))  # what longer n-grams have said goes on
        if not grams.any():
            return pd.DataFrame(out, columns=_COLUMNS)
        shard = int(rows["shard"].iloc[0])
        columns, n = _joined([b for b in rows["blob"][grams]], size)
        key, at, n = combine(gram_key(columns), [n])
        for k in range(size):  # one by one, so that few are there twice
            columns[k] = columns[k][at]
        del at
        if size == 2:
            return pd.DataFrame(out + _finish_pairs(folder, shards, shard, columns, n), columns=_COLUMNS)
        context, _, *stats = combine(gram_key(columns[:-1]), _followers(n))
        of_context = {**_keyed("context", context), **_coded("stats", *stats)}
        del context, stats
        path = save(folder, f"grams{size}", **_keyed("gram", key), **_coded("n", n), **of_context)
        out.append((f"order{size}", shard, path, None, _sums(n)))
        del key, of_context
        shorter = columns[1:]
        del columns
        _, at, before = combine(gram_key(shorter), [np.ones(len(n), np.uint8)])
        shorter = [c[at] for c in shorter]
        del n
        whole = ~is_hot(shorter[0], hot) if size == 3 else np.zeros(len(at), bool)
        if whole.any():
            out += _finish_pairs(folder, shards, shard, [c[whole] for c in shorter], before[whole])
        if not whole.all():
            out += [("grams", k, None, blob, None) for k, blob in _blobs([c[~whole] for c in shorter], before[~whole], shards, hot)]
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def _count_words(folder: str, shards: int):
    """Writes what is known of a shard's words at their ranks."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = list(rows[rows["kind"] != "words"].itertuples(index=False, name=None))
        parts = [unpack_columns(b) for b in rows["blob"][rows["kind"] == "words"]]
        if parts:
            word, *values = (np.concatenate(x) for x in zip(*((np.cumsum(steps), *v) for steps, *v in parts)))
            word, _, *values = combine(word, values)
            rank = word // shards
            before, *followers = (np.bincount(rank, v).astype(np.int64) for v in values)
            path = save(folder, "words", **_coded("n", before), **_coded("stats", *followers))
            out.append(("order1", int(rows["shard"].iloc[0]), path, None, _sums(before)))
        return pd.DataFrame(out, columns=_COLUMNS)

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts for counts of 0, 1, 2 and more; where a count of counts is missing, three quarters."""
    if not all((n1, n2, n3, n4)):
        return np.array([0.0, 0.75, 0.75, 0.75])
    y = n1 / (n1 + 2 * n2)
    return np.array([0.0, *np.clip([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], 0.05, [0.99, 1.98, 2.97])])


class Model(Arrays):
    """Paths of the arrays, the vocabulary and the few numbers that all probabilities share."""

    def __init__(self, folder: str, vocabulary: Vocabulary, hot: np.ndarray, paths: dict[int, dict[int, str]], sums: dict[int, np.ndarray]):
        super().__init__(folder, paths)
        self.words, self.shards, self.hot = vocabulary, vocabulary.shards, hot
        self.order = max(paths)
        self.pairs = int(sums[2][0])
        self.vocabulary, self.tokens = vocabulary.size, vocabulary.tokens
        self.discount = {k: discounts(*x[1:].tolist()) for k, x in sums.items()}
        # what the discounts of continuation counts free for the uniform share
        n1, n2 = int(sums[1][1]), int(sums[1][2])
        d = self.discount[1]
        self.word_rest = (d[1] * n1 + d[2] * n2 + d[3] * (self.vocabulary - n1 - n2)) / self.pairs if self.pairs else 1.0

    def find(self, size: int, keys: str, values: str, columns: list[np.ndarray], wanted: np.ndarray, out: np.ndarray) -> None:
        """Fills in the values of those wanted keys that are there; columns: n-grams of the shards to look in."""
        for k, some in _dealt(shards_of(columns, self.shards, self.hot)):
            ends = self.array(size, k, f"{keys}-ends")
            if ends is not None:
                hit, at = find_keys(ends, self.array(size, k, f"{keys}-low"), wanted[some])
                out[some[hit]] = self.rows(size, k, values, at[hit])

    def of_words(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each word how many stood before it, and what it sums as a context."""
        n, stats = np.zeros((len(words), 1), np.int64), np.zeros((len(words), 4), np.int64)
        for k, some in _dealt(np.where(words == UNKNOWN, self.shards, words % self.shards)):
            if self.paths[1].get(k) is not None:
                n[some] = self.rows(1, k, "n", words[some] // self.shards)
                stats[some] = self.rows(1, k, "stats", words[some] // self.shards)
        return n[:, 0], stats

    def probabilities(self, columns: list[np.ndarray]) -> np.ndarray:
        """The probability of the last word of each n-gram behind the others."""
        words, back = np.unique(np.concatenate(columns[-2:]), return_inverse=True)
        n, stats = self.of_words(words)
        first, last = back.reshape(2, -1)
        before = n[last]
        kept = before - self.discount[1][np.minimum(before, 3)]
        p = (kept / self.pairs if self.pairs else kept) + self.word_rest / (self.vocabulary + 1)
        p = self.step(columns[-2:], stats[first], p)
        for size in range(3, self.order + 1):
            some = columns[-size:]
            contexts, at, back = np.unique(gram_key(some[:-1]), return_index=True, return_inverse=True)
            stats = np.zeros((len(contexts), 4), np.int64)
            self.find(size, "context", "stats", [c[at] for c in some], contexts, stats)
            p = self.step(some, stats[back], p)
        return p

    def step(self, columns: list[np.ndarray], stats: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Probabilities of one order from those of the order below. stats: a context's total, followers seen once, twice
        and more often."""
        size = len(columns)
        discount, total = self.discount[size], stats[:, 0]
        n = np.zeros((len(lower), 1), np.int64)
        self.find(size, "gram", "n", columns, gram_key(columns), n)
        n = n[:, 0]
        seen = (n - discount[np.minimum(n, 3)] + (stats[:, 1:] @ discount[1:]) * lower) / np.maximum(total, 1)
        return np.where(total > 0, seen, lower)


def train(docs: DataFrame, order: int = 2, shards: int | None = None) -> Model:
    """Counts all texts of docs. There is a shard for each SHARD_BYTES of text, and at most a task for each TASK_BYTES."""
    spark = docs.sparkSession
    text = docs.select(F.col("text").cast("string").alias("text"))
    n_bytes = text.agg(F.sum(F.octet_length("text"))).first()[0] or 1
    shards = shards or -(-n_bytes // SHARD_BYTES)
    folder = new_path(spark, "ngrams")
    text = text.coalesce(-(-n_bytes // TASK_BYTES))
    found = number_words(text, folder, shards)
    vocabulary, hot = Vocabulary(folder, shards, found), hot_words(found)
    rows = text.mapInArrow(_grams(order, vocabulary, hot), _SHARD)
    for size in range(order, 1, -1):
        if size > 2 or order == 2 or len(hot):  # without hot words the triples' shards have counted all pairs
            rows = rows.groupBy("shard").applyInPandas(_count_grams(folder, shards, hot, size), _SHARD)
    rows = rows.groupBy("shard").applyInPandas(_count_words(folder, shards), _SHARD).select("kind", "shard", "path", "sums")
    paths: dict[int, dict[int, str]] = {k: {} for k in range(1, order + 1)}
    sums = {k: np.zeros(5, np.int64) for k in paths}
    for r in materialize(rows, "ngram-shards").collect():
        size = int(r.kind.removeprefix("order"))
        paths[size][r.shard] = r.path
        sums[size] += np.array(r.sums)
    return Model(folder, vocabulary, hot, paths, sums)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score (both log10 probabilities)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = model.words.start()
        for b in chunks(batches, most=SLICE_BYTES):
            out, row, place = tokens(*texts_of(b.column("text")))
            words, word = np.unique(out, return_inverse=True)
            number, count = model.words.numbers(words, counted=True)
            columns = grams_of(number[word], place, model.order, start)
            _, at, back = np.unique(gram_key(columns), return_index=True, return_inverse=True)
            p = model.probabilities([c[at] for c in columns])
            base = np.log10((count + 1) / (model.tokens + model.vocabulary + 1))
            n = b.num_rows
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.bincount(row, minlength=n)), pa.array(np.bincount(row, (count > 0)[word], n).astype(np.int64)),
                 pa.array(np.bincount(row, base[word], n)), pa.array(np.bincount(row, np.log10(p)[back], n))],
                names=["doc_id", "n_tokens", "n_known", "base_score", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, n_tokens long, n_known long, base_score double, score double"
    )


def score_corpus(docs: DataFrame, order: int = 2) -> DataFrame:
    """Learns from the texts that are not held out and scores all."""
    held = is_held_out("doc_id", 7, 2)
    model = train(docs.filter(~held), order)
    return score(docs, model).select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
