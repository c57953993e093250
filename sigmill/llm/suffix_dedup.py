"""Removal of byte strings that an earlier document has too, by a distributed merge sort of suffixes.

A byte goes if a string of `LENGTH` bytes that covers it also starts in a document with a smaller doc_id. Sorting every
suffix would move many times the input, so only suffixes at anchors are sorted: a string's anchor is the position of
its smallest K-byte hash (leftmost of equals), so equal strings have equal anchors and no string is missed.

1. Tasks send the hashes of their anchors to buckets, each hash once with one doc_id for a few million anchors; a hash
   that several documents have is flagged. (A truncated hash can flag too much, never too little.)
2. Documents meet their flags. Around each flagged anchor the suffix behind it and the bytes before it are cut out.
   Equal surroundings within a chunk of documents are settled there, and only those of the smallest doc_id go on. The
   suffixes are sorted, front-coded (length of the common prefix with the one before, then the rest), and sent.
3. A bucket merges its runs with a loser tree whose nodes know the common prefix of each loser with its winner, so a
   comparison starts behind the known prefix and most need no byte at all. The merge yields the common prefixes of
   neighbours; from them and the bytes before the anchor each string's smallest doc_id follows, for every place of the
   anchor in the string.
4. Documents meet the removed ranges.

Copies of a whole text are settled by its digest before step 2. A string that very many documents share is sent once
for each chunk of documents.

Edge cases: null text is empty; a row with a null doc_id loses nothing and makes no other lose anything; rows that repeat a
doc_id are treated alike, as no string can come from a smaller doc_id among them; texts shorter than LENGTH lose
nothing; an empty table gives an empty result; other columns are kept by `dedup` and ignored by `digests`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import materialize, shuffle_partitions
from .textops import U64, chunks, mix, powers, prefix_hash, texts_of

LENGTH = 50
K = 24
SPAN = LENGTH - K  # an anchor stands 0 to SPAN bytes behind its string's beginning
CHUNK_TEXT = 6 << 20  # text bytes of a chunk of documents, about
COMBINE = 2_000_000  # anchors that a task combines before it sends them
SLICE = 1 << 20
FLAG_BITS = 40
ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "_chunk")


def anchors(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Position, first and last string beginning, row and K-byte hash of each anchor."""
    n = len(raw)
    if n < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    prefix = prefix_hash(raw)
    _, inverse = powers(n + 1)
    h = mix((prefix[K:] - prefix[:-K]) * inverse[: n - K + 1])
    low = (h & U64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=U64)
    span = 1
    while 2 * span <= SPAN + 1:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    rest = SPAN + 1 - span
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    at = (low & U64(0xFFFFFFFF)).astype(np.int64)  # the anchor of the string that begins here
    inside = np.zeros(len(at) + 1, np.int32)
    sizes = np.diff(offsets)
    full = sizes >= LENGTH
    np.add.at(inside, offsets[:-1][full], 1)
    np.add.at(inside, offsets[1:][full] - LENGTH + 1, -1)
    begins = np.flatnonzero(np.cumsum(inside[:-1]) > 0)
    if not len(begins):
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int64, U64))
    at = at[begins]
    row = np.searchsorted(offsets, begins, side="right") - 1
    # an empty row shares its offset with the next one; searchsorted takes the last, which holds the byte
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(row, prepend=-1) != 0))
    last = np.append(first[1:], len(at)) - 1
    p = at[first]
    return p, begins[first], begins[last], row[first], h[p]


def hash_long(x: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column."""
    p1, p2, p3, p4, p5 = (U64(v) for v in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    with np.errstate(over="ignore"):
        k = x.astype(np.int64).view(U64) * p2
        k = ((k << U64(31)) | (k >> U64(33))) * p1
        h = k ^ (U64(42) + p5 + U64(8))
        h = ((h << U64(27)) | (h >> U64(37))) * p1 + p4
        h = (h ^ (h >> U64(33))) * p2
        h = (h ^ (h >> U64(29))) * p3
        return h ^ (h >> U64(32))


def chunk_of(ids: np.ndarray, count: int) -> np.ndarray:
    return hash_long(ids).view(np.int64) % count


def pack(*columns: np.ndarray) -> bytes:
    parts = [zstandard.compress(np.ascontiguousarray(c).tobytes(), 1) for c in columns]
    return b"".join(len(p).to_bytes(4, "little") + p for p in parts)


def unpack(blob: bytes, *kinds) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(blob[at : at + 4], "little")
        out.append(np.frombuffer(zstandard.decompress(blob[at + 4 : at + 4 + n]), kind))
        at += 4 + n
    return out


def _parts(key: np.ndarray, count: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(key, kind="stable")
    ends = np.searchsorted(key[order], np.arange(count + 1))
    for k in np.flatnonzero(np.diff(ends)).tolist():
        yield k, order[ends[k] : ends[k + 1]]


def _pack_flags(ids: np.ndarray, hashes: np.ndarray) -> bytes:
    """doc_ids as differences with run lengths; hashes in FLAG_BITS bits."""
    order = np.argsort(ids, kind="stable")
    ids, hashes = ids[order], hashes[order]
    first = np.flatnonzero(np.diff(ids, prepend=ids[:1] - 1))
    short = np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, : FLAG_BITS // 8]
    return pack(np.diff(ids[first], prepend=0), np.diff(first, append=len(ids)).astype("<u4"), short)


def _unpack_flags(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    steps, runs, short = unpack(blob, "<i8", "<u4", np.uint8)
    full = np.zeros((len(short) // (FLAG_BITS // 8), 8), np.uint8)
    full[:, : FLAG_BITS // 8] = short.reshape(len(full), -1)
    return np.repeat(np.cumsum(steps), runs), full.view(U64).ravel()


def _table(rows: list[tuple], *names: str) -> pa.RecordBatch:
    kinds = {"bucket": pa.int32(), "chunk": pa.int32(), "kind": pa.int32(), "blob": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[n]) for n, c in zip(names, zip(*rows) if rows else [()] * len(names))], names=list(names))


KEYS, FLAGS, COPIES, RUNS, RANGES = range(5)


def _send_hashes(buckets: int, count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            h, ids = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            first = np.diff(h, prepend=~h[:1]) != 0
            fresh = first | (np.diff(ids, prepend=ids[:1] - 1) != 0)
            h, ids, first = h[fresh], ids[fresh], first[fresh]
            size = np.diff(np.flatnonzero(first), append=len(h))
            shared = np.repeat(size > 1, size)
            rows = []
            for k, some in _parts((h[first] % U64(buckets)).astype(np.int64), buckets):
                rows.append((k, KEYS, k, _pack_flags(ids[first][some], h[first][some] // U64(buckets))))
            for k, some in _parts(chunk_of(ids[shared], count), count):
                rows.append((k % buckets, FLAGS, k, _pack_flags(ids[shared][some], h[shared][some] // U64(buckets))))
            yield _table(rows, "bucket", "kind", "chunk", "blob")

        for b in chunks(batches, most=SLICE):
            ids = b.column("doc_id").to_numpy()
            _, _, _, row, h = anchors(*texts_of(b.column("text")))
            held.append((h, ids[row]))
            if sum(len(x) for x, _ in held) >= COMBINE:
                yield from flush()
        if held:
            yield from flush()

    return run


def _flag(count: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        keys = rows[rows["kind"] == KEYS]
        out = [(c, FLAGS, blob) for c, blob in zip(rows["chunk"][rows["kind"] == FLAGS], rows["blob"][rows["kind"] == FLAGS])]
        if len(keys):
            ids, h = (np.concatenate(x) for x in zip(*map(_unpack_flags, keys["blob"])))
            order = np.argsort(h, kind="stable")
            ids, h = ids[order], h[order]
            begin = np.flatnonzero(np.diff(h, prepend=~h[:1]) != 0)
            several = np.minimum.reduceat(ids, begin) < np.maximum.reduceat(ids, begin)
            some = np.repeat(several, np.diff(begin, append=len(h)))
            ids, h = ids[some], h[some]
            out += [(c, FLAGS, _pack_flags(ids[part], h[part])) for c, part in _parts(chunk_of(ids, count), count)]
        return pd.DataFrame(out, columns=["chunk", "kind", "blob"])

    return run


def front_code(suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of each sorted row with the one before, and the bytes behind it."""
    n, width = suffixes.shape
    common = np.zeros(n, np.uint8)
    if n > 1:
        differ = suffixes[1:] != suffixes[:-1]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return common, suffixes[np.arange(width)[None] >= common[:, None]]


def front_decode(common: np.ndarray, tails: np.ndarray, width: int = LENGTH) -> list[bytes]:
    out, before, at, tails = [], b"", 0, tails.tobytes()
    for c in common.tolist():
        before = before[:c] + tails[at : at + width - c]
        at += width - c
        out.append(before)
    return out


def merge_runs(runs: list[tuple[list[bytes], list[int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Merges sorted runs. A run is its suffixes and the common prefix of each with the one before it in the run.

    Returns the places (counted through the runs, one after the other) in sorted order and the common prefix of each
    with its predecessor there. A node of the loser tree keeps the loser and its common prefix with the winner of that
    game. The winner's successor knows its common prefix with the winner, as do all losers on its way up: the longer
    one is smaller, and only of equal ones the bytes behind the prefix are compared."""
    width = 1
    while width < len(runs):
        width *= 2
    bases, total = [], 0
    for suffixes, _ in runs:
        bases.append(total)
        total += len(suffixes)
    pointer = [0] * width
    current: list[bytes | None] = [runs[r][0][0] if r < len(runs) and runs[r][0] else None for r in range(width)]
    known = [0 if s is not None else -1 for s in current]  # common prefix with the last winner, -1: no more
    node = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's known prefix becomes the one with the winner."""
        ka, kb = known[a], known[b]
        if ka > kb:
            return a, b
        if ka < kb:
            return b, a
        if ka < 0:
            return a, b
        x, y = current[a], current[b]
        x, y = x[ka:], y[ka:]
        if x == y:
            common = ka + len(x)
        else:
            bits = (int.from_bytes(x) ^ int.from_bytes(y)).bit_length()
            common = ka + len(x) - (bits + 7) // 8
        if x <= y:
            known[b] = common
            return a, b
        known[a] = common
        return b, a

    winners = list(range(width))
    level = width
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            w, loser = play(winners[2 * i], winners[2 * i + 1])
            node[level + i] = loser
            nxt.append(w)
        winners = nxt
    best = winners[0]
    order, commons = np.zeros(total, np.int64), np.zeros(total, np.uint8)
    for k in range(total):
        order[k], commons[k] = bases[best] + pointer[best], known[best]
        suffixes, within = runs[best]
        pointer[best] = i = pointer[best] + 1
        if i < len(suffixes):
            current[best], known[best] = suffixes[i], within[i]
        else:
            current[best], known[best] = None, -1
        at = (width + best) >> 1
        while at:
            other = node[at]
            kb, ko = known[best], known[other]
            if kb < ko:
                node[at], best = best, other
            elif kb == ko and kb >= 0:
                w, node[at] = play(best, other)
                best = w
            at >>= 1
    return order, commons


def _words(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian 64-bit columns."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    return wide.view(">u8").astype(U64)


def _pack_ranges(ids: np.ndarray, begin: np.ndarray, end: np.ndarray) -> bytes:
    return pack(ids.astype("<i8"), begin.astype("<i8"), (end - begin).astype("<u4"))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compresses each text, so that the exchanges of whole texts move about half as much."""
    z = zstandard.ZstdCompressor(level=3, write_content_size=True)
    for b in batches:
        at = b.schema.get_field_index("text")
        texts = [None if t is None else z.compress(t) for t in b.column(at).cast(pa.binary()).to_pylist()]
        yield b.set_column(at, pa.field("text", pa.binary()), pa.array(texts, pa.binary()))


def _unsqueeze(docs: pa.Table) -> pa.Table:
    z, at = zstandard.ZstdDecompressor(), docs.schema.get_field_index("text")
    texts = pa.array([None if t is None else z.decompress(t) for t in docs.column(at).to_pylist()], pa.large_binary())
    return docs.set_column(at, "text", texts.cast(pa.large_string()))


def _squeezed(docs: DataFrame) -> DataFrame:
    fields = [T.StructField(f.name, T.BinaryType() if f.name == "text" else f.dataType) for f in docs.schema.fields]
    return docs.mapInArrow(_squeeze, T.StructType(fields))


def _cut(buckets: int, count: int):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        docs = _unsqueeze(docs)
        kinds, blobs = side.column("kind").to_numpy(), side.column("blob").to_pylist()
        copies = [np.frombuffer(b, "<i8") for k, b in zip(kinds, blobs) if k == COPIES]
        if copies and docs.num_rows:
            docs = docs.filter(pc.invert(pc.is_in(docs.column("doc_id"), pa.array(np.concatenate(copies)))))
        flags = [_unpack_flags(b) for k, b in zip(kinds, blobs) if k == FLAGS]
        if not flags or not docs.num_rows:
            return pa.Table.from_batches([_table([], "bucket", "kind", "chunk", "blob")])
        flagged = np.unique(mix(np.concatenate([f[0] for f in flags]).view(U64) * U64(0x9E3779B97F4A7C15) + np.concatenate([f[1] for f in flags])))
        found: list[list[np.ndarray]] = []
        for b in chunks(iter(docs.combine_chunks().to_batches()), most=SLICE):
            raw, offsets = texts_of(b.column("text"))
            ids = b.column("doc_id").to_numpy().astype(np.int64)
            p, s1, s2, row, h = anchors(raw, offsets)
            key = mix(ids[row].view(U64) * U64(0x9E3779B97F4A7C15) + ((h // U64(buckets)) & U64((1 << FLAG_BITS) - 1)))
            at = np.minimum(np.searchsorted(flagged, key), len(flagged) - 1)
            some = flagged[at] == key
            p, s1, s2, row, h = p[some], s1[some], s2[some], row[some], h[some]
            near, far = p - s2, p - s1  # the anchor's smallest and largest place in its strings
            index = p[:, None] + np.arange(-SPAN, LENGTH)
            around = raw[np.clip(index, 0, max(len(raw) - 1, 0))]
            column = np.arange(-SPAN, LENGTH)[None]
            around[(column < -far[:, None]) | (column >= LENGTH - near[:, None])] = 0
            found.append([around, near.astype(np.uint8), far.astype(np.uint8), ids[row], p - offsets[row], h])
        around, near, far, ids, place, h = (np.concatenate(x) for x in zip(*found))
        if not len(ids):
            return pa.Table.from_batches([_table([], "bucket", "kind", "chunk", "blob")])
        # equal surroundings within the chunk: the smallest doc_id goes on, the others lose these strings
        words = _words(around)
        key = near.astype(U64) * U64(64) + far.astype(U64)
        for c in range(words.shape[1]):
            key = mix(key * U64(0xD6E8FEB86659FD93) + words[:, c])
        order = np.lexsort((ids, key))
        begin = np.flatnonzero(np.diff(key[order], prepend=~key[order[:1]]) != 0)
        lead = np.empty(len(ids), np.int64)
        lead[order] = np.repeat(order[begin], np.diff(begin, append=len(ids)))
        same = (words == words[lead]).all(axis=1) & (near == near[lead]) & (far == far[lead])
        lost = same & (ids > ids[lead])
        rows = []
        for c, some in _parts(chunk_of(ids[lost], count), count):
            i = np.flatnonzero(lost)[some]
            rows.append((c % buckets, RANGES, c, _pack_ranges(ids[i], place[i] - far[i], place[i] - near[i] + LENGTH)))
        go = np.flatnonzero(~lost)
        suffixes = around[go][:, SPAN:]
        words = _words(suffixes)
        bucket = (h[go] % U64(buckets)).astype(np.int64)
        order = np.lexsort((*words.T[::-1], bucket))
        go, suffixes, bucket = go[order], suffixes[order], bucket[order]
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(ends)).tolist():
            i = slice(ends[k], ends[k + 1])
            rows.append((k, RUNS, k, pack(*front_code(suffixes[i]), around[go[i]][:, :SPAN], near[go[i]], far[go[i]], ids[go[i]].astype("<i8"), place[go[i]].astype("<i8"))))
        return pa.Table.from_batches([_table(rows, "bucket", "kind", "chunk", "blob")])

    return run


def settle(order: np.ndarray, commons: np.ndarray, before: np.ndarray, near: np.ndarray, far: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each suffix and each place of the anchor in a string: has a smaller doc_id this string? In merged order."""
    before, near, far, ids = before[order], near[order], far[order], ids[order]
    lost = np.zeros((len(order), SPAN + 1), bool)
    left = np.zeros(len(order), U64)
    for o in range(SPAN + 1):
        if o:
            left = left * U64(0x9E3779B97F4A7C15) + before[:, SPAN - o].astype(U64) + U64(1)
        group = np.cumsum(commons < LENGTH - o)  # equal from the anchor to the string's end
        fits = np.flatnonzero((near <= o) & (o <= far))
        several = np.bincount(group[fits], minlength=int(group[-1]) + 1 if len(group) else 1) > 1
        fits = fits[several[group[fits]]]
        if not len(fits):
            continue
        key = mix(group[fits].astype(U64) * U64(0xD6E8FEB86659FD93) + mix(left[fits]))
        by = np.argsort(key, kind="stable")
        begin = np.flatnonzero(np.diff(key[by], prepend=~key[by[:1]]) != 0)
        least = np.repeat(np.minimum.reduceat(ids[fits[by]], begin), np.diff(begin, append=len(by)))
        lost[fits[by], o] = ids[fits[by]] > least
    out = np.empty_like(lost)
    out[order] = lost
    return out


def _merge(count: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(c, RANGES, blob) for c, blob in zip(rows["chunk"][rows["kind"] == RANGES], rows["blob"][rows["kind"] == RANGES])]
        runs, columns = [], []
        for blob in rows["blob"][rows["kind"] == RUNS]:
            common, tails, before, near, far, ids, place = unpack(blob, np.uint8, np.uint8, np.uint8, np.uint8, np.uint8, "<i8", "<i8")
            runs.append((front_decode(common, tails), common.tolist()))
            columns.append((before.reshape(-1, SPAN), near, far, ids, place))
        if runs:
            before, near, far, ids, place = (np.concatenate(c) for c in zip(*columns))
            order, commons = merge_runs(runs)
            del runs
            lost = settle(order, commons, before, near, far, ids)
            edge = np.diff(np.pad(lost, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            i, first = np.nonzero(edge == 1)
            _, behind = np.nonzero(edge == -1)
            ids, begin, end = ids[i], place[i] - behind + 1, place[i] - first + LENGTH
            out += [(c, RANGES, _pack_ranges(ids[some], begin[some], end[some])) for c, some in _parts(chunk_of(ids, count), count)]
        return pd.DataFrame(out, columns=["chunk", "kind", "blob"])

    return run


def _removed(raw: np.ndarray, offsets: np.ndarray, ids: np.ndarray, ranges: tuple[np.ndarray, ...], copies: np.ndarray) -> np.ndarray:
    """Which bytes of a slice go."""
    change = np.zeros(len(raw) + 1, np.int32)
    rid, begin, size = ranges
    sizes = np.diff(offsets)
    for row, doc in enumerate(ids):
        if doc is None:
            continue
        a, b = np.searchsorted(rid, [doc, doc + 1])
        if a < b:
            np.add.at(change, offsets[row] + np.minimum(begin[a:b], sizes[row]), 1)
            np.add.at(change, offsets[row] + np.minimum(begin[a:b] + size[a:b], sizes[row]), -1)
        at = np.searchsorted(copies, doc)
        if at < len(copies) and copies[at] == doc and sizes[row] >= LENGTH:
            change[offsets[row]] += 1
            change[offsets[row + 1]] -= 1
    return np.cumsum(change[:-1]) > 0


def _apply(columns: list[str], with_text: bool):
    def run(docs: pa.Table, side: pa.Table) -> pa.Table:
        kinds, blobs = side.column("kind").to_numpy(), side.column("blob").to_pylist()
        copies = np.sort(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(b, "<i8") for k, b in zip(kinds, blobs) if k == COPIES)]))
        parts = [unpack(b, "<i8", "<i8", "<u4") for k, b in zip(kinds, blobs) if k == RANGES]
        ranges = tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3
        order = np.argsort(ranges[0], kind="stable")
        ranges = tuple(x[order].astype(np.int64) for x in ranges)
        docs = _unsqueeze(docs)
        names = [*columns, *(["text"] if with_text else []), "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        out = []
        for b in chunks(iter(docs.combine_chunks().to_batches()), most=4 << 20):
            raw, offsets = texts_of(b.column("text"))
            gone = _removed(raw, offsets, b.column("doc_id").to_pylist(), ranges, copies)
            sums = np.zeros(len(raw) + 1, np.int64)
            np.cumsum(gone, out=sums[1:])
            removed = sums[offsets[1:]] - sums[offsets[:-1]]
            rise = gone.copy()
            rise[1:] &= ~gone[:-1]
            heads = offsets[:-1][np.diff(offsets) > 0]
            rise[heads] = gone[heads]
            np.cumsum(rise, out=sums[1:])
            spans = sums[offsets[1:]] - sums[offsets[:-1]]
            kept = raw[~gone].tobytes()
            ends = np.cumsum(np.diff(offsets) - removed)
            texts = [kept[a:e] for a, e in zip((ends - np.diff(offsets) + removed).tolist(), ends.tolist())]
            arrays = [b.column(c) for c in columns]
            if with_text:
                was_null = b.column("text").is_null().to_pylist()
                arrays.append(pa.array([None if no else t.decode(errors="ignore") for t, no in zip(texts, was_null)], pa.string()))
            arrays += [pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())]
            out.append(pa.RecordBatch.from_arrays(arrays, names=names))
        return pa.Table.from_batches(out) if out else None

    return run


def _run(docs: DataFrame, columns: list[str], with_text: bool) -> DataFrame:
    spark = docs.sparkSession
    docs = docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    known = docs.filter("doc_id is not null")
    digests = materialize(known.select("doc_id", F.sha2("text", 256).alias("digest"), F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).filter(F.col("size") >= LENGTH), "digests")
    total = digests.agg(F.sum("size")).first()[0] or 0
    count = max(shuffle_partitions(spark), -(-total // CHUNK_TEXT))
    buckets = count
    firsts = digests.groupBy("digest", "size").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunk = F.pmod(F.coalesce(F.xxhash64("doc_id"), F.lit(0)), F.lit(count)).cast("int")
    copies = digests.join(firsts, ["digest", "size"]).filter("doc_id > first").select(chunk.alias("chunk"), "doc_id")
    copies = copies.mapInArrow(_as_blobs, "chunk int, kind int, blob binary")
    copies = materialize(copies, "copies")

    sent = known.select("doc_id", "text").mapInArrow(_send_hashes(buckets, count), "bucket int, kind int, chunk int, blob binary")
    flags = sent.groupBy("bucket").applyInPandas(_flag(count), "chunk int, kind int, blob binary")
    cut = _squeezed(known.select("doc_id", "text", chunk.alias("chunk"))).groupBy("chunk").cogroup(flags.union(copies).groupBy("chunk"))
    cut = cut.applyInArrow(_cut(buckets, count), "bucket int, kind int, chunk int, blob binary")
    ranges = materialize(cut.groupBy("bucket").applyInPandas(_merge(count), "chunk int, kind int, blob binary"), "removed-ranges")

    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns), *(["text string"] if with_text else []), "n_bytes long, n_removed long, n_spans long, kept_sha256 string"])
    own = _squeezed(docs.select(*dict.fromkeys([*columns, "doc_id", "text"]), chunk.alias("_chunk")))
    side = ranges.union(copies).withColumnRenamed("chunk", "_chunk")
    return own.groupBy("_chunk").cogroup(side.groupBy("_chunk")).applyInArrow(_apply(columns, with_text), schema)


def _as_blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        where, ids = b.column("chunk").to_numpy(), b.column("doc_id").to_numpy()
        rows = [(k, COPIES, ids[where == k].astype("<i8").tobytes()) for k in np.unique(where).tolist()]
        yield _table(rows, "chunk", "kind", "blob")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return _run(docs, ["doc_id"], False)


def dedup(docs: DataFrame) -> DataFrame:
    """The columns of docs with the removed bytes cut from text (a character that a cut divides goes too), and n_bytes,
    n_removed, n_spans, kept_sha256 (of the exact remaining bytes); columns of these names, and of the name _chunk, go."""
    return _run(docs, [c for c in docs.columns if c != "text" and c.lower() not in ADDED], True)
