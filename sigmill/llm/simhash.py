"""SimHash near-dedup with BK-trees.

A document's 64-bit fingerprint is the bitwise majority of the XXH64 hashes of its word shingles. Distinct fingerprints
are dealt into shards such that two fingerprints within the radius meet in at least one shard (they agree on all bits
of some combination of blocks, by the pigeonhole principle). Each shard grows a BK-tree: children are keyed by their
integer Hamming distance to the parent, and a search follows only the edges within the radius of its own distance. The
bits that a shard shares are no more than leave it about TREE fingerprints, so that few shards are met and their trees do
the search.
Shard trees are sent by a shuffle instead of a broadcast, because all fingerprints together have no size bound.

A shard reports a spanning forest of its links, not all pairs, and components are found by star steps in Spark. Copies
share one fingerprint and so are one tree entry, however many there are.

Edge cases: null, empty or wordless text has fingerprint zero and links like any other; a text of fewer words than a
shingle is one shingle; repeated rows fall together; null doc_ids never name a component unless all of it are null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import materialize, shuffle_partitions
from .textops import LOWER, Words, chunks, texts_of

SEED = 42
LEAF = 8  # words that a node keeps unsplit
TREE = 512  # words of a shard's tree, about


def shingle_bounds(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased words joined by single spaces, and begin, end and row of each shingle in them."""
    w = Words(raw, offsets)
    lengths = w.end - w.begin
    joined = np.full(int(lengths.sum()) + len(lengths), 0x20, np.uint8)
    ordinal = np.repeat(np.arange(len(lengths)), lengths)
    joined[np.arange(len(ordinal)) + ordinal] = LOWER[raw[w.inside]]
    begin = np.cumsum(lengths + 1) - lengths - 1
    end = begin + lengths
    first = np.cumsum(w.count) - w.count
    many = np.maximum(w.count - size + 1, np.minimum(w.count, 1))
    row = np.repeat(np.arange(w.rows), many)
    at = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + first[row]
    last = np.minimum(at + size, first[row] + w.count[row]) - 1
    return joined.tobytes(), begin[at], end[last], row


def fingerprints_of(raw: np.ndarray, offsets: np.ndarray, size: int) -> np.ndarray:
    """The fingerprint of each row of a slice."""
    text, begin, end, row = shingle_bounds(raw, offsets, size)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())), np.uint64, len(row))
    return majority(h, np.bincount(row, minlength=len(offsets) - 1))


def majority(h: np.ndarray, many: np.ndarray) -> np.ndarray:
    """For each row, the bits that over half of its hashes have. h: the rows' hashes, one row after the other."""
    out = np.zeros(len(many), np.uint64)
    full = np.flatnonzero(many)
    starts = (np.cumsum(many) - many)[full]
    for a in range(0, len(full), 512):
        part = full[a : a + 512]
        lo = starts[a]
        hi = starts[a + len(part) - 1] + many[part[-1]]
        bits = np.unpackbits(h[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, starts[a : a + len(part)] - lo, axis=0, dtype=np.int32)
        out[part] = np.packbits(ones * 2 > many[part][:, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            fp = fingerprints_of(*texts_of(b.column("text")), size)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


class BKTree:
    """A BK-tree over 64-bit words; a node of at most LEAF words keeps them unsplit."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.nodes: list[tuple] = []  # (pivot, {distance: node}) or (None, members)
        stack = [(np.arange(len(words)), None, 0)]
        while stack:
            members, parent, distance = stack.pop()
            me = len(self.nodes)
            if parent is not None:
                self.nodes[parent][1][distance] = me
            if len(members) <= LEAF:
                self.nodes.append((None, members))
                continue
            self.nodes.append((members[0], {}))
            rest = members[1:]
            far = np.bitwise_count(words[rest] ^ words[members[0]])
            order = np.argsort(far, kind="stable")
            for part in np.split(rest[order], np.flatnonzero(np.diff(far[order])) + 1):
                stack.append((part, me, int(np.bitwise_count(words[part[0]] ^ words[members[0]]))))

    def within(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of positions within the radius, as blocks of two arrays; a pair comes at least once."""
        words = self.words
        stack = [(0, np.arange(len(words)))]
        while stack:
            at, queries = stack.pop()
            pivot, below = self.nodes[at]
            if pivot is None:
                for some in np.array_split(queries, len(queries) // 65_536 + 1):
                    q, m = np.nonzero(np.bitwise_count(words[some][:, None] ^ words[below][None, :]) <= radius)
                    q, m = some[q], below[m]
                    yield q[q > m], m[q > m]
                continue
            d = np.bitwise_count(words[queries] ^ words[pivot]).astype(np.int16)
            near = queries[(d <= radius) & (queries != pivot)]
            yield near, np.full(len(near), pivot)
            for k, child in below.items():
                if len(inside := queries[np.abs(d - k) <= radius]):
                    stack.append((child, inside))


class Forest:
    """Union-find over positions; whole blocks of pairs are joined, most of them already connected."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            ra, rb = root[a], root[b]
            open_ = ra != rb
            if not open_.any():
                return
            ra, rb = ra[open_], rb[open_]
            a, b = a[open_], b[open_]
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (deeper := root[root] != root).any():
                root[deeper] = root[root[deeper]]


def shard_links(shard: np.ndarray, words: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within each shard. shard: its number, in order; words: distinct within a shard."""
    forest = Forest(len(words))
    begin = np.flatnonzero(np.diff(shard, prepend=shard[0] - 1))
    sizes = np.diff(begin, append=len(shard))
    for at, n in zip(begin[sizes > 1].tolist(), sizes[sizes > 1].tolist()):
        for a, b in BKTree(words[at : at + n]).within(radius):
            forest.join(a + at, b + at)
    linked = np.flatnonzero(forest.root != np.arange(len(words)))
    return forest.root[linked], linked


def block_masks(radius: int, distinct: int) -> list[int]:
    """Bit masks such that two words within the radius agree on all bits of at least one, with about as many bits as keep
    a shard at TREE words, whatever the input's size."""
    bits = max(int(np.ceil(np.log2(max(distinct, 1) / TREE))), 0)
    blocks = radius + 1
    while blocks < 32 and 64 * (blocks - radius) // blocks < bits:
        blocks += 1
    edges = [64 * k // blocks for k in range(blocks + 1)]
    masks = set()
    for held in combinations(range(blocks), blocks - radius):
        places = [p for k in held for p in range(edges[k], edges[k + 1])]
        masks.add(sum(1 << places[len(places) * k // bits] for k in range(min(bits, len(places)))))
    return sorted(masks)


def links(fps: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """a, b: links between distinct words within the radius that share the bits of a mask. fps: one column, fp."""
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    dealt = fps.select("fp", F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)))).alias("s"))
    n = shuffle_partitions(fps.sparkSession)
    dealt = dealt.select("s.t", "s.key", "fp").repartition(n, "t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def out(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            shard = np.cumsum(np.any(np.diff(rows[:, :2], axis=0, prepend=rows[:1, :2]), axis=1))
            words = np.ascontiguousarray(rows[:, 2])
            a, b = shard_links(shard, words.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(words[a]), pa.array(words[b])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            ends = np.flatnonzero(np.any(rows[:, :2] != rows[-1, :2], axis=1))
            upto = int(ends[-1]) + 1 if len(ends) else 0  # rows of the last, perhaps unfinished, shard stay
            if upto:
                yield from out(np.concatenate([*held, rows[:upto]]))
                held = [rows[upto:]]
            elif held and np.any(held[-1][-1, :2] != rows[0, :2]):
                yield from out(np.concatenate(held))
                held = [rows]
            else:
                held.append(rows)
        if held:
            yield from out(np.concatenate(held))

    return dealt.mapInArrow(run, "a long, b long").distinct()


def components(docs: DataFrame, size: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable by links of at most `radius` bits)."""
    prints = materialize(fingerprints(docs, size), "fingerprints")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    distinct = materialize(distinct, "distinct-fingerprints")
    edges = links(distinct.select("fp"), block_masks(radius, distinct.count()), radius)
    roots = connected(edges)
    classes = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    named = classes.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = classes.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
