"""Near copies: SimHash links first, then an exact similarity join for the rest; one document of each group stays.

Documents whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are near copies. Documents with
equal shingle sets form a class, and only its smallest doc_id is compared. Candidates come from two places:

* the SimHash operator's BK-trees, over the classes' fingerprints, at its radius. They find most copies, but not all: at a
  similarity of 0.8 fingerprints differ in ten bits or so, where neither trees nor tables prune enough to search them all;
* a prefix filter, which loses no pair at any size of the corpus. Two sets that are similar enough share a shingle among
  the first fifth of each, whatever order all sets are sorted in, so classes that share such a shingle meet in its shard.
  The order is that of the hashes, with the shingles that many prefixes hold behind all others, so that shards stay small
  where the texts allow it.

Small shards report all pairs that the sizes and the places of the shared shingle allow. A larger one first pairs its
members with the few whose fingerprints lie nearest to its centre, which connects the copies of one original; then the
members that no chain of verified pairs connects are paired with each other. A candidate must pass two checks before it may connect anything, so a false one suppresses no true one: how
many shingles its sets can share at most, by the numbers of their hashes in each of some hundred ranges, and then how many
they do share, by the sets themselves. Groups are the components of the pairs that pass.

Nothing is lost or added but what equal 64-bit hashes of different shingles would.

Edge cases: null or wordless texts are copies of each other; a text of fewer words than a shingle is one shingle; rows
with a null doc_id stay; rows that repeat a doc_id stay or go together; an empty table gives an empty result; all
columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected
from .shared import materialize, shuffle_partitions
from .simhash import SEED, block_masks, links, majority, shingle_bounds
from .textops import U64, chunks, mix, texts_of

SIZE = 5
SIMILARITY = 0.8
HOT = 16  # prefixes that hold a shingle before it goes behind the others
MOST_HOT = 100_000  # travels with the tasks; where more are hot, the hottest
SMALL = 16
BLOCK = 1024  # rows of a larger shard that meet each other block in one task
HUBS = (2, None)  # members of a larger shard that meet all others, by round
RADIUS = 3  # of the SimHash links
FULL = 255  # a count that stands for this many or more
COARSE = 256  # ranges that large shards compare by


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different shingle hashes of each row, one after the other, and how many each row has."""
    text, begin, end, row = shingle_bounds(raw, offsets, size)
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(text[a:b], SEED) for a, b in zip(begin.tolist(), end.tolist())), U64, len(row))
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[fresh], np.bincount(row[fresh], minlength=len(offsets) - 1)


def prefix_lengths(many: np.ndarray, similarity: float) -> np.ndarray:
    """How many of a set's first elements a similar set must share one of."""
    return np.where(many > 0, many - np.ceil(similarity * many - 1e-9).astype(np.int64) + 1, 0)


def range_counts(h: np.ndarray) -> bytes:
    """How many of a set's hashes lie in each of 2^k equal ranges, one or two on average."""
    k = max(int(len(h)).bit_length() - 1, 0)
    return np.minimum(np.bincount((h >> U64(64 - k)).astype(np.int64) if k else np.zeros(len(h), np.int64), minlength=1 << k), FULL).astype(np.uint8).tobytes()


def fold(counts: bytes, width: int) -> np.ndarray:
    """Counts of at most `width` ranges."""
    x = np.frombuffer(counts, np.uint8)
    x = np.where(x == FULL, 1 << 20, x.astype(np.int64))
    return x.reshape(min(width, len(x)), -1).sum(axis=1)


def most_shared(a: bytes, b: bytes) -> int:
    """How many elements two sets can share, by their range counts."""
    width = min(len(a), len(b))
    return int(np.minimum(fold(a, width), fold(b, width)).sum())


def prefixes(docs: DataFrame, size: int, similarity: float, hot: np.ndarray | None = None) -> DataFrame:
    """doc_id, n (how many different shingles), d0 and d1 (digests of their set), keys (the first of them), counts (in
    ranges of hashes), coarse (the same in fewer ranges), fp (the set's fingerprint)."""
    hot = np.zeros(0, U64) if hot is None else hot

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, many = shingle_sets(*texts_of(b.column("text")), size)
            many = many.astype(np.int64)
            begin = np.cumsum(many) - many
            full = np.flatnonzero(many)
            digests = np.zeros((2, len(many)), U64)
            if len(full):
                for k in (0, 1):
                    digests[k, full] = np.add.reduceat(mix(h + U64(k)), begin[full])
            row = np.repeat(np.arange(len(many)), many)
            counts = [range_counts(h[a : a + n]) for a, n in zip(begin.tolist(), many.tolist())]
            coarse = [np.minimum(fold(c, COARSE), FULL).astype(np.uint8).tobytes() for c in counts]
            fp = majority(h, many)
            if len(hot):
                h = h[np.lexsort((h, hot[np.minimum(np.searchsorted(hot, h), len(hot) - 1)] == h, row))]
            first = prefix_lengths(many, similarity)
            keys = h[np.arange(len(h)) - begin[row] < first[row]]
            ends = np.concatenate([[0], np.cumsum(first)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(many), *(pa.array(d.view(np.int64)) for d in digests), pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))), pa.array(counts, pa.binary()), pa.array(coarse, pa.binary()), pa.array(fp.view(np.int64))],
                names=["doc_id", "n", "d0", "d1", "keys", "counts", "coarse", "fp"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, d0 long, d1 long, keys array<long>, counts binary, coarse binary, fp long")


def _rows(reps: DataFrame) -> DataFrame:
    return reps.filter("n > 0").select(F.col("doc_id").alias("id"), F.col("n").cast("int").alias("n"), F.posexplode("keys").alias("pos", "key"))


def hot_shingles(docs: DataFrame, size: int, similarity: float) -> np.ndarray:
    """Hashes that many prefixes in the order of hashes alone hold, sorted."""
    keys = prefixes(docs, size, similarity).select(F.explode("keys").alias("key"))
    counted = keys.groupBy("key").count().filter(F.col("count") > HOT).orderBy(F.desc("count"), "key").limit(MOST_HOT)
    return np.sort(np.array([r.key for r in counted.collect()], np.int64).view(U64))


def _fits(a: str, b: str, similarity: float) -> Column:
    """Whether two sets whose first shared shingle lies at these places can share enough."""
    most = F.least(F.col(f"{a}.n") - F.col(f"{a}.pos"), F.col(f"{b}.n") - F.col(f"{b}.pos"))
    return most >= similarity / (1 + similarity) * (F.col(f"{a}.n") + F.col(f"{b}.n")) - 1e-9


def _pair(a: str, b: str) -> list[Column]:
    return [F.least(f"{a}.id", f"{b}.id").alias("a"), F.greatest(f"{a}.id", f"{b}.id").alias("b")]


def shards(reps: DataFrame) -> DataFrame:
    """key, id, n, pos, many (members): the prefix rows whose shingle several classes hold."""
    x = _rows(reps)
    several = x.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter("many > 1")
    return x.join(several, "key")


def small_pairs(live: DataFrame, similarity: float) -> DataFrame:
    """a < b: all pairs of small shards."""
    low = live.filter(F.col("many") <= SMALL).select("key", "id", "n", "pos")
    both = low.alias("x").join(low.alias("y"), "key").filter("x.id < y.id").filter(_fits("x", "y", similarity))
    return both.select(*_pair("x", "y")).distinct()


def centre(fp: np.ndarray) -> np.ndarray:
    """How far each fingerprint is from the bitwise majority of all."""
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.count_nonzero(bits != (2 * bits.sum(axis=0, dtype=np.int64) > len(fp)), axis=1)


def can_share(x: np.ndarray, y: np.ndarray, n: np.ndarray, coarse: list[bytes], similarity: float) -> np.ndarray:
    """Which pairs of places x and y hold sets that can share enough by their coarse counts."""
    width = np.array([len(c) for c in coarse])
    ok = np.zeros(len(x), bool)
    least = np.minimum(width[x], width[y])
    for w in np.unique(least).tolist():
        table = np.zeros((len(coarse), w), np.int32)
        for i in np.flatnonzero(width >= w).tolist():
            table[i] = fold(coarse[i], w)
        at = np.flatnonzero(least == w)
        for k in range(0, len(at), 16_384):
            i = at[k : k + 16_384]
            shared = np.minimum(table[x[i]], table[y[i]]).sum(axis=1, dtype=np.int64)
            ok[i] = shared * (1 + similarity) >= similarity * (n[x[i]] + n[y[i]]) - 1e-9
    return ok


def open_pairs(members: np.ndarray, coarse: list[bytes], similarity: float, hubs: int | None) -> np.ndarray:
    """Pairs of members (id, n, pos, root, fp, block) of different roots, and of different blocks where there are two: those
    with one of the hubs, the members nearest to the centre (of each block), or, if hubs is None, those that can share
    enough."""
    ids, n, pos, root, fp, block = members.T
    across = block.min() != block.max()
    at = np.arange(len(ids))
    if hubs is not None:
        far = centre(np.ascontiguousarray(fp).view(U64))
        at = np.concatenate([some[np.argsort(far[some], kind="stable")[:hubs]] for b in np.unique(block) for some in [np.flatnonzero(block == b)]])
    out = [np.zeros((0, 2), np.int64)]
    for k in range(0, len(at), 256):
        i = at[k : k + 256]
        some = root[i, None] != root[None, :]
        if across:
            some &= block[i, None] != block[None, :]
        some &= np.minimum((n - pos)[i, None], (n - pos)[None, :]) >= similarity / (1 + similarity) * (n[i, None] + n[None, :]) - 1e-9
        if hubs is None:
            some &= ids[i, None] < ids[None, :]
        x, y = np.nonzero(some)
        x = i[x]
        if hubs is None:
            ok = can_share(x, y, n, coarse, similarity)
            x, y = x[ok], y[ok]
        out.append(np.unique(np.sort(np.stack([ids[x], ids[y]], axis=1), axis=1), axis=0))
    return np.concatenate(out)


def later_pairs(live: DataFrame, classes: DataFrame, roots: DataFrame, similarity: float, hubs: int | None) -> DataFrame:
    """a < b: pairs of larger shards between members that verified pairs don't connect. Shards of several blocks are dealt
    as pairs of blocks."""
    own = classes.select("id", "fp", "coarse" if hubs is None else F.lit(b"").alias("coarse"))
    large = live.filter(F.col("many") > SMALL).select("key", "many", "id", "n", "pos")
    large = large.join(roots, large.id == roots.node, "left").select("key", "many", "id", "n", "pos", F.coalesce("root", "id").alias("root"))
    mixed = large.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
    blocks = F.ceil(F.col("many") / BLOCK)
    large = large.join(mixed, "key").join(own, "id").withColumn("block", F.pmod(F.xxhash64("id"), blocks))
    large = large.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = large.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), F.xxhash64("id", F.lit(1)).alias("rank"), "id", F.col("n").cast("long").alias("n"), F.col("pos").cast("long").alias("pos"), "root", "fp", "block", "coarse")
    dealt = dealt.repartition(shuffle_partitions(live.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi", "rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, coarse = np.zeros((0, 10), np.int64), []
        done = False
        while not done:
            batch = next(batches, None)
            done = batch is None
            if not done:
                held = np.concatenate([held, np.stack([c.to_numpy() for c in batch.columns[:-1]], axis=1)])
                coarse += batch.column("coarse").to_pylist()
            ends = np.flatnonzero(np.any(np.diff(held[:, :3], axis=0) != 0, axis=1)) + 1
            begins = [0, *ends.tolist()]
            if done and len(held):
                ends = np.append(ends, len(held))
            for a, b in zip(begins, ends.tolist()):  # the last shard may go on
                pairs = open_pairs(held[a:b, 4:], coarse[a:b], similarity, hubs)
                for k in range(0, len(pairs), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[k : k + 100_000, c]) for c in (0, 1)], names=["a", "b"])
            at = ends[-1] if len(ends) else 0
            held, coarse = held[at:], coarse[at:]

    return dealt.mapInArrow(run, "a long, b long").filter("a < b").distinct()


def simhash_pairs(classes: DataFrame) -> DataFrame:
    """a < b: classes with equal fingerprints, and those that the SimHash operator links."""
    heads = materialize(classes.filter("n > 0").groupBy("fp").agg(F.min("id").alias("head")), "set-fingerprints")
    near = links(heads.select("fp"), block_masks(RADIUS, heads.count()), RADIUS)
    x, y = (heads.select(F.col("fp").alias(k), F.col("head").alias(f"h{k}")) for k in ("a", "b"))
    near = near.join(x, "a").join(y, "b").select(F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))
    equal = classes.filter("n > 0").join(heads, "fp").filter("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b"))
    return near.union(equal)


def possible(pairs: DataFrame, classes: DataFrame, similarity: float) -> DataFrame:
    """The pairs whose sets can share enough by their range counts."""
    x, y = (classes.select(F.col("id").alias(k), F.col("n").alias(f"n{k}"), F.col("counts").alias(f"c{k}")) for k in ("a", "b"))
    both = pairs.join(x, "a").join(y, "b").filter(F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [most_shared(s, t) * (1 + similarity) >= similarity * n - 1e-9 for s, t, n in zip(b.column("ca").to_pylist(), b.column("cb").to_pylist(), b.column("both").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", (F.col("na") + F.col("nb")).alias("both"), "ca", "cb").mapInArrow(check, "a long, b long")


def joined(reps: DataFrame, classes: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """node, root: the components of the class ids that similar enough pairs connect."""
    live = materialize(shards(reps), "shared-shingles")
    seen = materialize(small_pairs(live, similarity).union(simhash_pairs(classes)).distinct(), "near-pairs")
    likely = materialize(possible(seen, classes, similarity), "likely-pairs")
    good = materialize(verified(likely, docs, size, similarity), "verified-pairs")
    roots = connected(good)
    if live.filter(F.col("many") > SMALL).isEmpty():
        return roots
    for hubs in HUBS:
        fresh = materialize(later_pairs(live, classes, roots, similarity, hubs).join(seen, ["a", "b"], "left_anti"), "near-pairs")
        seen = seen.union(fresh)
        likely = materialize(possible(fresh, classes, similarity), "likely-pairs")
        if likely.isEmpty():
            continue
        more = materialize(verified(likely, docs, size, similarity), "verified-pairs")
        if not more.isEmpty():
            good = good.union(more)
            roots = connected(good)
    return roots


def sets_of(ids: DataFrame, docs: DataFrame, size: int) -> DataFrame:
    """doc_id, s (its sorted shingle hashes) of the documents that ids (column doc_id) names."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in chunks(batches):
            h, many = shingle_sets(*texts_of(b.column("text")), size)
            offsets = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(h.view(np.int64)))], names=["doc_id", "s"])

    sets = docs.select("doc_id", "text").join(ids, "doc_id", "left_semi").mapInArrow(run, "doc_id long, s array<long>")
    return sets.groupBy("doc_id").agg(F.min("s").alias("s"))


def verified(pairs: DataFrame, docs: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs whose exact similarity is large enough."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    sets = materialize(sets_of(ends, docs, size), "shingle-sets")
    both = pairs.join(sets.select(F.col("doc_id").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("doc_id").alias("b"), F.col("s").alias("sb")), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column("sa"), b.column("sb")):
                x, y = (v.values.to_numpy(zero_copy_only=False) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(shared >= similarity * (len(x) + len(y) - shared) and len(x) + len(y) > 0)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(check, "a long, b long")


def groups(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, group_id (the smallest doc_id of its group) of each different doc_id that is not null."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("doc_id is not null")
    prints = materialize(prefixes(docs, size, similarity, hot_shingles(docs, size, similarity)), "shingle-prints")
    names = materialize(prints.groupBy("n", "d0", "d1").agg(F.min("doc_id").alias("id")), "print-classes")
    reps = prints.join(names, ["n", "d0", "d1"]).filter("doc_id = id").drop("id")
    classes = reps.groupBy("doc_id", "n", "d0", "d1").agg(*(F.first(c).alias(c) for c in ("counts", "coarse", "fp")))
    classes = materialize(classes.withColumnRenamed("doc_id", "id").drop("d0", "d1"), "class-counts")
    roots = joined(reps, classes, docs, size, similarity)
    named = names.join(roots, names.id == roots.node, "left").select("n", "d0", "d1", F.coalesce("root", "id").alias("group_id"))
    return prints.join(named, ["n", "d0", "d1"]).groupBy("doc_id").agg(F.min("group_id").alias("group_id"))


def keep_one(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The documents without those that are near copies of one with a smaller doc_id."""
    gone = groups(docs, size, similarity).filter("doc_id <> group_id").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"].cast("long") == gone["gone"], "left_anti")
