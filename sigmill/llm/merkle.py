"""A Merkle manifest of a table: a tree of fanout eight for each language, and one over the languages' roots.

Rows are numbered within their language by a range sort (each partition numbers its own rows, the few counts of partitions
give the offsets). Blocks of 8^4 consecutive leaves, aligned to the tree, are the partitions of the exchange; a block
hashes its own four levels. Above them, blocks meet in a butterfly: in round r a block meets the blocks whose number
differs from its own in the r-th octal digit alone, at most eight, each of which brings the root of its subtree of 8^r
blocks. All of them hash the parent, redundantly, and note the other seven as a level of their proof; after the last round
each block has all that its leaves' proofs need, and nothing is sent down the tree. Where the last subtree of a level has
too few blocks, those that it has stand in for the missing ones, in turn. The languages' roots climb in the same way.

Edge cases: a null doc_id comes first and is never tampered with; rows of equal doc_id are ordered by their leaf; repeated
rows are leaves each; a null language is a language and comes first; missing columns count as null; a lone leaf is its
language's root; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions

FANOUT = 8
LEVELS = 4  # of a block of leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_hash(fields: list[Column]) -> Column:
    """SHA-256 of each field's byte count, a colon and the field, or `-` where it is null."""
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields)).cast("binary"), 256)


def leaves(docs: DataFrame) -> DataFrame:
    """grp (the language as a key: null first, then bytewise), doc_id, leaf, and tampered: the leaf after every third
    document by crc32 of its doc_id was lower-cased."""
    have = {c: F.col(f"`{c}`").cast("string") if c in docs.columns else F.lit(None).cast("string") for c in FIELDS}
    rows = docs.select(*(c.alias(n) for n, c in have.items()))
    other = F.when(F.crc32(F.col("doc_id").cast("binary")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    lower = [F.col(n) for n in FIELDS[:-1]] + [other]
    changed = F.coalesce(other != F.col("text"), F.lit(False))
    out = rows.select(F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")).alias("grp"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash([F.col(n) for n in FIELDS]).alias("leaf"), F.when(changed, leaf_hash(lower)).alias("tampered"))
    return out.withColumn("tie", F.monotonically_increasing_id())


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds part (the partition) and place, the row's number within its group in this sorted partition."""
    part, last, seen = TaskContext.get().partitionId(), None, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        g = b.column("grp")
        first = np.flatnonzero(pc.not_equal(g[1:], g[:-1]).to_numpy(zero_copy_only=False)) + 1
        start = np.zeros(n, np.int64)
        start[first] = first
        place = np.arange(n) - np.maximum.accumulate(start)
        stop = int(first[0]) if len(first) else n
        if g[0].as_py() == last:
            place[:stop] += seen
        last, seen = g[n - 1].as_py(), int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(n, part, np.int64)), pa.array(place)], names=[*b.schema.names, "part", "place"])


def numbered(df: DataFrame, order: list[str], name: str) -> DataFrame:
    """Adds i, the row's number within its group `grp` by `order`, and n, the group's size. What is added up has a row for
    each partition and group."""
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), "grp", *order).sortWithinPartitions("grp", *order)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    placed = materialize(ranges.mapInArrow(_number, f"{kinds}, part long, place long"), name)
    w = Window.partitionBy("grp").orderBy("part")
    counts = placed.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("_k"))
    counts = counts.select("grp", "part", (F.sum("_k").over(w) - F.col("_k")).alias("_base"), F.sum("_k").over(Window.partitionBy("grp")).alias("n"))
    return placed.join(counts, ["grp", "part"]).withColumn("i", F.col("_base") + F.col("place")).drop("part", "place", "_base")


def parents(nodes: list[str]) -> list[str]:
    return [sha256("".join(nodes[k : k + FANOUT]).encode()).hexdigest() for k in range(0, len(nodes), FANOUT)]


def local_levels(nodes: list[str], whole: int, most: int) -> list[list[str]]:
    """At most `most` levels above a block's leaves, up to its root; `whole` leaves are in the tree, which may be this block."""
    levels = [nodes]
    while len(levels) <= most and whole > 1:
        levels.append(parents(levels[-1]))
        whole = -(-whole // FANOUT)
    return levels


def _block_root(levels: int) -> Callable[[pa.Table], pa.Table]:
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        n = group.column("n")[0].as_py()
        root = local_levels(group.column("leaf").to_pylist(), n, levels)[-1][0]
        return pa.table({"grp": group.column("grp").slice(0, 1), "b": group.column("b").slice(0, 1), "m": [-(-n // FANOUT**levels)], "node": [root]})

    return run


def climb(state: DataFrame, most: int) -> DataFrame:
    """The butterfly. state has grp, b (0 to m - 1), m and node; the result has each tree's root in node, and in left and
    right what stands before and behind at each level. `most` is the largest m."""
    empty = F.array().cast("array<string>")
    state = state.withColumns({"left": empty, "right": empty})
    width = 1
    while width < most:
        children = F.ceil(F.col("m") / width)
        child, low = F.floor(F.col("b") / width), F.col("b") % width
        there = F.col("m") - (children - 1) * width  # blocks of the last child
        alone = (child < children - 1) | (child % FANOUT == 0) | (low + there >= width)
        lows = F.when(alone, F.array(low)).otherwise(F.sequence(low, F.lit(width - 1).cast("long"), there))
        met = state.select("*", child.alias("_c"), low.alias("_own"), F.explode(lows).alias("_low"))
        group = Window.partitionBy("grp", F.floor(F.col("_c") / FANOUT), "_low")
        met = met.withColumn("_kids", F.sort_array(F.collect_list(F.struct("_c", "node")).over(group))).filter("_low = _own")
        side = lambda keep: F.array_join(F.transform(F.filter("_kids", keep), lambda k: k["node"]), "")
        more = F.col("m") > width
        whole = F.sha2(F.array_join(F.transform("_kids", lambda k: k["node"]), "").cast("binary"), 256)
        state = met.select(
            "grp", "b", "m", F.when(more, whole).otherwise(F.col("node")).alias("node"),
            F.when(more, F.array_append("left", side(lambda k: k["_c"] < F.col("_c")))).otherwise(F.col("left")).alias("left"),
            F.when(more, F.array_append("right", side(lambda k: k["_c"] > F.col("_c")))).otherwise(F.col("right")).alias("right"),
        )
        width *= FANOUT
    return state


def fold(leaf: str, steps: list[tuple[str, str]]) -> str:
    """The root that a leaf and what stands before and behind its ancestors lead to."""
    for before, behind in steps:
        leaf = sha256(f"{before}{leaf}{behind}".encode()).hexdigest()
    return leaf


def _prove(proofs: bool, height: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(group: pa.Table, upper: pa.Table) -> pa.Table:
        group = group.sort_by("i")
        above = upper.to_pylist()[0]
        leaf, tampered = group.column("leaf").to_pylist(), group.column("tampered").to_pylist()
        levels = local_levels(leaf, group.column("n")[0].as_py(), height)[:-1]
        steps_above = list(zip(above["left"], above["right"]))
        digests, folded, told = [], [], []
        for j, (own, other) in enumerate(zip(leaf, tampered)):
            steps, at = [], j
            for nodes in levels:
                begin = at - at % FANOUT
                steps.append(("".join(nodes[begin:at]), "".join(nodes[at + 1 : begin + FANOUT])))
                at //= FANOUT
            steps += steps_above
            digests.append(sha256("".join(a + z for a, z in steps).encode()).hexdigest())
            folded.append(fold(own if other is None else other, steps))
            told.append([{"left": a, "right": z} for a, z in steps] if proofs else None)
        k, root = len(leaf), above["root"]
        out = {
            "doc_id": group.column("doc_id"), "leaf": group.column("leaf"), "subroot": pa.array([above["subroot"]] * k), "root": pa.array([root] * k), "proof_sha256": pa.array(digests),
            "folded_root": pa.array(folded), "verified": pa.array([f == root for f in folded]),
        }
        if proofs:
            out["proof"] = pa.array(told, pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
        return pa.table(out)

    return run


def manifest(docs: DataFrame, proofs: bool = False, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (from the tampered leaf, if it was), verified; with `proofs`
    also the proof itself, (left, right) by level."""
    rows = numbered(materialize(leaves(docs), "merkle-leaves"), ["doc_id", "leaf", "tie"], "merkle-rows").withColumn("b", F.floor(F.col("i") / FANOUT**levels)).drop("tie")
    roots = rows.select("grp", "b", "i", "n", "leaf").groupBy("grp", "b").applyInArrow(_block_root(levels), "grp string, b long, m long, node string")
    roots = materialize(roots, "merkle-blocks")
    most, languages = roots.agg(F.max("m"), F.countDistinct("grp")).first()
    blocks = materialize(climb(roots, most or 0).withColumnRenamed("node", "subroot"), "merkle-paths")
    tops = numbered(blocks.filter("b = 0").select(F.lit("").alias("grp"), F.col("grp").alias("own"), F.col("subroot").alias("node")), ["own"], "merkle-languages")
    names = tops.select(F.col("i").alias("b"), "own")
    tops = climb(tops.select("grp", F.col("i").alias("b"), F.col("n").alias("m"), "node"), languages or 0)
    tops = tops.join(names, "b").select(F.col("own").alias("grp"), F.col("node").alias("root"), F.col("left").alias("_l"), F.col("right").alias("_r"))
    upper = blocks.join(tops, "grp").select("grp", "b", "subroot", "root", F.concat("left", "_l").alias("left"), F.concat("right", "_r").alias("right"))
    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    if proofs:
        kinds += ", proof array<struct<left:string,right:string>>"
    return rows.groupBy("grp", "b").cogroup(upper.groupBy("grp", "b")).applyInArrow(_prove(proofs, levels), kinds)
