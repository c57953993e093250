"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root: the smallest node reachable from each node that has an edge. edges: columns a, b (long).

    Each round is a few hash joins and partial aggregations over the edges; the edge count never grows by more than the
    nodes, a hub's neighbours are spread by the join's skew handling, and nothing is collected but a row count and a
    checksum. Rounds grow with the logarithm of the longest chain. Null ends and self-edges are ignored."""
    now = materialize(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    seen = _mark(now)
    for _ in range(most_rounds):
        both = now.union(now.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = materialize(small.select("e.u", "e.v").filter("u <> v").distinct(), "edges")
        mark = _mark(now)
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v")).distinct())
        seen = mark
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
