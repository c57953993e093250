"""Approximate nearest neighbours by cosine with balanced posting lists.

Equal vectors are one entry with their smallest ids, so a vector that a third of all rows share is compared once. The
entries are dealt to clusters of balanced size (bisecting 2-means that split at the median, on a bounded sample);
an entry near a boundary is replicated to the clusters that are nearly as close as its nearest one, but not behind a
cluster it already has (the relative-neighbourhood rule). The centroids, of bounded number, are held in memory as a
neighbour graph that a beam search walks, for the placing of entries and for queries. A query visits every list whose
centroid passes a distance-ratio test against its nearest centroid, however many they are: the beam is widened until the
farthest centroid found fails the test. Lists are joined with the queries that visit them in slices of bounded size, and
the best of each slice are merged in Spark.

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts take no part; vectors are compared with
those of their own length (each length has an index of its own); repeated rows count as one candidate each, except rows of
one vec_id, which count once; null ids take no part; ties go to the smaller vec_id; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .shared import materialize, shuffle_partitions

SAMPLE = 20_000  # entries that clusters are fitted on
MOST_CLUSTERS = 4_096  # bounds the centroids that every task holds
LIST_SIZE = 150  # entries of a list, before replication, as long as MOST_CLUSTERS allows it
SLICE = 4_096  # entries of a list that one comparison takes
NEIGHBOURS = 16
BEAM = 48
RATIO = 1.2  # lists are visited up to this multiple of the nearest centroid's distance
CELLS = 1 << 16  # centroids that the queries of one search hold in their beams


def clusters(sample: np.ndarray, count: int, seed: int = 7) -> np.ndarray:
    """Unit centroids of `count` clusters of equal size (within one): each split is at the median along the line of a
    2-means fit."""
    rng = np.random.RandomState(seed)
    stack, out = [(np.arange(len(sample)), count)], []
    while stack:
        rows, k = stack.pop()
        x = sample[rows]
        if k <= 1 or len(rows) < 2:
            c = x.mean(axis=0)
            out.append(c / max(np.linalg.norm(c), 1e-12))
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(6):
            left = x @ (a - b) > 0
            if left.all() or not left.any():
                break
            a, b = x[left].mean(axis=0), x[~left].mean(axis=0)
        order = np.argsort(x @ (a - b), kind="stable")
        cut = len(rows) * (k // 2) // k
        stack += [(rows[order[:cut]], k // 2), (rows[order[cut:]], k - k // 2)]
    return np.array(out)


class Graph:
    """Neighbour graph of the centroids; a beam search from a few entry points walks it for many vectors at once."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids.astype(np.float32)
        n = len(centroids)
        near = min(NEIGHBOURS, n - 1)
        links = np.zeros((n, max(near, 1)), np.int32)
        for a in range(0, n if near else 0, 512):
            s = self.centroids[a : a + 512] @ self.centroids.T
            s[np.arange(len(s)), np.arange(a, a + len(s))] = -2
            links[a : a + 512] = np.argsort(-s, axis=1, kind="stable")[:, :near]
        if near:  # a link to a far centroid keeps the graph together
            links = np.concatenate([links, ((np.arange(n) * 7919 + 1) % n)[:, None].astype(np.int32)], axis=1)
        self.links = links
        self.entries = np.unique(np.linspace(0, n - 1, min(n, BEAM)).astype(np.int32))

    def search(self, x: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids found and their cosines, nearest first, for each row of unit vectors."""
        x = x.astype(np.float32)
        n, width = len(x), max(want, min(BEAM, len(self.centroids)))
        steps = max(4, width // 16)
        ids = np.tile(self.entries, (n, 1))
        score = x @ self.centroids[self.entries].T
        seen = np.zeros((n, len(self.centroids)), bool)
        seen[:, self.entries] = True
        opened = np.zeros_like(seen)
        rows = np.arange(n)[:, None]
        while True:
            order = np.argsort(-score, axis=1, kind="stable")[:, :width]
            ids, score = ids[rows, order], score[rows, order]
            waiting = ~opened[rows, ids] & (score > -2)
            if not waiting.any():
                return ids[:, :want], score[:, :want]
            # open the best that wait
            pick = np.argsort(~waiting, axis=1, kind="stable")[:, :steps]
            chosen = ids[rows, pick]
            live = waiting[rows, pick]
            opened[np.repeat(np.arange(n), pick.shape[1])[live.ravel()], chosen[live]] = True
            fresh = self.links[chosen].reshape(n, -1)
            new = ~seen[rows, fresh] & np.repeat(live, self.links.shape[1], axis=1)
            s = np.einsum("nkd,nd->nk", self.centroids[fresh], x)
            s[~new] = -3
            # the same centroid may be fresh by two ways: keep its first place
            order = np.argsort(fresh, axis=1, kind="stable")
            f = fresh[rows, order]
            again = np.zeros_like(new)
            again[:, 1:] = (f[:, 1:] == f[:, :-1]) & new[rows, order][:, 1:] & new[rows, order][:, :-1]
            undo = np.empty_like(again)
            undo[rows, order] = again
            s[undo] = -3
            seen[np.repeat(np.arange(n), fresh.shape[1])[new.ravel()], fresh[new]] = True
            ids, score = np.concatenate([ids, fresh], axis=1), np.concatenate([score, s], axis=1)


def distances(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * cosines, 0))


class Router:
    """Which lists an entry belongs to, and which a query visits."""

    def __init__(self, centroids: np.ndarray, closure: float = 1.15, replicas: int = 6, ratio: float = RATIO, least: int = 8):
        self.graph = Graph(centroids)
        self.closure, self.replicas, self.ratio, self.least = closure, replicas, ratio, least

    def lists(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and cluster of each placement."""
        ids, cos = self.graph.search(x, min(2 * self.replicas, len(self.graph.centroids)))
        d = distances(cos)
        keep = d <= self.closure * d[:, :1] + 1e-9
        keep &= cos > -2
        c = self.graph.centroids
        for k in range(1, keep.shape[1]):
            # not behind a nearer list that the entry already has
            for j in range(k):
                both = keep[:, k] & keep[:, j]
                between = distances(np.einsum("nd,nd->n", c[ids[:, k]], c[ids[:, j]]))
                keep[:, k] &= ~(both & (between < 0.6 * d[:, k]))
        keep &= np.cumsum(keep, axis=1) <= self.replicas
        keep[:, 0] = True
        row, k = np.nonzero(keep)
        return row, ids[row, k]

    def visited(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and cluster of each visit: all lists within the distance ratio, and at least `least`."""
        n = len(self.graph.centroids)
        want, rows, lists = 2 * self.least, [], []
        open_rows = np.arange(len(x))
        while len(open_rows):
            want = min(4 * want, n)
            block = max(1, CELLS // want)
            left = []
            for a in range(0, len(open_rows), block):
                at = open_rows[a : a + block]
                ids, cos = self.graph.search(x[at], want)
                d = distances(cos)
                keep = (d <= self.ratio * d[:, :1] + 1e-9) & (cos > -2)
                keep[:, : self.least] = cos[:, : self.least] > -2
                # the farthest found passes the test, so others may
                more = keep[:, -1] if want < n else np.zeros(len(at), bool)
                left.append(at[more])
                row, k = np.nonzero(keep & ~more[:, None])
                rows.append(at[row])
                lists.append(ids[row, k])
            open_rows = np.concatenate(left)
        return np.concatenate([np.zeros(0, np.int64), *rows]), np.concatenate([np.zeros(0, np.int32), *lists])


def _numbers(vectors: DataFrame, column: str) -> Column:
    """The vectors as they are, if of floats, or else of doubles."""
    kind = vectors.schema[column].dataType
    return F.col(column) if kind in (ArrayType(FloatType()), ArrayType(FloatType(), False)) else F.col(column).cast("array<double>")


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """id, vec of the rows that take part."""
    v = vectors.select(F.col(id_column).cast("long").alias("id"), _numbers(vectors, vector_column).alias("vec"))
    finite = ~F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.filter(F.col("id").isNotNull() & F.col("vec").isNotNull()).filter(finite).filter(F.exists("vec", lambda x: x != 0))


def entries(v: DataFrame, keep: int) -> DataFrame:
    """class_id (the smallest id), vec, ids (its `keep` smallest ids, sorted)."""
    by = Window.partitionBy("vec").orderBy("id")
    first = v.distinct().withColumn("k", F.row_number().over(by)).filter(F.col("k") <= keep)  # limited before the shuffle
    return first.groupBy("vec").agg(F.min("id").alias("class_id"), F.sort_array(F.collect_list("id")).alias("ids"))


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _compare(k: int):
    def run(key: tuple, queries: pd.DataFrame, listed: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(queries) and len(listed):
            y, ids = np.stack(listed["vec"]).astype(float), listed["ids"].to_numpy()
            classes = listed["class_id"].to_numpy()
            yn = np.linalg.norm(y, axis=1)
            for a in range(0, len(queries), 256):
                q = queries.iloc[a : a + 256]
                x = np.stack(q["vec"]).astype(float)
                s = np.clip((x @ y.T) / (np.linalg.norm(x, axis=1)[:, None] * yn[None]), -1, 1)
                top = min(k + 1, len(y))
                for i, (c, row) in enumerate(zip(q["class_id"].to_numpy(), s)):
                    least = np.partition(row, len(row) - top)[len(row) - top]
                    best = np.flatnonzero(row >= least)
                    if len(best) > top:  # ties at the end: the smaller ids
                        best = best[np.lexsort((classes[best], -row[best]))[:top]]
                    out += [(c, float(row[j]), classes[j], ids[j]) for j in best]
        return pd.DataFrame(out, columns=["query", "score", "class_id", "ids"])

    return run


def search(vectors: DataFrame, is_query, k: int = 5, id_column: str = "vec_id", vector_column: str = "embedding", list_size: int = LIST_SIZE, ratio: float = RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row for which is_query (a condition on query_id) holds."""
    v = usable(vectors, id_column, vector_column)
    lengths = sorted(r[0] for r in v.select(F.size("vec")).distinct().collect())
    if not lengths:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    found = [_search(v.filter(F.size("vec") == F.lit(size)), is_query, k, list_size, ratio) for size in lengths]
    return reduce(DataFrame.unionAll, found)


def _search(v: DataFrame, is_query, k: int, list_size: int, ratio: float) -> DataFrame:
    """The search among vectors of one length."""
    spark = v.sparkSession
    table = materialize(entries(v, k + 1), "vector-entries")
    total = table.count()
    sample = table.orderBy(F.xxhash64("class_id"), "class_id").limit(SAMPLE).select("vec").toPandas()
    x = _unit(np.stack(sample["vec"]).astype(float))
    router = Router(clusters(x, max(1, min(MOST_CLUSTERS, total // list_size, len(x) // 4))), ratio=ratio)
    kind = table.schema["vec"].dataType.simpleString()

    def route(which: str, *kept: str):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for a in range(0, batch.num_rows, 1024):
                    b = batch.slice(a, 1024)
                    row, cluster = getattr(router, which)(_unit(_matrix(b.column("vec"))))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(cluster.astype(np.int32)), *(b.column(c).take(at) for c in kept)], names=["cluster", *kept])

        return run

    n = shuffle_partitions(spark)
    placed = table.select("class_id", "vec", "ids").mapInArrow(route("lists", "class_id", "vec", "ids"), f"cluster int, class_id long, vec {kind}, ids array<long>")
    placed = materialize(placed, "posting-lists")
    slices = placed.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / SLICE).cast("int").alias("slices"))  # at most MOST_CLUSTERS rows
    placed = placed.join(F.broadcast(slices), "cluster").withColumn("slice", F.pmod(F.xxhash64("class_id"), F.col("slices")).cast("int")).drop("slices")

    asked = v.select(F.col("id").alias("query_id"), "vec").filter(is_query).distinct()
    asked = materialize(asked.join(table.select("class_id", "vec"), "vec").select("query_id", "class_id"), "queries")
    query_classes = table.join(asked.select("class_id").distinct(), "class_id").select("class_id", "vec")
    visits = query_classes.mapInArrow(route("visited", "class_id", "vec"), f"cluster int, class_id long, vec {kind}")
    parts = slices.select(F.col("cluster").alias("c"), F.col("slices").alias("parts"))
    visits = visits.join(F.broadcast(parts), F.col("cluster") == F.col("c")).select("cluster", "class_id", "vec", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("slice"))
    hits = visits.groupBy("cluster", "slice").cogroup(placed.groupBy("cluster", "slice")).applyInPandas(_compare(k), "query long, score double, class_id long, ids array<long>")
    best = hits.groupBy("query", "class_id").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    by = Window.partitionBy("query").orderBy(F.desc("score"), "class_id")
    best = best.withColumn("k", F.row_number().over(by)).filter(F.col("k") <= k + 1)
    best = best.groupBy("query").agg(F.collect_list(F.struct((-F.col("score")).alias("s"), "ids")).alias("found"))
    # each class gives its k + 1 smallest ids; a query leaves its own out, orders by score and id and keeps k
    flat = F.flatten(F.transform("found", lambda f: F.transform(f["ids"], lambda i: F.struct(f["s"].alias("s"), i.alias("id")))))
    answers = asked.join(best, asked.class_id == best["query"]).select("query_id", flat.alias("flat"))
    mine = F.slice(F.array_sort(F.filter("flat", lambda f: f["id"] != F.col("query_id"))), 1, k)
    return answers.select("query_id", F.posexplode(mine).alias("rank", "f")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("f.id").alias("vec_id"), (-F.col("f.s")).alias("score"))
