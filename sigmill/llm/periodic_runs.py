"""Maximal periodic runs of words, found in tiles that are as large as the periods sought.

Periods fall into octaves [P, 2P), those below eight into one. In an octave every P-th word of a document is a boundary
(below eight every sixth, as a run has twelve words); a run of period q in the
octave has a boundary c with c and c + q inside it, so the Z-function of what follows c (words equal from c and from
c + q on) and that of what precedes it (backwards) give the run, or the part of it within reach. A tile is a stretch of
boundaries with the words within reach of them; tiles overlap, know nothing of each other and are dealt to tasks by
themselves, so a long document is solved by many tasks. Their interval fragments meet again by document and period, where
fragments that share a period's length of words are one run.

Only boundaries behind or before which some window of words occurs again at a distance of the octave are kept (window
hashes, compared with numpy); a run's boundaries all have such a window, so none is lost, and words are compared by exact
ids. A document without such boundaries has no runs and needs no exchange.

Edge cases: null or empty text has no words, no runs and an empty collapsed text; every row is a document of its own, so
repeated rows and null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, shuffle_partitions
from .textops import U64, Words, chunks, mix, texts_of, window_hash

LEAST = 12  # words of a run
_TILE = pa.struct([("octave", pa.int32()), ("tile", pa.int64()), ("first", pa.int64()), ("marks", pa.binary()), ("words", pa.binary())])
_TILES = "array<struct<octave:int,tile:long,first:long,marks:binary,words:binary>>"
RUNS = "array<struct<start:long,period:long,length:long>>"


def scale(octave: int) -> tuple[int, int, int]:
    """First period, period behind the last and words between boundaries: a run has a boundary c with c and c + q in it."""
    return (1, 8, 6) if octave == 0 else (4 << octave, 8 << octave, 4 << octave)


def reach(octave: int) -> int:
    """How far a boundary's comparisons go: fragments of neighbouring boundaries in a run share more than a period."""
    return max(scale(octave)[1], LEAST)


def _window(octave: int) -> int:
    """Words that a run agrees on behind or before each of its boundaries, whichever is more."""
    return 3 if octave == 0 else 2 << octave


def _meets(table: np.ndarray, at: np.ndarray, low: int, high: int) -> np.ndarray:
    """Whether the hash at each place occurs again `low` to high - 1 places on."""
    found = np.zeros(len(at), bool)
    views = np.lib.stride_tricks.sliding_window_view(table, high - low)
    slice_ = max(1, (1 << 21) // high)
    for i in range(0, len(at), slice_):
        a = at[i : i + slice_]
        found[i : i + slice_] = (views[a + low] == table[a][:, None]).any(axis=1)
    return found


def _marked(ids: np.ndarray, row: np.ndarray, begin: np.ndarray, count: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(octave, rows, boundaries within the row) that may lie in a run, octave by octave."""
    longest = int(count.max(initial=0))
    x = mix(ids.astype(U64) * U64(0x9E3779B97F4A7C15) + row.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
    hashes, octave = x, 0
    while max(LEAST, 2 * scale(octave)[0]) <= longest:
        low, high, gap = scale(octave)
        w = _window(octave)
        if octave < 2:
            hashes = window_hash(x, w)
        else:
            hashes = mix(hashes[: -w // 2] * U64(0x9E3779B97F4A7C15) + hashes[w // 2 :]) if len(hashes) > w // 2 else hashes[:0]
        table = np.concatenate([hashes, mix(np.arange(1, len(x) - len(hashes) + 2 * high + 2).astype(U64))])
        long = np.flatnonzero(count >= max(LEAST, 2 * low))
        many = (count[long] - low) // gap + 1
        of = np.repeat(long, many)
        at = (np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)) * gap
        c = begin[of] + at
        hit = _meets(table, c, low, high)
        back = (at >= w) & ~hit
        hit[back] = _meets(table, c[back] - w, low, high)
        if hit.any():
            yield octave, of[hit], at[hit]
        octave += 1


def _cut(docs: DataFrame, keep_text: bool) -> DataFrame:
    """key, doc_id, n_words, sha (null where there are tiles), words (the words with one space between), tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = TaskContext.get().partitionId() << 33
        for b in chunks(batches):
            raw, offsets = texts_of(b.column("text"))
            w = Words(raw, offsets)
            lengths = w.end - w.begin
            ends = np.cumsum(lengths)
            flat = raw[w.inside]
            out = np.full(len(flat) + len(lengths), 32, np.uint8)
            out[np.arange(len(flat)) + np.repeat(np.arange(len(lengths)), lengths)] = flat
            stop = np.concatenate([[0], ends + np.arange(1, len(lengths) + 1)])
            spelled = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(flat)])
            ids = spelled.dictionary_encode().indices.to_numpy().astype(np.int32)
            begin = np.cumsum(w.count) - w.count
            tiles: dict[int, list] = {}
            for octave, rows, at in _marked(ids, w.row, begin, w.count):
                _, high, gap = scale(octave)
                tile = at // (8 * gap)
                cut = np.flatnonzero((np.diff(rows) != 0) | (np.diff(tile) != 0)) + 1
                for i, j in zip([0, *cut], [*cut, len(rows)]):
                    r, n = int(rows[i]), int(w.count[rows[i]])
                    first, last = max(0, int(at[i]) - reach(octave)), min(n, int(at[j - 1]) + high + reach(octave))
                    words = ids[begin[r] + first : begin[r] + last].astype("<i4").tobytes()
                    tiles.setdefault(r, []).append({"octave": octave, "tile": int(tile[i]), "first": first, "marks": (at[i:j] - first).astype("<i4").tobytes(), "words": zstandard.compress(words, 1)})
            shas, words = [], []
            for r in range(b.num_rows):
                a, z = int(stop[begin[r]]), int(stop[begin[r] + w.count[r]])
                text = out[a : max(a, z - 1)].tobytes()
                shas.append(None if r in tiles else hashlib.sha256(text).hexdigest())
                words.append(text if keep_text or r in tiles else None)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(key, key + b.num_rows)), b.column("doc_id"), pa.array(w.count), pa.array(shas, pa.string()), pa.array(words, pa.binary()), pa.array([tiles.get(r, []) for r in range(b.num_rows)], pa.list_(_TILE))],
                names=["key", "doc_id", "n_words", "sha", "words", "tiles"],
            )
            key += b.num_rows

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"key long, doc_id long, n_words long, sha string, words binary, tiles {_TILES}")


def _extent(x: np.ndarray, words: list, a: int, b: int) -> int:
    """How many words from a on equal those from b on (a < b): one by one at first, then by ever longer slices."""
    n, k = len(words), 0
    while k < 16 and b + k < n:
        if words[a + k] != words[b + k]:
            return k
        k += 1
    size = 64
    while b + k < n:
        m = min(size, n - b - k)
        differ = x[a + k : a + k + m] != x[b + k : b + k + m]
        if differ.any():
            return k + int(differ.argmax())
        k, size = k + m, 2 * size
    return k


def z_function(x: np.ndarray, upto: int) -> np.ndarray:
    """How many words from each place before `upto` on equal those from the start on. Only places that hold the first
    word are visited; elsewhere it is 0."""
    upto = min(upto, len(x))
    out = np.zeros(upto, np.int64)
    left = right = 0
    words = x.tolist()
    for i in (np.flatnonzero(x[1:upto] == x[0]) + 1).tolist() if upto > 1 else ():
        k = min(right - i, int(out[i - left])) if i < right else 0
        if i + k >= right:
            k += _extent(x, words, k, i + k)
            left, right = i, i + k
        out[i] = k
    return out


def _primes(n: int) -> list[int]:
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def solve(words: np.ndarray, marks: list[int], octave: int) -> dict[int, list[list[int]]]:
    """Intervals [begin, end) of each smallest period of the octave through the marked boundaries of a tile."""
    far, found = reach(octave), {}
    lowest, high, _ = scale(octave)
    periods = np.arange(lowest, high)
    enough = np.maximum(LEAST, 2 * periods) - periods
    for c in marks:
        top = min(len(words), c + high - 1)
        q = periods[: top - c - lowest + 1]
        ahead = z_function(words[c : top + far], high)
        right = np.zeros(len(q), np.int64)
        right[: len(ahead) - lowest] = np.minimum(ahead[lowest:], far)
        low = max(0, c - far)
        back = words[low:c][::-1]
        both = np.concatenate([back, [-1], words[low:top][::-1]])
        left = z_function(both, len(back) + 2 + top - c - lowest)[len(back) + 1 + top - c - q]
        for k in np.flatnonzero(left + right >= enough[: len(q)]).tolist():
            p, a, z = int(q[k]), c - int(left[k]), c + int(q[k]) + int(right[k])
            if any(ahead[p // f] >= p - p // f for f in _primes(p)):
                continue
            parts = found.setdefault(p, [])
            if parts and a <= parts[-1][1] - p:
                parts[-1][1] = max(parts[-1][1], z)
            else:
                parts.append([a, z])
    return found


def _solve_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: list[list[int]] = [[], [], [], []]
        for key, octave, first, marks, words in zip(*(b.column(c).to_pylist() for c in ("key", "octave", "first", "marks", "words"))):
            ids = np.frombuffer(zstandard.decompress(words), "<i4")
            for q, parts in solve(ids, np.frombuffer(marks, "<i4").tolist(), octave).items():
                for a, z in parts:
                    for column, v in zip(out, (key, q, first + a, first + z)):
                        column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["key", "period", "begin", "end"])


def stitch(fragments: DataFrame) -> DataFrame:
    """key, start, period, length of maximal runs: fragments of a document and period that share at least a period."""
    w = Window.partitionBy("key", "period").orderBy("begin", "end")
    before = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    parts = fragments.withColumn("_new", F.coalesce((F.col("begin") > before - F.col("period")).cast("int"), F.lit(1)))
    parts = parts.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return parts.groupBy("key", "period", "_run").agg(F.min("begin").alias("start"), (F.max("end") - F.min("begin")).alias("length")).select("key", "start", "period", "length")


def _collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of the words when each run keeps its first period only."""
    for b in batches:
        texts = []
        for text, runs, n in zip(b.column("words").to_pylist(), b.column("runs").to_pylist(), b.column("n_words").to_pylist()):
            drop = np.zeros(n + 1, np.int64)
            for r in runs:
                drop[r["start"] + r["period"]] += 1
                drop[r["start"] + r["length"]] -= 1
            gone = np.cumsum(drop)[:n] > 0
            texts.append(b" ".join(x for x, d in zip(text.split(b" "), gone.tolist()) if not d) if gone.any() else text)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_words"), b.column("runs"), pa.array([hashlib.sha256(t).hexdigest() for t in texts]), pa.array(texts, pa.binary()).cast(pa.string())],
            names=["doc_id", "n_words", "runs", "collapsed_sha256", "collapsed"],
        )


def analyse(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_words, runs (start, period, length; by start, then period), collapsed_sha256 and, with keep_text, the
    collapsed text: the words that no run contains behind its first period, one space between them."""
    table = materialize(_cut(docs, keep_text), "period-tiles")
    open_ = table.filter("sha is null")
    tiles = open_.select("key", F.explode("tiles").alias("t")).select("key", "t.*").repartition(shuffle_partitions(docs.sparkSession), "key", "octave", "tile")
    fragments = tiles.mapInArrow(_solve_tiles, "key long, period long, begin long, end long")
    found = stitch(fragments).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    none = F.array().cast(RUNS)
    tiled = open_.drop("tiles", "sha").join(found, "key", "left").withColumn("runs", F.coalesce("runs", none)).select("doc_id", "n_words", "runs", "words")
    tiled = tiled.mapInArrow(_collapse, f"doc_id long, n_words long, runs {RUNS}, collapsed_sha256 string, collapsed string")
    plain = table.filter("sha is not null").select("doc_id", "n_words", none.alias("runs"), F.col("sha").alias("collapsed_sha256"), F.col("words").cast("string").alias("collapsed"))
    out = plain.union(tiled)
    return out if keep_text else out.drop("collapsed")


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """doc_id and text, where every tenth document by crc32 of its doc_id repeats a stretch of its words to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumns({"_g": F.floor(h / 10), "_w": words})
    df = df.withColumn("_n", F.size("_w"))
    a = F.when(F.col("_n") > 0, F.col("_g") % F.col("_n")).cast("int")
    df = df.withColumn("_a", a)
    df = df.withColumn("_p", (1 + F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8))).cast("int"))

    def word(i: Column) -> Column:
        return F.get("_w", F.when(i >= F.col("_a"), F.col("_a") + (i - F.col("_a")) % F.col("_p")).otherwise(i))

    text = F.array_join(F.transform(F.sequence(F.lit(0), F.col("_n") - 1), word), " ")
    return df.select("doc_id", F.when(F.col("_a").isNotNull(), text).otherwise(F.col("text")).alias("text"))


def digests(docs: DataFrame) -> DataFrame:
    """One row a document: the runs of its text with the periodic tail, and digests of them and of the collapsed text."""
    df = analyse(with_periodic_tails(docs))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    df = df.withColumn("_b", best)
    line = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    return df.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_b.s")).alias("start"), F.col("_b.n").alias("length"), (-F.col("_b.p")).alias("period"),
        F.expr("(1000 * _b.n) div (-_b.p)").alias("exponent_milli"), F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256",
    )
