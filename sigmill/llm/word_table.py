"""Byte-level BPE through a table of distinct words.

Texts are split into words at places where the vocabulary's own splitting always ends a token, whatever stands around
them, so that a word's ids do not depend on its text. A block of documents is kept as its different words and, for every
document, the places of its words among them. A block's words are dealt in cells by their hash; a task gets all blocks'
cells of a deal, finds their different words, and the tokenizer encodes each of them once. The ids return to their block by
place and are laid out by position. The blocks are a table bucketed by block, so what is long, the places, is written once
and never exchanged; a block has a word once, so no word has more rows than there are blocks.

Ids are decoded by a join with the id-to-piece table, which has a row for each id of the vocabulary, whatever the corpus, and
is broadcast. A round trip joins the ids of each different word once and lays the decoded words out by position, as it does
with the ids; `decode` joins any ids: they are exploded, and the pieces of a row stay neighbours and in order.

The splitting rules hold for the byte-level pattern of the public vocabularies (contractions, letters, numbers, others, white
space). Text of the special tokens is a word of its own, as in the tokenizers library; what stands before it ends there.

Edge cases: null or empty text has no ids and decodes to an empty text; every row is a document of its own, so repeated rows
and null doc_ids are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, shuffle_partitions
from .textops import CHUNK_BYTES, chunks, prefix_hash, span_hash, texts_of

BLOCK_BYTES = 16 << 20
_CELL = pa.struct([("deal", pa.int32()), ("first", pa.int32()), ("lengths", pa.binary()), ("words", pa.binary())])
_LETTER, _DIGIT, _OTHER, _SPACE, _WHITE = 1, 2, 3, 4, 5

_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _OTHER
_KIND[48:58] = _DIGIT
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[32], _KIND[9:14] = _SPACE, _WHITE
#: First bytes of characters that are white space in no version of Unicode.
_DARK = (_KIND > 0) & (_KIND < _SPACE)
_DARK[0xC3:0xE0] = _DARK[0xE4:0xF5] = True


def vocabulary_file(vocabulary: str | None) -> str:
    import public_tokenizers

    return vocabulary or public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=1)
def tokenizer(vocabulary: str | None = None):
    """The library's tokenizer, without truncation and padding, one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary_file(vocabulary))
    t.no_truncation()
    t.no_padding()
    return t


def special_tokens(t) -> list[bytes]:
    return [a.content.encode() for a in t.get_added_tokens_decoder().values()]


def word_starts(raw: np.ndarray, offsets: np.ndarray, special: list[bytes]) -> np.ndarray:
    """Where words begin in the bytes of several texts."""
    n = len(raw)
    kind = _KIND[raw]
    lead = np.flatnonzero(raw[:-1] == 0xC3) if n else np.zeros(0, int)
    lead = lead[(raw[lead + 1] != 0x97) & (raw[lead + 1] != 0xB7)]  # letters with accents
    kind[lead] = kind[lead + 1] = _LETTER
    dark = _DARK[raw]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    spots = []
    blob = raw.tobytes()
    for token in special:
        k = blob.find(token)
        while k >= 0:
            if not first[k + 1 : k + len(token)].any():
                spots.append((k, k + len(token)))
                dark[k] = False
            k = blob.find(token, k + 1)
    plain = (kind > 0) & (kind < _SPACE)
    start = first[:n].copy()
    if n > 1:
        a, b = kind[:-1], kind[1:]
        turn = plain[:-1] & plain[1:] & (a != b) & ~((a == _OTHER) & (b == _LETTER) & (raw[:-1] == 39))
        start[1:] |= turn | (plain[:-1] & (b >= _SPACE))
        start[:-1] |= (a == _SPACE) & dark[1:] & ~first[1:n]
        start[2:] |= plain[:-2] & (kind[1:-1] == _WHITE) & dark[2:] & ~first[1 : n - 1]
    for k, z in spots:
        start[k : z] = False
        start[k] = True
        if z < n:
            start[z] = True
    return np.flatnonzero(start)


def _spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column and where its rows begin and end in them."""
    raw, offsets = texts_of(column) if len(column) else (np.zeros(0, np.uint8), np.zeros(1, np.int64))
    return raw, np.array(offsets, np.int64)


def _pack(places: np.ndarray) -> bytes:
    """32-bit numbers, byte by byte of equal weight."""
    return zstandard.compress(np.ascontiguousarray(places.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def _unpack(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


def _blocks(special: list[bytes], most: int, deals: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        ids, sizes, coded, held = [], [], [], 0

        def finish() -> pa.RecordBatch:
            parts = pa.chunked_array(coded, pa.dictionary(pa.int32(), pa.large_binary())).unify_dictionaries().chunks
            words = parts[0].dictionary
            raw, at = _spans(words)
            deal = (span_hash(prefix_hash(raw), at[:-1], at[1:]) % np.uint64(deals)).astype(np.int64)
            order = pc.sort_indices(words).to_numpy().astype(np.int64)
            order = order[np.argsort(deal[order], kind="stable")]
            rank = np.empty(len(words), np.int32)
            rank[order] = np.arange(len(words))
            places = np.concatenate([rank[p.indices.to_numpy()] for p in parts])
            some, first = np.unique(deal[order], return_index=True)
            raw, at = _spans(words.take(pa.array(order)))
            ends = [*first[1:].tolist(), len(words)]
            cells = [{"deal": int(d), "first": i, "lengths": _pack(np.diff(at[i : j + 1])), "words": zstandard.compress(raw[at[i] : at[j]].tobytes(), 3)} for d, i, j in zip(some, first.tolist(), ends)]
            docs = pa.concat_arrays(ids)
            return pa.RecordBatch.from_arrays(
                [pa.array([block]), pa.ListArray.from_arrays([0, len(docs)], docs), pa.array([np.concatenate(sizes)], pa.list_(pa.int64())), pa.array([_pack(places)], pa.binary()), pa.array([cells], pa.list_(_CELL))],
                names=["block", "doc_ids", "sizes", "places", "cells"],
            )

        for b in chunks(batches, most=min(CHUNK_BYTES, most)):
            raw, offsets = texts_of(b.column("text"))
            starts = word_starts(raw, offsets, special)
            ends = np.concatenate([starts, [len(raw)]]).astype(np.int64)
            words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(raw))])
            coded.append(words.dictionary_encode())
            ids.append(b.column("doc_id"))
            sizes.append(np.diff(np.searchsorted(starts, offsets)))
            held += len(raw)
            if held >= most:
                yield finish()
                ids, sizes, coded, held = [], [], [], 0
                block += 1
        if ids:
            yield finish()

    return run


def split(docs: DataFrame, vocabulary: str | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """A row a block: block, doc_ids, sizes (words of each document), places (of all their words among the different ones),
    cells (deal, place of its first word, lengths, words). Written to the shared folder as a table bucketed by block."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "block long, doc_ids array<long>, sizes array<long>, places binary, cells array<struct<deal:int,first:int,lengths:binary,words:binary>>"
    blocks = rows.mapInArrow(_blocks(special_tokens(tokenizer(vocabulary)), most, 2 * shuffle_partitions(spark)), kinds)
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    blocks.write.format("parquet").option("path", new_path(spark, "bpe-blocks")).option("compression", "zstd").bucketBy(shuffle_partitions(spark), "block").saveAsTable(name)
    return spark.table(name)


def _laid(flat: np.ndarray, at: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of `flat` at the places one behind the other, and where they begin and end."""
    many = np.diff(at)[places]
    ends = np.concatenate([[0], np.cumsum(many)])
    return flat[np.repeat(at[places] - ends[:-1], many) + np.arange(ends[-1])], ends


def joined_words(cells: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of several cells' values, one behind the other, and where each begins and ends."""
    many = [_unpack(sizes) for sizes, _ in cells]
    raw = b"".join(zstandard.decompress(blob) for _, blob in cells)
    return np.frombuffer(raw, np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(many) if many else [])]).astype(np.int64)


def _encode(vocabulary: str | None, pieces):
    """The cells of a deal to the same cells with ids and decoded words; each different word is encoded and decoded once."""

    def run(deal: pa.Table) -> pa.Table:
        t = tokenizer(vocabulary)
        raw, at = joined_words(list(zip(deal.column("lengths").to_pylist(), deal.column("words").to_pylist())))
        coded = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at), pa.py_buffer(raw)]).dictionary_encode()
        words, flat, many = coded.dictionary, [np.zeros(0, np.int32)], []
        for i in range(0, len(words), 10_000):
            found = [e.ids for e in t.encode_batch_fast([w.decode() for w in words.slice(i, 10_000).to_pylist()], add_special_tokens=False)]
            many += map(len, found)
            flat.append(np.array([k for ids in found for k in ids], np.int32))
        ids, begins = np.concatenate(flat), np.concatenate([[0], np.cumsum(many)]).astype(np.int64)
        spelled, ends = _spans(pieces.value.take(pa.array(ids)))  # row k of the table is the piece of id k
        ends = ends[begins]
        of, start, out = coded.indices.to_numpy(), 0, []
        for sizes in deal.column("lengths").to_pylist():
            mine = of[start : start + len(_unpack(sizes))]
            start += len(mine)
            (a, i), (b, j) = _laid(ids, begins, mine), _laid(spelled, ends, mine)
            out.append((_pack(np.diff(i)), _pack(a), _pack(np.diff(j)), zstandard.compress(b.tobytes(), 3)))
        blobs = [pa.array(c, pa.binary()) for c in zip(*out)]
        return pa.table([deal.column("block"), deal.column("first"), *blobs], names=["block", "first", "widths", "ids", "lengths", "text"])

    return run


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with their cells' ids and decoded words to documents, a bounded number of words at a time."""
    for b in batches:
        for k in range(b.num_rows):
            row = {c: b.column(c)[k].as_py() for c in ("doc_ids", "sizes", "places", "filled")}
            filled = sorted(row["filled"] or [], key=lambda c: c["first"])
            many = [_unpack(c["widths"]) for c in filled]
            at = np.concatenate([[0], np.cumsum(np.concatenate(many) if many else [])]).astype(np.int64)
            ids = np.concatenate([np.zeros(0, np.int32), *(_unpack(c["ids"]).astype(np.int32) for c in filled)])
            text, ends = joined_words([(c["lengths"], c["text"]) for c in filled])
            places, stops = _unpack(row["places"]), np.concatenate([[0], np.cumsum(row["sizes"])]).astype(np.int64)
            i = 0
            while i < len(stops) - 1:
                j = max(i + 1, int(np.searchsorted(stops, stops[i] + (1 << 18), side="right")) - 1)
                p = places[stops[i] : stops[j]]
                mine, spelled = _laid(ids, at, p), _laid(text, ends, p)
                inner = stops[i : j + 1] - stops[i]
                tokens = pa.LargeListArray.from_arrays(pa.array(mine[1][inner]), pa.array(mine[0])).cast(pa.list_(pa.int32()))
                texts = pa.Array.from_buffers(pa.large_string(), j - i, [None, pa.py_buffer(spelled[1][inner]), pa.py_buffer(spelled[0])]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"][i:j], pa.int64()), tokens, texts], names=["doc_id", "ids", "text"])
                i = j


def round_trip(docs: DataFrame, vocabulary: str | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids as the tokenizers library encodes each whole text without special tokens added, and text as decoded."""
    spark = docs.sparkSession
    blocks = split(docs, vocabulary, most)
    pieces = spark.sparkContext.broadcast(pa.array([p for _, p in pieces_of(vocabulary)], pa.binary()))
    cells = blocks.select("block", F.explode("cells").alias("c")).select("block", "c.*")
    kinds = "block long, first int, widths binary, ids binary, lengths binary, text binary"
    filled = cells.groupBy("deal").applyInArrow(_encode(vocabulary, pieces), kinds)
    filled = filled.groupBy("block").agg(F.collect_list(F.struct("first", "widths", "ids", "lengths", "text")).alias("filled"))
    return blocks.select("block", "doc_ids", "sizes", "places").join(filled, "block", "left").mapInArrow(_assemble, "doc_id long, ids array<int>, text string")


def encode(docs: DataFrame, vocabulary: str | None = None, most: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, ids."""
    return round_trip(docs, vocabulary, most).drop("text")


def pieces_of(vocabulary: str | None = None) -> list[tuple[int, bytes]]:
    """The bytes of each id."""
    t = tokenizer(vocabulary)
    added = t.get_added_tokens_decoder()
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in pieces
    hidden = [b for b in range(256) if b not in shown]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}
    tokens = [t.id_to_token(k) for k in range(t.get_vocab_size())]
    return [(k, b"" if s is None else s.encode() if k in added else bytes(byte[c] for c in s)) for k, s in enumerate(tokens)]


def piece_table(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """id, piece."""
    return spark.createDataFrame([(k, bytearray(p)) for k, p in pieces_of(vocabulary)], "id int, piece binary")


def _join_pieces(names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, tail = None, []

        def rows(kept: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(kept.column(c) for c in names), pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())], names=[*names, "text"])

        for b in batches:
            pieces = b.column("piece").fill_null(b"").cast(pa.large_binary())
            _, offs, data = pieces.buffers()
            at = np.frombuffer(offs, np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
            raw = memoryview(data) if data is not None else memoryview(b"")
            begins = np.flatnonzero(b.column("begins").to_numpy(zero_copy_only=False))
            cuts = at[begins].tolist()
            if not cuts:
                tail.append(bytes(raw[at[0] : at[-1]]))
                continue
            texts = [bytes(raw[i:j]) for i, j in zip(cuts, cuts[1:])]
            if kept is not None:
                yield rows(kept, [b"".join([*tail, bytes(raw[at[0] : cuts[0]])])])
            heads = b.take(pa.array(begins))
            if texts:
                yield rows(heads.slice(0, len(texts)), texts)
            kept, tail = heads.slice(len(texts)), [bytes(raw[cuts[-1] : at[-1]])]
        if kept is not None:
            yield rows(kept, [b"".join(tail)])

    return run


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """All columns of `encoded` but ids, and text: the ids' pieces put together, special tokens kept, bytes that are no
    UTF-8 replaced."""
    names = [c for c in encoded.columns if c != "ids"]
    tokens = encoded.select(*names, F.posexplode_outer("ids").alias("_k", "id"))
    begins = F.coalesce(F.col("_k") == 0, F.lit(True))
    # a row an id of the vocabulary, whatever the corpus
    pieces = F.broadcast(piece_table(encoded.sparkSession, vocabulary))
    met = tokens.join(pieces, "id", "left").select(*(F.when(begins, F.col(c)).alias(c) for c in names), begins.alias("begins"), "piece")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields if f.name != "ids")
    return met.mapInArrow(_join_pieces(names), f"{kinds}, text string")


def digests(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document."""
    shown = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256)
    decoded = F.sha2(F.col("text").cast("binary"), 256)
    return round_trip(docs, vocabulary).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), shown.alias("ids_sha256"), decoded.alias("decoded_sha256"))
