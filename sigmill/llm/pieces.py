"""SentencePiece encoding and decoding by streaming Viterbi over a public piece vocabulary.

The vocabulary file gives pieces but no probabilities, so a piece's log-probability is Zipf's: rank r of n counts
1 / (r + 2), normalised; a byte piece counts half as much as the last rank. Scores are whole multiples of 2^-20, so sums are
exact. Of paths with equal scores the one with the longer last piece wins.

The search takes a text character by character. Only boundaries from which a piece may still go on can lead further, so its
window is never longer than the longest piece; whenever the backpointers of all of them lead through one boundary, the ids
before it are committed and forgotten. (In a run of one character they may never meet; then the backpointers, not the
window, grow with the run, and the time stays linear.)

A text is one stream, fed in parts of about a word. What is committed never counts again, so the state of the stream is the
text behind the last commit, and what the next part leads to depends on these two alone: ids committed, text left. Such
transitions are kept in a bounded table, so that a state and part that come again are not searched again.

Text is not normalised: a space is the word-start mark, everything without a piece (line feeds, a literal word-start mark)
becomes byte pieces, and decoding gives back the exact text.

Edge cases: null or empty text has no ids; repeated rows are encoded each; an empty table gives an empty result; other
columns are kept by encode and decode (an existing `ids` or `text` is replaced) and ignored by digests.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import log
from struct import pack
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textops import chunks

MARK = "▁"
UNIT = 1 << 20
NONE: dict = {}  # follows no piece that no other goes on


class Vocabulary:
    """Pieces of a SentencePiece model file: ids by text, byte ids, scores and bytes by id."""

    def __init__(self, path: str | None = None):
        import public_tokenizers
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path("piece_bpe_32k.model"))
        names = [p.id_to_piece(i) for i in range(p.get_piece_size())]
        plain = [i for i in range(len(names)) if not (p.is_byte(i) or p.is_control(i) or p.is_unknown(i))]
        norm = log(sum(1 / (r + 2) for r in range(len(plain) + 1)))
        self.ids = {names[i]: i for i in plain}
        self.scores = {i: -round((log(r + 2) + norm) * UNIT) for r, i in enumerate(plain)}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(len(names)) if p.is_byte(i)}
        self.byte_score = -round((log(2 * (len(plain) + 2)) + norm) * UNIT)
        self.longest = max(map(len, self.ids))
        # the pieces by their characters: what may follow, id (-1: no piece ends here), score
        self.start: dict = {}
        for name in sorted(self.ids, key=len, reverse=True):
            i, kids = self.ids[name], self.start
            for c in name[:-1]:
                kids = kids.setdefault(c, ({}, -1, 0))[0]
            kids[name[-1]] = (kids[name[-1]][0] if name[-1] in kids else NONE, i, self.scores[i])
        self.bytes = [b""] * len(names)
        for name, i in self.ids.items():
            self.bytes[i] = name.replace(MARK, " ").encode()
        for b, i in self.byte_ids.items():
            self.bytes[i] = bytes([b])


@lru_cache(maxsize=2)
def vocabulary(path: str | None = None) -> Vocabulary:
    return Vocabulary(path)


class StreamingViterbi:
    """The best path through one text, given in any number of parts; ids come out as soon as they are certain."""

    STEP = 64  # boundaries after which `feed` compares the survivors' backpointers, at first

    def __init__(self, vocab: Vocabulary):
        self.v = vocab
        self.restart()

    def restart(self, behind: str = "") -> None:
        """A new beginning with this text behind the last commit."""
        self.raw = ""  # characters behind the last commit
        self.score, self.back, self.piece = [0], [0], [-1]  # of each boundary there
        self.open: list[tuple[int, dict]] = []  # boundaries from which a piece may go on, and with what
        self.next = self.STEP
        self._advance(behind)

    def feed(self, part: str) -> list[int]:
        """Takes more text; returns ids that no later text can change."""
        out: list[int] = []
        at = 0
        while at < len(part):
            more = part[at : at + max(1, self.next + 1 - len(self.score))]
            self._advance(more)
            at += len(more)
            if len(self.score) > self.next:
                out += self.settle()
        return out

    def settle(self, within: int | None = None) -> list[int]:
        """Commits all up to the last boundary that the backpointers of all survivors lead through; `within`: if it is
        no further back than that many characters."""
        at = len(self.score) - 1
        if len(self.open) == 1 and self.open[0][0] == self.back[at]:
            alive = {self.back[at]}  # as mostly where a word ends
        else:
            alive = {at, *(b for b, _ in self.open)}
        while len(alive) > 1:
            last = max(alive)
            if within is not None and at - last > within:
                return []
            alive.discard(last)
            alive.add(self.back[last])
        (common,) = alive
        out = []
        if common:
            out = self._path(self.raw, self.back, self.piece, common)
            self.raw = self.raw[common:]
            self.score, self.piece = self.score[common:], [-1, *self.piece[common + 1 :]]
            self.back = [0, *(max(k - common, 0) for k in self.back[common + 1 :])]
            self.open = [(b - common, kids) for b, kids in self.open]
        self.next = max(self.STEP, 2 * (at - common))
        return out

    def finish(self) -> list[int]:
        """The text ends here: all is certain."""
        out = self._path(self.raw, self.back, self.piece, len(self.score) - 1)
        self.restart()
        return out

    def _advance(self, part: str) -> None:
        score, back, piece, open_ = self.score, self.back, self.piece, self.open
        start, byte_score = self.v.start, self.v.byte_score
        at = len(score) - 1
        for r, c in zip(part, part.replace(MARK, "\0").replace(" ", MARK)):
            begin, found = at, -1
            best = score[at] + (byte_score if r < "\x80" else byte_score * len(r.encode()))
            open_.append((at, start))
            at += 1
            on = []
            for b, kids in open_:  # the longest piece first; it wins over others of the same score
                node = kids.get(c)
                if node is not None:
                    kids, i, worth = node
                    if i >= 0:
                        s = score[b] + worth
                        if s > best or (s == best and found < 0):
                            best, begin, found = s, b, i
                    if kids:
                        on.append((b, kids))
            open_ = on
            score.append(best)
            back.append(begin)
            piece.append(found)
        self.raw += part
        self.open = open_

    def _path(self, raw: str, back: list[int], piece: list[int], boundary: int) -> list[int]:
        out: list[int] = []
        while boundary:
            begin = back[boundary]
            if piece[boundary] >= 0:
                out.append(piece[boundary])
            else:
                out.extend(self.v.byte_ids[b] for b in reversed(raw[begin:boundary].encode()))
            boundary = begin
        return out[::-1]


# A part ends behind the character that follows a word: there the backpointers mostly meet before that character.
_parts = re.compile(r" *[^ .,\n]+[ .,\n]?| +|[.,\n]+").findall


class Encoder:
    """Sends texts through one stream, part by part, and keeps what it does with short ones."""

    MOST = 1_000_000  # transitions
    SPAN = 48  # characters
    FEED = 4096

    def __init__(self, path: str | None = None):
        self.v = vocabulary(path)
        self.stream = StreamingViterbi(self.v)
        self.known: dict[str, tuple[bytes, str]] = {}  # text behind the last commit and next part: ids, text left
        self.ends: dict[str, bytes] = {}  # text left where a text ends: ids
        self.streamed = 0  # characters that went through the stream
        self.at_end = 0  # ids that only the end of their text made certain

    def __call__(self, text: str) -> bytes:
        known, out, left, ready = self.known, [], "", False
        if len(known) > self.MOST:
            known.clear()
        for part in _parts(text):
            if len(left) + len(part) > self.SPAN:
                ids, left = self._go(left, part, ready)
                ready = True
            elif (hit := known.get(left + part)) is not None:
                ids, left = hit
                ready = False
            else:
                key = left + part
                ids, left = known[key] = self._go(left, part, ready)
                ready = True
            out.append(ids)
        out.append(self._end(left, ready))
        return b"".join(out)

    def _go(self, left: str, part: str, ready: bool) -> tuple[bytes, str]:
        """Feeds a part to the stream, which is brought to what is left first, unless it stands there."""
        if not ready:
            self.stream.restart()
            part = left + part
        self.streamed += len(part)
        ids: list[int] = []
        for i in range(0, len(part), self.FEED):
            ids += self.stream.feed(part[i : i + self.FEED])
        ids += self.stream.settle(2 * self.SPAN)
        left = self.stream.raw
        return pack(f"<{len(ids)}I", *ids), intern(left) if len(left) <= self.SPAN else left

    def _end(self, left: str, ready: bool) -> bytes:
        """Ids of what is left where a text ends."""
        if not left:
            return b""
        if left in self.ends:
            ids = self.ends[left]
        else:
            if not ready:
                self.stream.restart(left)
            ids = np.array(self.stream.finish(), "<u4").tobytes()
            if len(left) <= self.SPAN:
                if len(self.ends) > self.MOST:
                    self.ends.clear()
                self.ends[left] = ids
        self.at_end += len(ids) // 4
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.v.bytes.__getitem__, ids)).decode()


@lru_cache(maxsize=1)
def encoder_of(path: str | None) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path)


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """Adds ids (array<int>, null for null text)."""
    docs = docs.drop("ids") if text != "ids" else docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in chunks(batches, text):
            ids = [None if t is None else np.frombuffer(encoder(t), "<u4").astype(np.int32) for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.list_(pa.int32()))], names=[*b.schema.names, "ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """Adds text (null for null ids)."""
    rows = rows.drop("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        for b in batches:
            texts = [None if i is None else encoder.decode(i) for i in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, "text"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("text", T.StringType())]))


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_ids, n_byte_ids, ids_crc32 (little-endian 32-bit ids) and round_trip: decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(path)
        is_byte = np.zeros(len(encoder.v.bytes), bool)
        is_byte[list(encoder.v.byte_ids.values())] = True
        for b in chunks(batches):
            rows = []
            for t in b.column("text").to_pylist():
                blob = encoder(t or "")
                ids = np.frombuffer(blob, "<u4")
                rows.append((len(ids), int(is_byte[ids].sum()), zlib.crc32(blob), encoder.decode(ids.tolist()) == (t or "")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_())))], names=["doc_id", "n_ids", "n_byte_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_ids long, n_byte_ids long, ids_crc32 long, round_trip boolean")
