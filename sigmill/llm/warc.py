"""WARC archives with a Zstandard dictionary for each archive.

Each task writes its records into archives of bounded size. An archive begins with a skippable frame that holds a
dictionary built from its own first records (a bounded sample); each record is a frame of its own, so a reader can
start at any record. Of records with equal payloads the one with the smallest page_id is a response, the others are
revisit records that refer to it and keep the HTTP header only. Archives go to the shared folder under a name of their
own for each task attempt; the manifest, written by Spark, names those of the attempts that counted.

Which payloads repeat is found from digests and page_ids alone, and only what is said of pages that are not the first with
their payload is joined to the payloads, by page_id: a payload that very many pages share makes no large group, and where
the repeats are few Spark broadcasts them and payloads stay where they are read.

Edge cases: null html is an empty payload; empty payloads are equal to each other; rows that repeat the smallest
page_id of their payload are responses each; a null page_id is a response only where no row of the payload has one;
null url leaves the target out; an empty table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialize, new_path, shuffle_partitions

#: Of the WARC-Zstandard format and the WARC 1.1 standard.
DICTIONARY_MAGIC = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SAMPLE_BYTES = 1 << 20
DICTIONARY_BYTES = 16 << 10
ARCHIVE_BYTES = 64 << 20
LEVEL = 3
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: str | None) -> int | None:
    number = (name or "").strip("<>").removeprefix("urn:page:")
    return int(number) if number else None


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%:/?#[]@!$&'()*+,;=~"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(sample: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """Trained on the sample, or its raw bytes where it is too small to train on."""
    if not sample:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, sample)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(sample)[-DICTIONARY_BYTES:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Writes one archive; records wait until the dictionary's sample is full."""

    def __init__(self, out):
        self.out, self.waiting, self.held, self.written, self.records = out, [], 0, 0, 0
        self.compressor = None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor:
            self._put(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.held += len(data)
        if self.held >= SAMPLE_BYTES:
            self._start()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def _start(self) -> None:
        d = dictionary(self.waiting)
        raw = d.as_bytes()
        self._put(struct.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=d)
        for data in self.waiting:
            self._put(self.compressor.compress(data))
        self.waiting = []

    def close(self) -> None:
        if self.waiting:
            self._start()
        self.out.close()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record."""
    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != DICTIONARY_MAGIC:
        raise ValueError("an archive must begin with its dictionary")
    d = zstandard.ZstdCompressionDict(stream.read(size))
    text = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=d).stream_reader(stream, read_across_frames=True), 1 << 20)
    while line := text.readline():
        if line.rstrip() != b"WARC/1.1":
            raise ValueError(f"no record begins with {line[:40]!r}")
        headers = {}
        while (line := text.readline().rstrip(b"\r\n")):
            key, _, value = line.partition(b":")
            headers[key.decode().lower()] = value.strip().decode()
        block = text.read(int(headers["content-length"]))
        if text.read(4) != b"\r\n\r\n":
            raise ValueError("a record must end with two line ends")
        yield headers, block


def with_originals(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses)."""
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    prints = materialize(p.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("size")), "payload-digests")
    firsts = prints.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    # one row for each page that refers to another; a page_id that has several payloads is told apart by the digest
    later = prints.join(firsts, ["digest", "size"]).filter("page_id is null or page_id <> first").select("page_id", "digest", "size", "first").distinct()
    later = later.select(F.col("page_id").alias("_id"), F.col("digest").alias("_digest"), F.col("size").alias("_size"), "first")
    where = F.col("page_id").eqNullSafe(F.col("_id"))
    if prints.groupBy("page_id").count().filter("count > 1 or page_id is null").isEmpty():
        later = later.select("_id", "first")
    else:
        where &= (F.sha1("payload") == F.col("_digest")) & (F.octet_length("payload") == F.col("_size"))
    return p.join(later, where, "left").select("page_id", "url", "payload", F.col("first").isNotNull().alias("revisit"), F.col("first").alias("refers_to"))


def write(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes the archives; returns the manifest (path, records), which is in the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = fs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int]] = []
        archive, name = None, ""
        for b in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in b.columns)):
                if archive is None:
                    name = f"{base}/{uuid.uuid4().hex}.warc.zst"
                    archive = Archive(system.open_output_stream(name, compression=None))
                archive.add(record(page_id, url, payload, revisit, refers_to))
                if archive.written >= archive_bytes:
                    archive.close()
                    done.append((name, archive.records))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((name, archive.records))
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in done], pa.string()), pa.array([x for _, x in done], pa.int64())], names=["path", "records"])

    return materialize(with_originals(pages).mapInArrow(run, "path string, records long"), "warc-manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """A row for each record of the manifest's archives. Payloads are hashed again; a difference is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            for path, records in zip(*(c.to_pylist() for c in b.columns)):
                rows = []
                with system.open_input_stream(path, compression=None) as stream:
                    for headers, block in read_archive(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
                            raise ValueError(f"the payload of {headers['warc-record-id']} has changed")
                        rows.append((_id(headers["warc-record-id"]), size, digest, headers["warc-type"], _id(headers.get("warc-refers-to"))))
                if len(rows) != records:
                    raise ValueError(f"{path} has {len(rows)} records, not {records}")
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return manifest.repartition(shuffle_partitions(manifest.sparkSession), "path").mapInArrow(run, READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes all pages and reads them back."""
    folder = new_path(pages.sparkSession, "warc")
    return read(write(pages, folder), folder)
