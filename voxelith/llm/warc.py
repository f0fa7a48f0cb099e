"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress alone; a bundle ends with a seek table (a skippable
frame of compressed and decompressed sizes, then a footer), and an index maps each record's
identifier to its bundle, frame and place within the frame.  A record whose payload was written
already is a `revisit` of the one with the smallest page_id.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fewer_bytes, materialize, scratch

#: Bytes of records in a frame and compressed bytes in a bundle, about; a longer record has a frame
#: of its own.
FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 128 << 20
#: Bytes of pages that reach Python at once, and of records that one task reads back, about.
BATCH_BYTES = 4 << 20
READ_BYTES = 32 << 20
#: Fixed values of the Zstandard seekable format and of WARC 1.1.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Names that Hadoop and pyarrow have for the same store.
_SAME_STORE = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "wasbs": "abfss", "wasb": "abfs"}
_stores: dict[str, fs.FileSystem] = {}


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of uri, one for each store and worker, and the path there."""
    if uri.startswith("dbfs:"):
        uri = "file:///dbfs/" + uri.removeprefix("dbfs:").lstrip("/")
    kind, _, rest = uri.partition("://")
    if not rest:
        kind, rest = "file", uri.removeprefix("file:")
    kind = _SAME_STORE.get(kind, kind)
    store = f"{kind}://{'' if kind == 'file' else rest.split('/')[0]}"
    found, path = (_stores[store], None) if store in _stores else fs.FileSystem.from_uri(f"{kind}://{rest}")
    _stores[store] = found
    if path is None:
        path = rest if kind in ("file", "s3", "gs") else fs.FileSystem.from_uri(f"{kind}://{rest}")[1]
    return found, path


def digest(payload: bytes) -> str:
    """Upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, sha: bytes | None = None) -> bytes:
    """One WARC record; sha is the payload's SHA-1, if known.  A revisit keeps the HTTP headers, with
    the payload's length, and leaves out the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    name = page_id if page_id is not None else f"null-{uuid.uuid4().hex}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to is not None else 'response'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 2000-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "%{:02X}".format(ord(c)) for c in url))
    if refers_to is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{base64.b32encode(sha).decode() if sha else digest(payload)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: memoryview | bytes, at: int = 0) -> tuple[dict[str, str], bytes, bytes, int]:
    """The record at `at`: its headers, HTTP headers, payload, and the place after it."""
    data = bytes(data) if not isinstance(data, bytes) else data
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    head = dict(line.split(": ", 1) for line in lines[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    cut = block.index(b"\r\n\r\n") + 4
    return head, block[:cut], block[cut:], start + size + 4


class BundleWriter:
    """Bundles in a folder.  A bundle has a name of its own for every attempt of a task, and its
    index rows name it, so an attempt that is repeated cannot mix with one that was lost."""

    def __init__(self, folder: str, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = 3):
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.out = None
        self.frame, self.size = [], 0

    def add(self, data: bytes) -> tuple[str, int, int, int]:
        """(bundle, frame, offset in the frame, length)"""
        if self.out is None:
            self.fs, folder = _open(self.folder)
            self.fs.create_dir(folder, recursive=True)
            name = f"{uuid.uuid4().hex}.warc.zst"
            self.uri, self.out, self.frames, self.written = f"{self.folder}/{name}", self.fs.open_output_stream(f"{folder}/{name}", compression=None), [], 0
        place = (self.uri, len(self.frames), self.size, len(data))
        self.frame.append(data)
        self.size += len(data)
        if self.size >= self.frame_bytes:
            self._flush()
            if self.written >= self.bundle_bytes:
                self.close()
        return place

    def _flush(self) -> None:
        if self.frame:
            packed = self.zstd.compress(b"".join(self.frame))
            self.out.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.frame, self.size = [], 0

    def close(self) -> None:
        if self.out is not None:
            self._flush()
            table = b"".join(struct.pack("<II", *f) for f in self.frames)
            footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
            self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(footer)) + table + footer)
            self.out.close()
            self.out = None


class BundleReader:
    """Frames of a bundle by number, found through its seek table."""

    def __init__(self, uri: str):
        files, path = _open(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = struct.unpack(f"<{2 * frames}I", self.file.read_at(8 * frames, size - 9 - 8 * frames))
        self.sizes = list(zip(table[::2], table[1::2], strict=True))
        self.starts = [0]
        for packed, _ in self.sizes:
            self.starts.append(self.starts[-1] + packed)
        self.zstd = zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        packed, size = self.sizes[k]
        return self.zstd.decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)

    def record(self, frame: int, offset: int) -> tuple[dict[str, str], bytes, bytes, int]:
        return parse(self.frame(frame), offset)

    def close(self) -> None:
        self.file.close()


INDEX = "page_id long, bundle string, frame int, offset long, length long"


def revisits(keys: DataFrame, min_bytes: int = 0) -> DataFrame:
    """keys(page_id, sha, bytes) -> (page_id, sha, refers_to) of the records that revisit another,
    each once.  Payloads take no part: a digest and a number stand for them."""
    groups = keys.where(F.col("bytes") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    groups = groups.where("n > 1 and refers_to is not null").select("sha", "refers_to")
    return keys.join(groups, "sha").where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write pages(page_id, url, html, ...) as WARC bundles; returns their index, one row a record.

    Of pages with equal payloads of at least min_bytes bytes, that with the smallest page_id is
    the response, and the others revisit it.  A null html is an empty payload.  Rows with the same
    page_id and payload as the response are responses too.  A page whose page_id is null is a
    response unless another page has its payload.  An empty table gives an empty index.  Other
    columns of pages are ignored, whatever their names.

    Which record revisits which is settled from (page_id, digest, size) alone; only that verdict is
    joined to the pages, so a common payload is no common key of a join that carries payloads."""
    spark = pages.sparkSession
    own = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload")
    )
    own = own.withColumn("sha", F.unhex(F.sha1("payload")))
    keys = materialize(own.select("page_id", "sha", F.octet_length("payload").cast("long").alias("bytes")), "digests")
    verdict = materialize(revisits(keys, min_bytes), "revisits").select(F.col("page_id").alias("_page"), F.col("sha").alias("_sha"), "refers_to")
    found = own.join(verdict, own["page_id"].eqNullSafe(verdict["_page"]) & (own["sha"] == verdict["_sha"]), "left")
    found = found.select("page_id", "url", "payload", "sha", "refers_to")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = BundleWriter(folder, frame_bytes)
        for batch in batches:
            ids, urls, shas, refs = (batch.column(i).to_pylist() for i in (0, 1, 3, 4))
            rows = [(page, *writer.add(record(page, url, payload.as_py(), ref, sha))) for page, url, payload, sha, ref in zip(ids, urls, batch.column(2), shas, refs, strict=True)]
            yield _batch(rows, INDEX)
        writer.close()

    with fewer_bytes(spark, BATCH_BYTES):
        return materialize(found.mapInArrow(write, INDEX), "index")


_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def read_archives(spark: SparkSession, index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read every record of the bundles in index back, frame by frame, and check its digest.

    With payloads=False the payload column is left null.  Frames are dealt to tasks by their bytes,
    runs of neighbouring frames of a bundle together; a task holds one frame.  An empty index gives
    an empty table; a record that is not as the index or its digest has it is an error."""
    run = max(1, READ_BYTES // (4 * FRAME_BYTES))
    total = index.agg(F.sum("length")).first()[0] or 0
    frames = index.groupBy("bundle", "frame").agg(F.count("*").alias("n"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, name = None, None
        for batch in batches:
            for uri, frame, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if uri != name:
                    if reader:
                        reader.close()
                    reader, name = BundleReader(uri), uri
                data, at, rows = reader.frame(frame), 0, []
                while at < len(data):
                    head, http, payload, at = parse(data, at)
                    stored = head["WARC-Payload-Digest"].removeprefix("sha1:")
                    if head["WARC-Type"] == "response" and digest(payload) != stored:
                        raise ValueError(f"{uri}, frame {frame}: {head['WARC-Record-ID']} does not match its digest")
                    size = int(http.rsplit(b"Content-Length: ", 1)[1])
                    rows.append((_number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, stored, head["WARC-Type"], _number(head.get("WARC-Refers-To")), payload if payloads else None))
                if len(rows) != n:
                    raise ValueError(f"{uri}, frame {frame}: {len(rows)} records, the index has {n}")
                yield _batch(rows, RECORDS)

    # The number of tasks follows the archives' bytes: index rows are too small for Spark to tell.
    dealt = frames.repartition(1 + total // READ_BYTES, "bundle", F.floor(F.col("frame") / run)).sortWithinPartitions("bundle", "frame")
    return dealt.mapInArrow(read, RECORDS)


def archive_round_trip(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Write pages(page_id, url, html, ...) as archives and return what reading them back gives,
    (page_id, payload_bytes, payload_digest, record_type, refers_to), a row for each row of pages.

    Nulls, empty and repeated rows as in `write_archives`; an empty table gives an empty table."""
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    return read_archives(spark, write_archives(pages, folder, min_bytes), payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
