"""WARC archives as seekable Zstandard bundles.

``write_bundles`` writes one record per page. Records are grouped into independent
Zstandard frames; a bundle ends with a seek table (a skippable frame that lists every
frame's compressed and plain size, as the public seekable format lays down), so each
frame can be found and read alone. The returned index maps each record identifier to
its bundle, its frame and the offset inside the frame. ``read_bundles`` reads whole
bundles back, ``read_records`` only the frames of chosen records.

Of pages with equal payloads (equal SHA-256) the one with the smallest id becomes a
``response``, the others ``revisit`` records that name it (``WARC-Refers-To`` its record,
``WARC-Refers-To-Target-URI`` its address) and hold no payload. Payloads shorter than
``min_bytes`` are always responses. Null html counts as the empty payload, a null url
as ``about:blank``; control characters in urls are percent-encoded. Repeated rows of
the response's id are responses as well. Pages with a null id are written without a
page number, as revisits if a page with an id has their payload, else as responses.
An empty table gives no bundle and an empty result. Other columns are ignored. A very long
payload is a frame of its own.

Bundles are written by the tasks into the shared folder under a name of their own and
become visible by a rename; only those that the committed index names belong to the
archive, so a task that runs twice leaves nothing that is read. Only ids and digests
are grouped; the join back splits a hot digest (AQE), as it needs no whole groups. Reading
back takes as many tasks as the archive's bytes ask for (``READ_BYTES`` each).
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_map, shared_dir, stored, text_or_empty

#: Plain bytes of a frame, and of the frames of a bundle, at which a new one begins.
FRAME_BYTES = 1 << 18
BUNDLE_BYTES = 1 << 28
#: Compressed bytes of the frames that one task reads back.
READ_BYTES = 1 << 21
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX_SCHEMA = "record_id string, page_id long, bundle string, frame int, frame_offset long, frame_bytes long, offset_in_frame long, record_bytes long"
RECORD_SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"[a-zA-Z][\w+.-]*:", uri) else f"file://{uri}")


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id_of(page_id: int | None, url: str | None) -> str:
    return str(uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url}"))


def safe_url(url: str | None) -> str:
    return quote(url, safe="".join(chr(c) for c in range(33, 127))) if url else "about:blank"


def record_bytes(
    record_id: str, page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str, refers_url: str | None = None
) -> bytes:
    """One WARC 1.1 record, response or (with ``refers_to``) revisit."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if refers_to is not None else http + payload
    refers = [
        f"WARC-Profile: {REVISIT_PROFILE}",
        f"WARC-Refers-To: <urn:uuid:{record_id_of(refers_to, refers_url)}>",
        f"WARC-Refers-To-Target-URI: {safe_url(refers_url)}",
        f"WARC-Refers-To-Date: {date}",
        f"X-Refers-To-Page: {refers_to}",
    ]
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:uuid:{record_id}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {safe_url(url)}",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        *(refers if refers_to is not None else []),
        *([f"X-Page: {page_id}"] if page_id is not None else []),
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes, int, int]]:
    """``(headers, block, offset, length)`` of each record in plain WARC data."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        body = end + 4
        size = int(headers["Content-Length"])
        yield headers, data[body : body + size], at, body + size + 4 - at
        at = body + size + 4


class BundleWriter:
    """Writes frames, then the seek table, and renames the finished file."""

    def __init__(self, folder: str, name: str, level: int) -> None:
        self.fs, self.path = _open(f"{folder}/{name}.warc.zst")
        self.uri = f"{folder}/{name}.warc.zst"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.path + ".part", compression=None)
        self.codec = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int]] = []
        self.offset = self.plain = 0

    def frame(self, data: bytes) -> tuple[int, int, int]:
        """Number, offset and compressed size of the frame that now holds ``data``."""
        packed = self.codec.compress(data)
        self.out.write(packed)
        self.frames.append((len(packed), len(data)))
        self.offset += len(packed)
        self.plain += len(data)
        return len(self.frames) - 1, self.offset - len(packed), len(packed)

    def close(self) -> None:
        table = b"".join(struct.pack("<II", *f) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.path + ".part", self.path)


class BundleReader:
    """Random access to a bundle's frames by its seek table."""

    def __init__(self, uri: str) -> None:
        fs, path = _open(uri)
        self.file = fs.open_input_file(path)
        end = self.file.size()
        count, _, magic = struct.unpack("<IBI", self.file.read_at(9, end - 9))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        table = self.file.read_at(8 * count, end - 9 - 8 * count)
        self.frames: list[tuple[int, int, int]] = []
        at = 0
        for packed, plain in struct.iter_unpack("<II", table):
            self.frames.append((at, packed, plain))
            at += packed
        self.codec = zstandard.ZstdDecompressor()

    def frame(self, number: int) -> bytes:
        at, packed, plain = self.frames[number]
        return self.codec.decompress(self.file.read_at(packed, at), max_output_size=plain)


def _types(pages: DataFrame, min_bytes: int) -> DataFrame:
    """Pages as ``page_id, url, html, refers_to, refers_url`` (the last two null for responses)."""
    base = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_or_empty("html").alias("html")
    ).withColumn("sha", F.when(F.octet_length("html") >= min_bytes, F.sha2("html", 256)))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first")
    several = stored(
        base.where("sha is not null").groupBy("sha").agg(first, F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("sha", "first"),
        "warc-copies",
    )
    other = ~F.col("page_id").eqNullSafe(F.col("first.page_id"))
    return base.join(several, "sha", "left").select(
        "page_id", "url", "html", F.when(other, F.col("first.page_id")).alias("refers_to"), F.when(other, F.col("first.url")).alias("refers_url")
    )


def write_bundles(
    pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 3, date: str = "1970-01-01T00:00:00Z"
) -> DataFrame:
    """Writes the archive of ``pages (page_id, url, html)``; returns its index, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"bundle-{task.partitionId():06d}-{uuid.uuid4().hex[:12]}"
        writer, bundles, frame, rows, plain = None, 0, [], [], 0
        names = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]

        def flush() -> pa.RecordBatch:
            number, offset, size = writer.frame(b"".join(frame))
            out = [[r, p, writer.uri, number, offset, size, at, n] for r, p, at, n in rows]
            types = [pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types, strict=True)], names=names)

        for batch in batches:
            for row in batch.to_pylist():
                if writer is None:
                    writer = BundleWriter(folder, f"{name}-{bundles:04d}", level)
                    bundles += 1
                record_id = record_id_of(row["page_id"], row["url"])
                data = record_bytes(record_id, row["page_id"], row["url"], row["html"].encode(), row["refers_to"], date, row["refers_url"])
                rows.append((record_id, row["page_id"], plain, len(data)))
                frame.append(data)
                plain += len(data)
                if plain >= FRAME_BYTES:
                    yield flush()
                    frame, rows, plain = [], [], 0
                    if writer.plain >= BUNDLE_BYTES:
                        writer.close()
                        writer = None
        if writer is not None:
            if frame:
                yield flush()
            writer.close()

    return stored(arrow_map(_types(pages, min_bytes), run, INDEX_SCHEMA), "warc-index")


def _parsed(data: bytes, with_payload: bool, only: set[int] | None = None) -> list[list]:
    out = []
    for headers, block, at, _ in parse_records(data):
        if only is not None and at not in only:
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        page, to = headers.get("X-Page"), headers.get("X-Refers-To-Page")
        declared = headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response":
            size, digest = len(payload), digest_of(payload)
            if digest != declared:
                raise ValueError(f"payload of {headers['WARC-Record-ID']} does not match its digest")
        else:
            size, digest, payload = int(re.search(rb"Content-Length: (\d+)", http)[1]), declared, None
        out.append(
            [
                headers["WARC-Record-ID"][len("<urn:uuid:") : -1],
                int(page) if page else None,
                headers["WARC-Target-URI"],
                headers["WARC-Type"],
                int(to) if to else None,
                size,
                digest,
                payload if with_payload else None,
            ]
        )
    return out


_RECORD_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
_RECORD_NAMES = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]


def _record_batch(rows: list[list]) -> pa.RecordBatch:
    columns = [pa.array(c, t) for c, t in zip(zip(*rows), _RECORD_TYPES, strict=True)]
    return pa.RecordBatch.from_arrays(columns, names=_RECORD_NAMES)


def read_bundles(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Every record of the bundles that the index names, frame by frame."""
    frames = index.groupBy("bundle", "frame").agg(F.max("frame_bytes").alias("bytes"))
    tasks = -(-int(frames.agg(F.sum("bytes")).first()[0] or 0) // READ_BYTES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, uri = None, None
        for batch in batches:
            for bundle, frame in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if bundle != uri:
                    reader, uri = BundleReader(bundle), bundle
                if rows := _parsed(reader.frame(frame), with_payload):
                    yield _record_batch(rows)

    # A number of tasks that is asked for is kept: the rows are few, but each stands for a frame.
    dealt = frames.select("bundle", "frame").repartition(max(1, tasks), F.hash("bundle", F.floor(F.col("frame") / 4)))
    return arrow_map(dealt.sortWithinPartitions("bundle", "frame"), run, RECORD_SCHEMA)


def read_records(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """Only the records of the given index rows, reading only their frames."""
    wanted = index.groupBy("bundle", "frame").agg(F.collect_set("offset_in_frame").alias("offsets"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = BundleReader(row["bundle"]).frame(row["frame"])
                if rows := _parsed(data, with_payload, set(row["offsets"])):
                    yield _record_batch(rows)

    return arrow_map(wanted, run, RECORD_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    """A new folder for an archive inside the shared folder."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
