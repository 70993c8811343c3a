"""WARC records in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own; a skippable frame at
the end of a bundle holds the seek table of the Zstandard seekable format. An
index table maps each record to its bundle, frame and offset inside the frame.

Of records with equal payloads of at least min_revisit bytes the one with the
smallest id is a response and the others revisit it. Rows that repeat both that id
and the payload are all responses; a null id revisits the smallest id there is,
and is a response where all are null. Null payloads are empty. An empty table
writes no bundle. A task that runs again writes bundles of another name; the index,
which Spark commits, names only those of the attempt that counted.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MOST_BROADCAST, id_filter, materialise, partitions, scratch_path

#: Fixed values of the Zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
INDEX_SCHEMA = "page_id long, bundle string, frame long, frame_start long, frame_bytes long, record_offset long, record_bytes long"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def encode_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in raw.decode().split("\r\n")[1:])}


def decode_records(frame: bytes) -> Iterator[tuple[int, int, dict[str, str], dict[str, str], bytes]]:
    """(offset, bytes, WARC headers, HTTP headers, payload) of a frame's records."""
    at = 0
    while at < len(frame):
        if not frame.startswith(b"WARC/", at):
            raise ValueError(f"no record at {at}")
        end = frame.index(b"\r\n\r\n", at)
        warc = _headers(frame[at:end])
        block = frame[end + 4 : end + 4 + int(warc["content-length"])]
        cut = block.index(b"\r\n\r\n")
        after = end + 4 + len(block) + 4
        yield at, after - at, warc, _headers(block[:cut]), block[cut + 4 :]
        at = after


class BundleWriter:
    def __init__(self, stream, level: int):
        self._stream, self._zstd = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self._sizes: list[tuple[int, int]] = []
        self.at = 0

    def frame(self, raw: bytes) -> tuple[int, int, int]:
        packed = self._zstd.compress(raw)
        self._stream.write(packed)
        place = (len(self._sizes), self.at, len(packed))
        self._sizes.append((len(packed), len(raw)))
        self.at += len(packed)
        return place

    def close(self) -> None:
        entries = b"".join(struct.pack("<II", *x) for x in self._sizes)
        footer = struct.pack("<IBI", len(self._sizes), 0, SEEKABLE_MAGIC)
        self._stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self._stream.close()


def seek_table(source: pa.NativeFile) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, raw bytes) of each frame of an open bundle."""
    size = source.size()
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if flags & 0x80 else 8
    source.seek(size - 9 - n * width)
    table, out, at = source.read(n * width), [], 0
    for i in range(n):
        packed, raw = struct.unpack_from("<II", table, i * width)
        out.append((at, packed, raw))
        at += packed
    return out


def write_bundles(pages: DataFrame, folder: str, payload: str = "html", id_col: str = "page_id", url: str = "url", min_revisit: int = 100, frame_bytes: int = 256 << 10, bundle_bytes: int = 1 << 30, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes pages to bundles in folder, which all executors share, and returns
    INDEX_SCHEMA as a written table."""
    body = F.encode(F.coalesce(F.col(payload), F.lit("")), "UTF-8")
    own = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256)).withColumn("long", F.octet_length("body") >= min_revisit)
    copies = own.where("long").groupBy("digest").agg(F.min("page_id").alias("winner"), F.count("*").alias("n")).where("n > 1").select("digest", "winner")
    copies = materialise(copies, "warc-copies")
    n = copies.count()
    if n <= MOST_BROADCAST:
        rows = own.join(F.broadcast(copies), "digest", "left")
    else:
        # only bodies that may be revisits leave their place; others are written where they lie
        repeats = own.select("page_id", "digest").join(copies, "digest").where("page_id <> winner").select("page_id")
        may = id_filter(repeats, "page_id", repeats.count())
        named, unnamed = own.where("page_id is not null"), own.where("page_id is null")
        rows = may(named, "page_id").unionByName(unnamed).join(copies, "digest", "left").unionByName(may(named, "page_id", others=True), allowMissingColumns=True)
    refers = F.when(F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner")), F.col("winner"))
    rows = rows.select("page_id", "url", "body", "digest", refers.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        writer, name, count = None, "", 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush():
            nonlocal writer, name, count, held, size
            if not held:
                return
            if writer is None:
                name = f"bundle-{task.partitionId():06d}-{task.taskAttemptId()}-{count:04d}.warc.zst"
                writer, count = BundleWriter(fs.open_output_stream(f"{base}/{name}", compression=None), level), count + 1
            frame, start, packed = writer.frame(b"".join(r for _, r in held))
            offset, out = 0, []
            for page_id, r in held:
                out.append((page_id, name, frame, start, packed, offset, len(r)))
                offset += len(r)
            if writer.at >= bundle_bytes:
                writer.close()
                writer = None
            held, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i == 1 else pa.int64()) for i, c in enumerate(zip(*out))], names=["page_id", "bundle", "frame", "frame_start", "frame_bytes", "record_offset", "record_bytes"])

        for batch in batches:
            for page_id, link, raw, digest, refers_to in zip(*(batch.column(i).to_pylist() for i in range(5))):
                record = encode_record(page_id, link, bytes(raw), digest, refers_to, date)
                held.append((page_id, record))
                size += len(record)
                if size >= frame_bytes:
                    yield from flush()
        yield from flush()
        if writer is not None:
            writer.close()

    return materialise(rows.mapInArrow(run, INDEX_SCHEMA), "warc-index")


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record
    of the bundles that index names, out of the bundles themselves: first their seek
    tables, then frame by frame. A response's digest and length are taken of its
    payload and must agree with its headers."""

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    table = seek_table(f)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(table), pa.string()), pa.array([x[0] for x in table], pa.int64()), pa.array([x[1] for x in table], pa.int64())], names=["bundle", "start", "size"])

    def number(urn: str | None) -> int | None:
        x = None if urn is None else urn.removeprefix("<urn:page:").removesuffix(">")
        return None if x in (None, "none") else int(x)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        zstd = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, start, size in zip(*(batch.column(i).to_pylist() for i in range(3))):
                with fs.open_input_file(f"{base}/{name}") as f:
                    f.seek(start)
                    raw = zstd.decompress(f.read(size))
                out = []
                for _, _, warc, http, payload in decode_records(raw):
                    digest, length, kind = warc["warc-payload-digest"].removeprefix("sha256:"), int(http["content-length"]), warc["warc-type"]
                    if kind == "response" and (len(payload) != length or hashlib.sha256(payload).hexdigest() != digest):
                        raise ValueError(f"{name}: {warc['warc-record-id']} is damaged")
                    out.append((number(warc["warc-record-id"]), length, digest, kind, number(warc.get("warc-refers-to"))))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    found = index.select("bundle").distinct().mapInArrow(frames, "bundle string, start long, size long")
    return found.repartition(partitions(spark), "bundle", "start").mapInArrow(records, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def read_record(folder: str, bundle: str, frame_start: int, frame_bytes: int, record_offset: int, record_bytes: int) -> bytes:
    """One record by its index row: one range read, one frame decompressed."""
    fs, base = pafs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{base}/{bundle}") as f:
        f.seek(frame_start)
        raw = zstandard.ZstdDecompressor().decompress(f.read(frame_bytes))
    return raw[record_offset : record_offset + record_bytes]


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes the pages to the shared folder and reads them back."""
    spark = pages.sparkSession
    folder = scratch_path(spark, "warc")
    return read_bundles(spark, folder, write_bundles(pages, folder, **options))
