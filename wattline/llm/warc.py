"""WARC records in seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with a run of WARC
records, and a seek table in a skippable frame at its end (sizes of all
frames), so any frame can be read alone.  The index maps a record id to
(bundle, frame, offset in the frame's decompressed bytes, length).

Records with equal payloads are stored once: the record with the largest id is
the ``response``, the others are ``revisit`` records that refer to it.

Writers put a bundle under a name of its own and rename it when complete; a
lost or repeated task leaves at most a file that no index row names.

Defined results: null payload is empty, null url an empty target; a null id
never becomes the response of a group that has other ids; rows repeated under
one id with one payload are all responses or all revisits; extra columns are
ignored.  Empty input gives an empty index.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import map_arrow, save, scratch_path

# Fixed values of the seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
FOOTER_BYTES = 9

FRAME_BYTES = 1 << 20      # raw bytes after which a frame is closed
BUNDLE_BYTES = 128 << 20   # compressed bytes after which a bundle is closed
READ_BYTES = 64 << 20      # raw bytes that one task reads
RUN_FRAMES = 8             # frames of a bundle that are read one after the other
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"

INDEX_SCHEMA = "page_id long, bundle string, frame int, offset long, length long"
RECORD_SCHEMA = ("page_id long, url string, record_type string, payload_bytes long, payload_digest string, "
                 "refers_to long, payload binary, digest_ok boolean")


# ---- bytes of one record ------------------------------------------------

END = b"\r\n\r\n"


def record_parts(page_id, url: str, payload, digest: str, refers_to=None) -> list:
    """A record as buffers, the payload's own among them: nothing is copied."""
    size = len(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    length = len(http) + (0 if refers_to is not None else size)
    target = "".join(c if " " < c else f"%{ord(c):02X}" for c in url)
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {length}"]
    start = b"WARC/1.1\r\n" + "\r\n".join(head).encode() + END + http
    return [start + END] if refers_to is not None else [start, payload, END]


def record_bytes(page_id, url: str, payload: bytes, digest: str, refers_to=None) -> bytes:
    return b"".join(record_parts(page_id, url, payload, digest, refers_to))


def _headers(raw: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in raw.decode().split("\r\n")[1:] if ": " in line)


def parse_record(data: bytes, at: int, with_payload: bool = True) -> tuple[dict, int]:
    """The record that starts at a place of a frame, and where the next starts."""
    end = data.index(END, at)
    head = _headers(data[at:end])
    start = end + 4
    stop = start + int(head["Content-Length"])
    cut = data.index(END, start, stop)
    http, payload = _headers(data[start:cut]), memoryview(data)[cut + 4:stop]
    urn = lambda s: int(x) if (x := s[len("<urn:page:"):-1]) else None
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = head["WARC-Type"] == "revisit"
    own = None if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    return {"page_id": urn(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "record_type": head["WARC-Type"],
            "payload_bytes": int(http["Content-Length"]) if revisit else len(payload),
            "payload_digest": digest if revisit else own,
            "refers_to": urn(head["WARC-Refers-To"]) if revisit else None,
            "payload": None if revisit or not with_payload else payload.tobytes(),
            "digest_ok": None if revisit else own == digest and int(http["Content-Length"]) == len(payload)}, stop + 4


# ---- bundles ------------------------------------------------------------

def _store(folder: str):
    from pyarrow import fs
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder.replace("file:/", "file:///") if folder.startswith("file:/") and not folder.startswith("file://") else folder)


class _Bundle:
    """One file: frames as they fill, then the seek table."""

    def __init__(self, folder: str):
        import zstandard
        self.fs, root = _store(folder)
        self.fs.create_dir(root, recursive=True)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.final = f"{root}/{self.name}"
        self.out = self.fs.open_output_stream(self.final + ".part")
        self.pack = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, write_content_size=True)
        self.sizes: list[tuple[int, int]] = []
        self.buf, self.raw, self.written = [], 0, 0

    def add(self, parts: list) -> tuple[int, int, int]:
        """(frame, offset, length) of a record given as buffers."""
        length = sum(map(len, parts))
        place = (len(self.sizes), self.raw, length)
        self.buf += parts
        self.raw += length
        if self.raw >= FRAME_BYTES:
            self._flush()
        return place

    def _flush(self) -> None:
        if self.buf:
            stream = self.pack.compressobj(size=self.raw)
            size = 0
            for piece in (*(stream.compress(x) for x in self.buf), stream.flush()):
                self.out.write(piece)
                size += len(piece)
            self.sizes.append((size, self.raw))
            self.written += size
            self.buf, self.raw = [], 0

    def close(self) -> None:
        self._flush()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        self.fs.move(self.final + ".part", self.final)


def seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed size, raw size) of each frame of an open bundle."""
    size = f.size()
    f.seek(size - FOOTER_BYTES)
    n, _, magic = struct.unpack("<IBI", f.read(FOOTER_BYTES))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table at the end of the bundle")
    f.seek(size - FOOTER_BYTES - 8 * n)
    frames, at = [], 0
    for packed, raw in struct.iter_unpack("<II", f.read(8 * n)):
        frames.append((at, packed, raw))
        at += packed
    return frames


def _read_frame(f, frame: tuple[int, int, int]) -> bytes:
    import zstandard
    f.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(f.read(frame[1]), max_output_size=frame[2])


# ---- Spark jobs ---------------------------------------------------------

def _with_revisits(pages: DataFrame, min_bytes: int) -> tuple[DataFrame, int]:
    """Pages as (page_id, url, payload, sha1, refers_to), and the bytes of all payloads."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"),
                        F.coalesce("html", F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.unhex(F.sha1("payload")))
    slim = save(rows.select("page_id", "sha1", F.unhex(F.sha2("payload", 256)).alias("sha2"), F.length("payload").alias("n")), "payloads", pages.count())
    groups = (slim.where(F.col("n") >= min_bytes).groupBy("sha1", "sha2", "n")
              .agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("members")).where("members > 1 and keep is not null"))
    back = (slim.join(groups, ["sha1", "sha2", "n"]).where(~F.col("page_id").eqNullSafe(F.col("keep")))
            .select(F.col("page_id").alias("_id"), F.col("sha1").alias("_sha1"), F.col("keep").alias("refers_to")).distinct())
    size = slim.agg(F.sum("n")).first()[0] or 0
    return rows.join(back, rows["page_id"].eqNullSafe(back["_id"]) & (rows["sha1"] == back["_sha1"]), "left").drop("_id", "_sha1"), size


def _tasks(spark, size: int, most: int, least: int) -> int:
    """Tasks for so many bytes: at most ``most`` each, and not so many that
    each has fewer than ``least``."""
    return max(1, -(-size // most), min(-(-size // least), spark.sparkContext.defaultParallelism))


def write_archive(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0) -> tuple[str, DataFrame]:
    """Write all pages; returns the folder and the index of records."""
    folder = folder or scratch_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            # payloads stay where Arrow holds them
            for page_id, url, payload, sha1, refers_to in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to"))):
                bundle = bundle or _Bundle(folder)
                digest = base64.b32encode(sha1.as_py()).decode()
                rows.append((page_id.as_py(), bundle.name, *bundle.add(record_parts(page_id.as_py(), url.as_py(), payload.as_buffer(), digest, refers_to.as_py()))))
                if bundle.written >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
                zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                names=["page_id", "bundle", "frame", "offset", "length"])
        if bundle:
            bundle.close()

    # the join deals payloads by id, so neither a hot payload nor a hot host makes one large file
    rows, size = _with_revisits(pages, min_revisit_bytes)
    # a bundle for each task: of a useful size, however many shuffle partitions there are
    rows = rows.coalesce(_tasks(pages.sparkSession, size, READ_BYTES, 4 * FRAME_BYTES)).sortWithinPartitions("page_id")
    return folder, save(map_arrow(rows, write, INDEX_SCHEMA), "warc-index")


def _open(folder: str, name: str):
    fs, root = _store(folder)
    return fs.open_input_file(f"{root}/{name}")


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("digest_ok", pa.bool_())])
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def read_archive(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archive, read frame by frame.  The index only names
    the bundles and their frames; records are parsed from the bytes.  Frames
    are dealt in runs, READ_BYTES a task, so a bundle's seek table is read once
    a run and no task reads more than its share."""
    tasks = _tasks(index.sparkSession, index.agg(F.sum("length")).first()[0] or 0, READ_BYTES, FRAME_BYTES)
    run = F.expr(f"frame div {RUN_FRAMES}")
    frames = index.select("bundle", "frame").distinct().repartition(tasks, F.col("bundle"), run).sortWithinPartitions("bundle", "frame")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, table = None, None, []
        for batch in batches:
            for bundle, frame in zip(batch.column("bundle").to_pylist(), batch.column("frame").to_pylist()):
                if bundle != name:
                    if f is not None:
                        f.close()
                    name, f = bundle, _open(folder, bundle)
                    table = seek_table(f)
                data, rows, at = _read_frame(f, table[frame]), [], 0
                while at < len(data):
                    row, at = parse_record(data, at, payloads)
                    rows.append(row)
                yield _record_batch(rows)
        if f is not None:
            f.close()

    return map_arrow(frames, read, RECORD_SCHEMA)


def read_records(folder: str, places: DataFrame) -> DataFrame:
    """The records at the given index rows, by seeking."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, last, data = [], None, b""
            for r in sorted(batch.to_pylist(), key=lambda r: (r["bundle"], r["frame"], r["offset"])):
                if (r["bundle"], r["frame"]) != last:
                    last = (r["bundle"], r["frame"])
                    with _open(folder, r["bundle"]) as f:
                        data = _read_frame(f, seek_table(f)[r["frame"]])
                rows.append(parse_record(data, r["offset"])[0])
            yield _record_batch(rows)

    return map_arrow(places, read, RECORD_SCHEMA)
