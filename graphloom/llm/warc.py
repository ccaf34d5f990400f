"""WARC archives as seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding some whole
WARC/1.1 records, and ends with the seek table of the seekable format (a
skippable frame with each frame's sizes and a footer).  The index maps every
record identifier to its bundle, frame, and the record's place in the
decompressed frame; a reader seeks to a frame and decompresses nothing else.

Bundles go to shared storage, written by the tasks under names of their own,
so a task that runs again writes new bundles and the index names only those of
the attempt that counted.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_arrow, materialise, new_path, utf8

#: Fixed values of the seekable Zstandard format: the skippable frame that
#: holds the table, and the number in the last four bytes.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
#: Bytes of records in a frame, and of frames in a bundle, before the next begins.
FRAME_BYTES, BUNDLE_BYTES = 1 << 20, 1 << 28
#: Bytes of records that a task reads back; what makes a payload hot.
TASK_BYTES, HOT, HOT_SHARE = 1 << 24, 1_000, 1_000
#: The records of an archive carry one date, so that reruns write equal bytes.
RECORD_DATE = "2024-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame int, frame_offset long, frame_size long, record_offset long, record_size long"


def _payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _header_value(text: str) -> str:
    """A URL as a header value: controls and spaces percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text)


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def encode_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or, without one, a revisit with the HTTP header only."""
    revisit = payload is None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{record_id(page_id)}>", f"WARC-Date: {RECORD_DATE}"]
    if url:
        head.append(f"WARC-Target-URI: {_header_value(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{record_id(refers_to)}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers (names in lower case), HTTP headers, payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[: int(headers["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    """The footer frame for (compressed, decompressed) sizes, without checksums."""
    entries = b"".join(struct.pack("<II", c, d) for c, d in frames)
    footer = struct.pack("<IBI", len(frames), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer


def read_seek_table(stream, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame of a bundle."""
    stream.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    width = 12 if descriptor & 0x80 else 8
    stream.seek(size - 9 - n * width)
    raw, out, at = stream.read(n * width), [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", raw, i * width)
        out.append((at, c, d))
        at += c
    return out


class BundleWriter:
    """Writes records to bundles below a folder; memory holds one frame."""

    def __init__(self, folder: str, level: int = 3, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES):
        self.fs, self.path = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.path, recursive=True)
        self.folder, self.frame_bytes, self.bundle_bytes = folder, frame_bytes, bundle_bytes
        self.codec = zstandard.ZstdCompressor(level=level)
        self.stream, self.done = None, []

    def add(self, key: str, page_id: int | None, raw: bytes) -> None:
        if self.stream is None:
            self.name = f"bundle-{uuid.uuid4().hex}.warc.zst"
            self.stream = self.fs.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.frames, self.at, self.pending, self.buffer, self.size = [], 0, [], [], 0
        self.pending.append((key, page_id, self.size, len(raw)))
        self.buffer.append(raw)
        self.size += len(raw)
        if self.size >= self.frame_bytes:
            self._frame()
        if self.at >= self.bundle_bytes:
            self._finish()

    def _frame(self) -> None:
        if not self.buffer:
            return
        packed = self.codec.compress(b"".join(self.buffer))
        self.stream.write(packed)
        self.done += [(k, p, self.name, len(self.frames), self.at, len(packed), at, n) for k, p, at, n in self.pending]
        self.frames.append((len(packed), self.size))
        self.at += len(packed)
        self.pending, self.buffer, self.size = [], [], 0

    def _finish(self) -> None:
        if self.stream is not None:
            self._frame()
            self.stream.write(seek_table(self.frames))
            self.stream.close()
            self.stream = None

    def entries(self, last: bool = False) -> list[tuple]:
        """Index entries of the frames written since the last call."""
        if last:
            self._finish()
        out, self.done = self.done, []
        return out


def first_pages(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html (null for revisits), digest, bytes, first, revisit:
    first is the page that stores the payload, if several have it.

    Of equal payloads of least_bytes or more the smallest page_id stores it.
    A null page_id stores only what no other page does.  Payloads of more than
    one of HOT_SHARE pages are at most HOT_SHARE, so their list is broadcast:
    of those only the first copy is moved, and no task gets them all.
    """
    rows = pages.withColumn("digest", F.sha1(F.coalesce("html", F.lit("")).cast("binary"))).withColumn("bytes", F.coalesce(F.octet_length("html"), F.lit(0)).cast("long"))
    again = rows.filter(F.col("bytes") >= least_bytes).groupBy("digest", "bytes").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again = materialise(again, "payloads")
    most = max(HOT, pages.count() // HOT_SHARE)
    hot = F.broadcast(again.filter(F.col("n") > most).select("digest", "bytes", F.col("first").alias("hot_first"), F.lit(True).alias("hot")))
    rows = rows.join(hot, ["digest", "bytes"], "left")
    known = F.col("hot") & ~F.col("page_id").eqNullSafe(F.col("hot_first"))
    rows = rows.withColumn("html", F.when(known, F.lit(None)).otherwise(F.col("html")))
    # hot payloads have their partner: they are spread by page
    rows = rows.withColumn("key", F.when(F.col("hot"), F.concat_ws(" ", F.lit("hot"), "page_id", "url")).otherwise(F.col("digest")))
    rare = again.filter(F.col("n") <= most).select(F.col("digest").alias("key"), "bytes", "first")
    found = rows.join(rare, ["key", "bytes"], "left").withColumn("first", F.coalesce("hot_first", "first"))
    return found.withColumn("revisit", F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))).drop("key", "hot", "hot_first")


def write_archive(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Write a record per row to bundles below folder; returns the index.

    Null html is an empty payload; a payload of any length is one record.
    Repeated rows give records with one identifier, each with an entry of its
    own.  Other columns are left behind; an empty table gives an empty index.
    """
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    rows = first_pages(rows, least_bytes).select("page_id", "url", "html", "digest", "bytes", "first", "revisit")

    def run(batches) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            writer = writer or BundleWriter(folder)
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "bytes", "first", "revisit")]
            for (p, u, digest, size, first, revisit), payload in zip(zip(*columns), utf8(batch.column("html"))):
                writer.add(record_id(p), p, encode_record(p, u, None if revisit else payload, size, base64.b32encode(bytes.fromhex(digest)).decode(), first))
            if entries := writer.entries():
                yield _index_batch(entries)
        if writer and (entries := writer.entries(last=True)):
            yield _index_batch(entries)

    return materialise(map_arrow(rows, run, INDEX), "warc-index")


def _index_batch(entries: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.string(), pa.int32(), *[pa.int64()] * 4)
    names = [x.split()[0] for x in INDEX.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*entries), kinds)], names=names)


def read_archive(index: DataFrame, folder: str) -> DataFrame:
    """Records of the index, read back: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, payload (null for revisits).

    Tasks take frames, not bundles; a frame is read by its place in the
    bundle and decompressed once for all its records.  Frames are dealt by
    what they hold, not by the size of their index entries.
    """
    tasks = -(-(index.agg(F.coalesce(F.sum("record_size"), F.lit(0))).first()[0] or 1) // TASK_BYTES)
    frames = index.groupBy("bundle", "frame", "frame_offset", "frame_size").agg(F.collect_list(F.struct("record_offset", "record_size")).alias("records"))
    frames = frames.repartition(max(1, tasks))

    def page(urn: str | None) -> int | None:
        tail = (urn or "").strip("<>").rpartition(":")[2]
        return int(tail) if re.fullmatch(r"-?\d+", tail) else None

    def run(batches):
        fs, path = pafs.FileSystem.from_uri(folder)
        codec = zstandard.ZstdDecompressor()
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{path}/{row['bundle']}") as f:
                    f.seek(row["frame_offset"])
                    data = codec.decompress(f.read(row["frame_size"]))
                out = []
                for r in row["records"]:
                    warc, http, payload = decode_record(data[r["record_offset"] : r["record_offset"] + r["record_size"]])
                    revisit, digest = warc["warc-type"] == "revisit", warc["warc-payload-digest"].removeprefix("sha1:")
                    if not revisit and _payload_digest(payload) != digest:
                        raise ValueError(f"payload of {warc['warc-record-id']} came back changed")
                    out.append((page(warc["warc-record-id"]), warc.get("warc-target-uri"), int(http["content-length"]), digest, warc["warc-type"], page(warc.get("warc-refers-to")), None if revisit else payload))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])

    return map_arrow(frames, run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write pages to bundles in shared storage and list what is read back.

    A response's digest and size are those of the payload that was read; a
    revisit's are those its record states.
    """
    folder = new_path(spark, "warc")
    index = write_archive(pages, folder)
    back = read_archive(index, folder)
    return back.select("page_id", F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
