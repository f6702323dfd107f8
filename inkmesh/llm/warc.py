"""Operator 3: WARC archives as seekable Zstandard bundles.

Each task writes one bundle: records are gathered into frames that decompress on their own, and a
skippable frame at the end holds the seek table (the public seekable format). The index that the
write returns maps each record to bundle, frame and offset inside the frame, so any record is read
by one ranged read and one decompression. The index is a written table; bundles of lost or repeated
attempts have other names and no index rows, so they are never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_join, scratch, slices, written

#: Fixed values of the seekable format: magic numbers of skippable frame and footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Fixed value of the WARC standard: profile of revisit records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id {id}, record_id string, bundle string, frame int, offset long, length long"


def references(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """``page_id, url, payload, digest, refers_to, refers_url``: the smallest page_id among equal payloads and its url, null for
    that page itself and for payloads under ``smallest`` bytes. Pages that repeat the smallest id with its payload are
    responses too. Pages of a very frequent payload are spread over tasks."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    large = rows.filter(F.octet_length("payload") >= smallest)
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.min_by("url", "page_id").alias("first_url"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = written(first, "payloads")
    joined = hot_join(rows, first.drop("n"), "digest", first.select("digest", "n"), "left")
    other = (F.octet_length("payload") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", F.when(other, F.col("first_id")).alias("refers_to"), F.when(other, F.col("first_url")).alias("refers_url"))


def plain(value: object) -> str:
    """A header value in one line, to be read back by ``unquote``."""
    return quote(str(value), safe=" :/?#[]@!$&'()*+,;=-._~|{}\"<>^`\\")


def record(rid: str, page_id: object, url: str | None, payload: bytes, digest: str, refers_to: object, refers_url: str | None, date: str) -> bytes:
    """One WARC/1.1 record; a revisit keeps the HTTP header block and leaves out the payload. Page ids have fields of their own."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{rid}>", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        head.append(f"Page-ID: {plain(page_id)}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To-Date: {date}", f"Refers-To-Page-ID: {plain(refers_to)}"]
        if refers_url is not None:
            head.append("WARC-Refers-To-Target-URI: " + refers_url.replace("\r", "%0D").replace("\n", "%0A"))
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class Bundle:
    """Writes frames and, on closing, the seek table."""

    def __init__(self, out, frame_bytes: int, level: int):
        self.out, self.limit, self.zip = out, frame_bytes, zstandard.ZstdCompressor(level=level)
        self.table, self.parts, self.size = [], [], 0

    def add(self, raw: bytes) -> tuple[int, int]:
        """Frame of the record and its offset there."""
        if self.parts and self.size + len(raw) > self.limit:
            self.flush()
        at = (len(self.table), self.size)
        self.parts.append(raw)
        self.size += len(raw)
        return at

    def flush(self) -> None:
        if self.parts:
            packed = self.zip.compress(b"".join(self.parts))
            self.out.write(packed)
            self.table.append((len(packed), self.size))
            self.parts, self.size = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


def seek_table(source) -> list[tuple[int, int]]:
    """Start and size of each frame, read from the end of a bundle."""
    end = source.size()
    source.seek(end - 9)
    n, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    source.seek(end - 9 - 8 * n)
    sizes, at, out = struct.unpack(f"<{2 * n}I", source.read(8 * n)), 0, []
    for size in sizes[::2]:
        out.append((at, size))
        at += size
    return out


def write(pages: DataFrame, folder: str | None = None, frame_bytes: int = 1 << 18, level: int = 3, smallest: int = 100, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row of ``pages(page_id, url, html)`` and returns the index.

    Null html is an empty payload, a null url leaves the header out, a null page_id too. Record ids are unique, also where
    page_ids repeat. ``date`` is the records' WARC-Date, one for all, so that results do not depend on the clock.
    A record larger than ``frame_bytes`` has a frame to itself. An empty table writes nothing and gives an empty
    index. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or scratch(spark, "warc")
    schema = INDEX.format(id=pages.schema["page_id"].dataType.simpleString())
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        bundle, count = None, 0
        for whole in batches:
            for batch in slices(whole, "payload", 8 << 20):
                if bundle is None:
                    store, path = fs.FileSystem.from_uri(name)
                    store.create_dir(path.rpartition("/")[0], recursive=True)
                    bundle = Bundle(store.open_output_stream(path, compression=None), frame_bytes, level)
                rows = []
                for x in batch.to_pylist():
                    rid = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{count}')}"
                    raw = record(rid, x["page_id"], x["url"], x["payload"], x["digest"], x["refers_to"], x["refers_url"], date)
                    rows.append((rid, name, *bundle.add(raw), len(raw)))
                    count += 1
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.int64())], names)
        if bundle is not None:
            bundle.close()

    return written(references(pages, smallest).mapInArrow(run, schema), "warc-index")


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records of an index: ``page_id, url, record_type, payload_bytes, payload_digest, refers_to`` and ``payload``
    (null for revisits). Responses are hashed again and must match their header. Frames are read once per task."""
    kind = index.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {kind}" + (", payload binary" if with_payload else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip, at, source, table, data = zstandard.ZstdDecompressor(), (None, None), None, [], b""
        out_schema = None
        for whole in batches:
            pid = whole.schema.field("page_id").type
            for k in range(0, whole.num_rows, 256):
                rows = []
                for x in whole.slice(k, 256).to_pylist():
                    if x["bundle"] != at[0]:
                        store, path = fs.FileSystem.from_uri(x["bundle"])
                        source = store.open_input_file(path)
                        table, at = seek_table(source), (x["bundle"], None)
                    if x["frame"] != at[1]:
                        start, size = table[x["frame"]]
                        source.seek(start)
                        data, at = unzip.decompress(source.read(size)), (x["bundle"], x["frame"])
                    warc, http, payload = parse(data[x["offset"] : x["offset"] + x["length"]])
                    digest, type_ = warc["WARC-Payload-Digest"].partition(":")[2], warc["WARC-Type"]
                    if type_ == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"digest of {warc['WARC-Record-ID']} does not match")
                    to = warc.get("Refers-To-Page-ID")
                    to = None if to is None else unquote(to)
                    rows.append((x["page_id"], warc.get("WARC-Target-URI"), type_, int(http["Content-Length"]), digest, to, payload if type_ == "response" else None))
                c = list(zip(*rows))
                cols = [pa.array(c[0], pid), pa.array(c[1], pa.string()), pa.array(c[2]), pa.array(c[3], pa.int64()), pa.array(c[4]), pa.array(c[5], pa.string()).cast(pid)]
                names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
                if with_payload:
                    cols, names = [*cols, pa.array(c[6], pa.binary())], [*names, "payload"]
                yield pa.RecordBatch.from_arrays(cols, names)

    return index.repartition("bundle", "frame").sortWithinPartitions("bundle", "frame", "offset").mapInArrow(run, schema)
