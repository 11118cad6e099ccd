"""WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a skippable frame at the end of a bundle lists the sizes of all
frames, so one record is read with two small requests.  The index maps a record to its bundle, its frame and its place in
the decompressed frame.  Writers name bundles afresh on every attempt and the index lists those of the attempts that
Spark has committed, so a repeated task leaves nothing that is read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.session import cut, width

# Bytes of records that a frame and a bundle take at most, one record at least.
FRAME_BYTES, BUNDLE_BYTES = 1 << 18, 32 << 20

# Payloads below this size are always stored whole.
REVISIT_BYTES = 100

# Fixed values of the formats.
SEEK_TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX = "page_id long, bundle string, frame int, offset int, length int"


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_bytes(row: dict, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One WARC/1.1 record; a revisit has the HTTP header of its payload, not the payload.

    A null url leaves its header out; control characters in a url are percent-encoded.
    """
    payload = (row["html"] or "").encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = [
        "WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http;msgtype=response",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if ord(c) < 33 or ord(c) == 127 else c for c in row["url"]))
    body = http
    if row["record_type"] == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{row['refers_to']}>"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_records(raw: bytes) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """(WARC headers, HTTP headers, payload) of the records in a decompressed frame."""

    def headers(block: bytes) -> dict[str, str]:
        return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:] if line)

    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        warc = headers(raw[at:end])
        start = end + 4
        body = raw[start : start + int(warc["Content-Length"])]
        middle = body.index(b"\r\n\r\n")
        yield warc, headers(body[:middle]), body[middle + 4 :]
        at = start + len(body) + 4


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """The skippable frame that ends a bundle: compressed and plain size of each frame, then the footer."""
    entries = b"".join(struct.pack("<II", *s) for s in sizes)
    return struct.pack("<II", SEEK_TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)


def read_seek_table(file, size: int) -> list[tuple[int, int, int]]:
    """(place, compressed size, plain size) of every frame of an open bundle."""
    file.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", file.read(9))
    if magic != SEEKABLE_MAGIC or flags:
        raise ValueError("not a bundle of this writer")
    file.seek(size - 9 - 8 * frames)
    place, out = 0, []
    for packed, plain in struct.iter_unpack("<II", file.read(8 * frames)):
        out.append((place, packed, plain))
        place += packed
    return out


class _Bundle:
    def __init__(self, folder: str):
        import zstandard

        fs, path = _fs(folder)
        self.name = f"{uuid.uuid4().hex}.warc.zst"
        self.file = fs.open_output_stream(f"{path}/{self.name}", compression=None)
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.sizes: list[tuple[int, int]] = []
        self.waiting: list[bytes] = []
        self.waits = self.total = 0

    def add(self, record: bytes) -> tuple[str, int, int, int]:
        if self.waits and self.waits + len(record) > FRAME_BYTES:
            self.flush()
        place = (self.name, len(self.sizes), self.waits, len(record))
        self.waiting.append(record)
        self.waits += len(record)
        self.total += len(record)
        return place

    def flush(self) -> None:
        packed = self.pack(b"".join(self.waiting))
        self.file.write(packed)
        self.sizes.append((len(packed), self.waits))
        self.waiting, self.waits = [], 0

    def close(self) -> None:
        if self.waiting:
            self.flush()
        self.file.write(seek_table(self.sizes))
        self.file.close()


def records(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, html, payload_digest, record_type, refers_to).

    Of equal payloads of at least ``revisit_bytes``, the smallest page_id is the response and all others refer to it; rows
    that share that page_id are all responses, and so are rows of a group in which no page_id is known.  A null payload
    is empty.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    digests = rows.select("page_id", F.sha2(F.encode("html", "UTF-8"), 256).alias("digest"), F.octet_length("html").alias("n"))
    copies = (
        digests.where(F.col("n") >= revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
        .where((F.col("n") > 1) & F.col("first_id").isNotNull()).select("digest", "first_id")
    )
    joined = rows.withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256)).join(copies, "digest", "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select(
        "page_id", "url", "html", F.col("digest").alias("payload_digest"),
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"),
    )


def write_bundles(rows: DataFrame, folder: str) -> DataFrame:
    """Write the records of :func:`records` below ``folder`` and return their index, itself a stored table."""

    fs, path = _fs(folder)
    fs.create_dir(path)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, out = None, []
        for batch in batches:
            for row in batch.to_pylist():
                if bundle is None:
                    bundle = _Bundle(folder)
                out.append((row["page_id"], *bundle.add(record_bytes(row))))
                if bundle.total >= BUNDLE_BYTES:
                    bundle.close()
                    bundle = None
            if out and bundle is None:
                yield _index_batch(out)
                out = []
        if bundle is not None:
            bundle.close()
        if out:
            yield _index_batch(out)

    return cut(rows.mapInArrow(write, INDEX))


def _index_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["page_id", "bundle", "frame", "offset", "length"])


def read_record(folder: str, bundle: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], dict[str, str], bytes]:
    """One record by its index entry: the seek table, one frame, and the record in it."""
    import zstandard

    fs, path = _fs(f"{folder}/{bundle}")
    with fs.open_input_file(path) as file:
        place, packed, plain = read_seek_table(file, file.size())[frame]
        file.seek(place)
        raw = zstandard.ZstdDecompressor().decompress(file.read(packed), max_output_size=plain)
    return next(parse_records(raw[offset : offset + length]))


def read_bundles(spark: SparkSession, folder: str, index: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to), one row per record of the indexed bundles.

    Payload sizes and digests of responses are taken from the payload as read and must equal the headers; those of a
    revisit are its headers'.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                fs, path = _fs(f"{folder}/{name}")
                with fs.open_input_file(path) as file:
                    for place, packed, plain in read_seek_table(file, file.size()):
                        file.seek(place)
                        found = [_facts(*r) for r in parse_records(unpack(file.read(packed), max_output_size=plain))]
                        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x, k) for x, k in zip(zip(*found), kinds)],
                            ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
                        )

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # Names are dealt out in turn: adaptive execution would merge the short list, and one task would read all bundles.
    return index.select("bundle").distinct().repartition(width(spark)).mapInArrow(read, schema)


def _facts(warc: dict[str, str], http: dict[str, str], payload: bytes) -> tuple:
    number = lambda urn: int(urn[10:-1]) if len(urn) > 11 else None  # noqa: E731  <urn:page:N>
    size, digest = int(http["Content-Length"]), warc["WARC-Payload-Digest"].removeprefix("sha256:")
    if warc["WARC-Type"] == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"damaged record {warc['WARC-Record-ID']}")
    return (
        number(warc["WARC-Record-ID"]), warc.get("WARC-Target-URI"), size, digest, warc["WARC-Type"], number(warc.get("WARC-Refers-To", "")),
    )
