"""WARC archives with a Zstandard dictionary: each archive starts with a skippable frame that holds a dictionary built from its own
records, and each record after it is compressed as a frame of its own, so a reader can start at any record.

Archives are written by Spark's text sink, which copies bytes as they are and commits whole task outputs to any file system Spark
can reach. It ends each row with a line feed; every row therefore ends in the header of a one-byte skippable frame, whose content
that line feed is, and the file is a plain Zstandard stream.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.llm.common import materialise


DICTIONARY_FRAME, PAD_FRAME, FRAME = 0x184D2A5D, 0x184D2A50, 0xFD2FB528
_PAD = struct.pack("<II", PAD_FRAME, 1)
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(c if c > "\x1f" and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def make_record(page_id: object, url: str | None, payload: bytes, digest: str, response: bool, refers_to: object, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if response else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if page_id is not None:
        lines.append(f"Page-ID: {page_id}")
    if not response:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers by lower-case name, and the payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = lambda x: {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in x.decode().split("\r\n")[1:])}
    warc = fields(head)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, fields(http), payload


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A trained dictionary; where the records are too few or too small to train one, the start of the records themselves, which
    Zstandard takes as a dictionary of raw content. Empty only without records."""
    total = sum(map(len, records))
    try:
        if len(records) >= 16 and total >= 8 * 1024:
            return zstandard.train_dictionary(min(size, total // 8), records, k=256, d=8, accel=8).as_bytes()
    except zstandard.ZstdError:  # too little that the samples share
        pass
    return b"".join(records)[: min(size, max(64, total // 8))]


def archive_rows(records: list[bytes], dictionary_bytes: int, level: int) -> Iterator[bytes]:
    """The archive's rows, each to be ended by a line feed."""
    dictionary = build_dictionary(records, dictionary_bytes)
    yield struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary + _PAD
    shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    compressor = zstandard.ZstdCompressor(level=level, write_checksum=True, **shared)
    if shared:
        shared["dict_data"].precompute_compress(level=level)
    for record in records:
        yield compressor.compress(record) + _PAD


def _frame_end(data: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends (RFC 8878)."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    at += 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        head = int.from_bytes(data[at : at + 3], "little")
        at += 3 + (1 if head >> 1 & 3 == 1 else head >> 3)
        if head & 1:
            return at + 4 * (flags >> 2 & 1)


def read_records(data: bytes) -> Iterator[tuple[int, bytes]]:
    """``offset, record`` of each record in an archive."""
    view, at = memoryview(data), 0
    reader = zstandard.ZstdDecompressor()
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic == FRAME:
            end = _frame_end(view, at)
            yield at, reader.decompress(view[at:end])
            at = end
        else:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_FRAME and size:
                reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size


def write_archives(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, archive_bytes: int = 32 << 20, dictionary_bytes: int = 64 << 10, level: int = 3, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes a record for each row of ``pages`` under ``path``, in archives of about ``archive_bytes`` of records.

    The payload is the page in UTF-8 (null: empty). Of rows with equal payloads of at least ``least_bytes``, those with the largest
    page id are responses and the others revisit them; smaller payloads are all responses. Null ids never have others refer to
    them; rows repeated with the same id and payload are responses alike. A null address is written as empty. Memory holds one
    archive's records. An empty table writes no archive.
    """
    source = pages.select(F.col(page_id).alias("page_id"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    source = source.withColumn("sha", F.unhex(F.sha1("payload")))
    large = source.where(F.octet_length("payload") >= least_bytes)
    response = large.groupBy("sha").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    # written, so that the join deals both sides out anew and Spark can split a hot payload's rows
    response = materialise(response.select("sha", "refers_to"), "responses")
    ready = source.join(response, "sha", "left").select("page_id", "url", "payload", "sha", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        held: list[bytes] = []
        size = 0

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, number
            name, rows, count = f"{part:06d}-{number:06d}", [], 0
            for row in archive_rows(held, dictionary_bytes, level):
                rows.append(row)
                if sum(map(len, rows[-64:])) > 1 << 20 or len(rows) >= 1000:
                    yield _rows(name, count, rows)
                    count += len(rows)
                    rows = []
            if rows:
                yield _rows(name, count, rows)
            held, size, number = [], 0, number + 1

        for batch in batches:
            ids, urls, _, shas, refers = (c.to_pylist() if i != 2 else c for i, c in enumerate(batch.columns))
            for i, payload in enumerate(batch.column(2)):
                digest = base64.b32encode(shas[i]).decode()
                response = refers[i] is None or refers[i] == ids[i]
                record = make_record(ids[i], urls[i], payload.as_py(), digest, response, refers[i], date)
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield from finish()
        if held:
            yield from finish()

    rows = ready.mapInArrow(run, "archive string, place long, frame binary")
    rows = rows.sortWithinPartitions("archive", "place").select("archive", F.col("frame").cast("string").alias("frame"))
    rows.write.partitionBy("archive").option("lineSep", "\n").text(path)


def _rows(name: str, first: int, rows: list[bytes]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(first, first + n), pa.int64()), pa.array(rows, pa.binary())], names=["archive", "place", "frame"])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of all archives under ``path``: ``archive, position, page_id, record_type, record_id, target_uri,
    payload_bytes, payload_digest, refers_to, refers_to_id`` and, if ``payloads``, ``payload`` (null for revisits).

    A response's length and digest are computed from its payload, and an archive whose header disagrees raises an error.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    schema = "archive string, position long, page_id long, record_type string, record_id string, target_uri string, payload_bytes long, payload_digest string, refers_to long, refers_to_id string, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        names = [x.split()[0] for x in schema.split(", ")]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, held = [], 0
                for at, record in read_records(content.as_py()):
                    warc, http, payload = parse_record(record)
                    digest, size = warc["warc-payload-digest"].removeprefix("sha1:"), int(http["content-length"])
                    response = warc["warc-type"] == "response"
                    if response and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (size, digest):
                        raise ValueError(f"{name}: the record at {at} doesn't match its digest")
                    rows.append((name, at, number(warc.get("page-id")), warc["warc-type"], warc["warc-record-id"], warc["warc-target-uri"], size, digest, number(warc.get("refers-to-page-id")), warc.get("warc-refers-to"), payload if response and payloads else None))
                    held += len(record)
                    if held > 4 << 20:
                        yield flush(rows)
                        rows, held = [], 0
                if rows:
                    yield flush(rows)

    out = files.mapInArrow(run, schema)
    return out if payloads else out.drop("payload")
