"""Web archives with dictionary-compressed records.

Records are WARC/1.1; a payload seen before is a ``revisit`` that names the first
record.  A Zstandard dictionary is built from a bounded sample of records and put
into a leading skippable frame of every archive; each record follows as a frame of
its own, so one record can be read without the others, and an archive without
anything else.

Tasks write through the file system of the target URI and give a manifest row per
archive.  A repeated task writes under another name; only archives in the manifest
table, which Spark commits once, are ever read.

A null payload is an empty one, a null URL an empty one; line breaks in a URL are
percent-encoded.  Of equal payloads the row with the smallest ``page_id`` is the
response (null last); rows that repeat its id are responses too.  A payload of any
length is one record.  No pages give no archive.  Other columns are ignored.
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

from lodestone.llm.membership import FEW, outside_and_maybe
from lodestone.session import work_path

# Fixed values of the formats.
SKIPPABLE_MAGIC = 0x184D2A5D
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

DICTIONARY_BYTES = 112 * 1024
SAMPLE_RECORDS = 1_000  # records the dictionary is built from, at most
SAMPLE_BYTES = 16 * 1024  # of each
ARCHIVE_BYTES = 256 * 1024 * 1024  # compressed; a new archive starts beyond
LEVEL = 6

_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the URL namespace of UUID version 5


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}')}>"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def build_record(page_id, url: str, payload: bytes, digest: str, first: int | None) -> bytes:
    """One WARC record: a response with its payload, or a revisit of ``first`` without it."""
    url = url.replace("\r", "%0D").replace("\n", "%0A")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    http += b"Content-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if first is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Target-URI: {url}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if first is not None:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(first)}", f"X-Refers-To-Page: {first}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and the HTTP body of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    length = int(headers["content-length"])
    if len(rest) != length + 4:
        raise ValueError("a record's length does not match")
    return headers, rest[:length].partition(b"\r\n\r\n")[2]


def train_dictionary(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; empty where they are too few to learn from."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def dictionary_frame(dictionary: bytes) -> bytes:
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(packed)) + packed


def _options(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


class ArchiveWriter:
    """Archives of one task, the next begun when one is full."""

    def __init__(self, target: str, dictionary: bytes) -> None:
        self.files, self.folder = fs.FileSystem.from_uri(target)
        self.scheme = target
        self.frame = dictionary_frame(dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, **_options(dictionary))
        self.out, self.done = None, []

    def write(self, record: bytes) -> None:
        if self.out is None:
            self.name = f"{uuid.uuid4().hex}.warc.zst"
            # Left to detect it, the file system would compress the archive once more, for its ending.
            self.out = self.files.open_output_stream(f"{self.folder}/{self.name}", compression=None)
            self.out.write(self.frame)
            self.size, self.records = len(self.frame), 0
        packed = self.compressor.compress(record)
        self.out.write(packed)
        self.size, self.records = self.size + len(packed), self.records + 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.records, self.size))
            self.out = None


def read_archive(stream) -> Iterator[bytes]:
    """The records of one archive from a file-like stream, one frame at a time."""
    magic, length = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE_MAGIC:
        raise ValueError("the archive has no leading dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(stream.read(length))
    opened = zstandard.ZstdDecompressor(**_options(dictionary))
    frame, record, pending = opened.decompressobj(), [], b""
    while True:
        chunk = pending or stream.read(1024 * 1024)
        if not chunk:
            break
        record.append(frame.decompress(chunk))
        pending = b""
        if frame.eof:
            yield b"".join(record)
            pending, record, frame = frame.unused_data, [], opened.decompressobj()
    if record:
        raise ValueError("the archive ends inside a record")


def _normal(uri: str) -> str:
    """The URI as the tasks' file systems (local, S3, GCS, HDFS) know it."""
    scheme, colon, rest = uri.partition(":")
    if not colon or scheme == "file":
        return "file:///" + (rest if colon else uri).lstrip("/")
    return f"{'s3' if scheme in ('s3a', 's3n') else scheme}:{rest}"


def with_first_pages(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, first``: ``first`` names an earlier page of equal payload, or is null.

    Payloads are compared by SHA-1 and length.  Digests are grouped with map-side
    combining and come back by page id, so a payload that a third of all pages
    share is never brought together.  The pages that repeat a payload are stored, and
    sent to all pages while they are few; of more, only pages that a bitmap of
    their ids lets through are shuffled.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce("url", F.lit("")).alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("length", F.octet_length("payload"))
    first = rows.groupBy("digest", "length").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = rows.select("page_id", "digest", "length").join(first, ["digest", "length"])
    again = again.where("page_id IS NULL OR page_id != first").distinct()
    again = again.select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), F.col("length").alias("_length"), "first")
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")) & (F.col("length") == F.col("_length"))
    path = work_path(pages.sparkSession, "warc-again")
    again.write.parquet(path)
    again = pages.sparkSession.read.schema(again.schema).parquet(path)
    kept = ["page_id", "url", "payload", "digest", "first"]
    if again.count() <= FEW:
        return rows.join(F.broadcast(again), same, "left").select(*kept)
    sure, maybe = outside_and_maybe(rows, "page_id", again.select(F.col("_page").alias("id")))
    return sure.withColumn("first", F.lit(None).cast("long")).select(*kept).unionByName(maybe.join(again, same, "left").select(*kept))


def _examples(pages: DataFrame) -> list[bytes]:
    """Records of a sample of pages, at most ``SAMPLE_RECORDS`` of ``SAMPLE_BYTES`` from anywhere in the page.

    The first pages by a hash of the id are taken, from a place that another hash of it gives.

    Ids are chosen first, below a hash that leaves about twice as many as needed,
    so what tasks send does not grow with the table; payloads follow for these alone.
    """
    share = min(2 * SAMPLE_RECORDS / max(pages.count(), 1), 1.0)
    place = F.xxhash64("page_id")
    low = F.pmod(place, F.lit(1 << 40)) < int(share * (1 << 40))
    chosen = pages.where(low).select("page_id").orderBy(place, "page_id").limit(SAMPLE_RECORDS)
    room = F.greatest(F.length("html") - SAMPLE_BYTES, F.lit(0)) + 1
    start = (F.pmod(F.xxhash64("page_id", F.lit("place")), room) + 1).cast("int")
    cut = F.substr("html", start, F.lit(SAMPLE_BYTES)).alias("html")
    rows = pages.where(low).select("page_id", "url", cut).join(F.broadcast(chosen.distinct()), "page_id").limit(SAMPLE_RECORDS)
    bodies = [(r.page_id, r.url or "", (r.html or "").encode()) for r in rows.collect()]
    return [build_record(page, url, html, payload_digest(html), None) for page, url, html in bodies]


def write_archives(pages: DataFrame, target: str) -> DataFrame:
    """Write every page as a record; the manifest ``archive, records, bytes`` as a committed table."""
    spark = pages.sparkSession
    target = _normal(target)
    rows = with_first_pages(pages)
    dictionary = train_dictionary(_examples(pages))
    files, folder = fs.FileSystem.from_uri(target)
    files.create_dir(folder, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = ArchiveWriter(target, dictionary)
        for batch in batches:
            columns = (batch.column(c) for c in ("page_id", "url", "payload", "first"))
            for page, url, payload, first in zip(*columns):
                body = payload.as_py()
                writer.write(build_record(page.as_py(), url.as_py(), body, payload_digest(body), first.as_py()))
        writer.close()
        if writer.done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*writer.done)], ["archive", "records", "bytes"])

    manifest = rows.select("page_id", "url", "payload", "first").mapInArrow(run, "archive string, records long, bytes long")
    path = work_path(spark, "warc-manifest")
    manifest.write.parquet(path)
    return spark.read.parquet(path)


def read_archives(manifest: DataFrame, target: str) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to`` of every record.

    Archives are dealt over the tasks; a response's payload is checked against its
    digest and length.
    """
    target = _normal(target)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = fs.FileSystem.from_uri(target)
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                rows = []
                with files.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for raw in read_archive(stream):
                        head, body = parse_record(raw)
                        digest, length = head["warc-payload-digest"].removeprefix("sha1:"), int(head["x-payload-length"])
                        kind = head["warc-type"]
                        if kind == "response" and (len(body) != length or payload_digest(body) != digest):
                            raise ValueError(f"a payload of {name} does not match its digest")
                        page, first = head["x-page-id"], head.get("x-refers-to-page")
                        url = head["warc-target-uri"]
                        rows.append((int(page) if page else None, url, length, digest, kind, int(first) if first else None))
                        if len(rows) == 5000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    # A number of tasks is left alone by the adaptive planner, which would merge so small a table into one.
    archives = manifest.select("archive").repartition(max(manifest.count(), 1))
    return archives.mapInArrow(
        run,
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long",
    )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    columns = zip(*rows) if rows else ([],) * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


def archive_folder(spark: SparkSession) -> str:
    return work_path(spark, "warc")
