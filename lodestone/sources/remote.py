"""Fetching documents by URI, plainly or only when they changed."""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.sources.landing import detect_mime, has_known_extension, is_web

TIMEOUT_SECONDS = 60
USER_AGENT = "lodestone/1.0"
HELD_BYTES = 8 * 1024 * 1024  # of bodies, before a task hands them on
FETCHED = T.StructType(
    [
        T.StructField("content", T.BinaryType()),
        T.StructField("not_modified", T.BooleanType()),
        T.StructField("etag", T.StringType()),
        T.StructField("last_modified", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("took_ms", T.LongType()),
    ]
)


@dataclass
class Fetched:
    content: bytes | None = None
    not_modified: bool = False
    etag: str | None = None
    last_modified: str | None = None
    content_type: str | None = None
    error: str | None = None
    took_ms: int | None = None


Fetch = Callable[[str, str | None, str | None], Fetched]


def fetch_http(uri: str, etag: str | None = None, last_modified: str | None = None) -> Fetched:
    """GET, conditional when a validator is known; anything but 200 and 304 is an error."""
    headers = {"User-Agent": USER_AGENT}
    if etag:
        headers["If-None-Match"] = etag
    if last_modified:
        headers["If-Modified-Since"] = last_modified
    try:
        with urllib.request.urlopen(urllib.request.Request(uri, headers=headers), timeout=TIMEOUT_SECONDS) as reply:
            if reply.status != 200:
                return Fetched(error=f"unexpected status {reply.status}")
            h = reply.headers
            return Fetched(reply.read(), False, h.get("ETag"), h.get("Last-Modified"), h.get("Content-Type"))
    except urllib.error.HTTPError as err:
        if err.code == 304:
            return Fetched(not_modified=True, etag=etag, last_modified=last_modified)
        return Fetched(error=f"unexpected status {err.code}")


def head_content_type(uri: str) -> str | None:
    """What the server calls the resource; only a plain 200 is believed."""
    request = urllib.request.Request(uri, headers={"User-Agent": USER_AGENT}, method="HEAD")
    with urllib.request.urlopen(request, timeout=5) as reply:
        return reply.headers.get("Content-Type") if reply.status == 200 else None


def fetch_s3(uri: str, etag: str | None = None, last_modified: str | None = None) -> Fetched:
    """Needs ``boto3`` on the executors; whole prefixes are read with ``binaryFile`` instead."""
    try:
        import boto3
        from botocore.exceptions import ClientError
    except ImportError:
        return Fetched(error="boto3 is not installed on this executor")
    where = urlparse(uri)
    condition = {"IfNoneMatch": etag} if etag else {}
    try:
        reply = boto3.client("s3").get_object(Bucket=where.netloc, Key=where.path.lstrip("/"), **condition)
    except ClientError as err:
        if err.response.get("ResponseMetadata", {}).get("HTTPStatusCode") == 304:
            return Fetched(not_modified=True, etag=etag, last_modified=last_modified)
        return Fetched(error=str(err))
    return Fetched(reply["Body"].read(), False, reply.get("ETag"), str(reply.get("LastModified")), reply.get("ContentType"))


def fetch_local(uri: str, etag: str | None = None, last_modified: str | None = None) -> Fetched:
    with open(uri.removeprefix("file://"), "rb") as f:
        return Fetched(f.read())


def fetch_any(uri: str, etag: str | None = None, last_modified: str | None = None) -> Fetched:
    if uri.startswith(("http://", "https://")):
        return fetch_http(uri, etag, last_modified)
    if uri.startswith("s3://"):
        return fetch_s3(uri, etag, last_modified)
    if uri.startswith("upload://"):
        return Fetched(error="the uploaded content is gone; upload the file once more")
    return Fetched(error="fetch: only http, https and s3 addresses are fetched")


def answered(batches: Iterator[pa.RecordBatch], get: Fetch, columns: list[str], limit: int = HELD_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows that end in an address, an ETag and a date, with the answer in their place.

    A batch goes out as soon as its bodies have ``limit`` bytes, so a task holds
    that much and one body more, however many rows came in at once.
    """
    for batch in batches:
        uris, etags, since = (batch.column(batch.num_columns - k).to_pylist() for k in (3, 2, 1))
        first, held, out = 0, 0, []
        for i, (u, e, s) in enumerate(zip(uris, etags, since), 1):
            started = time.monotonic()
            try:
                got = get(u, e, s)
            except Exception as err:
                got = Fetched(error=f"fetch: {err}")
            out.append(vars(got) | {"took_ms": int((time.monotonic() - started) * 1000)})
            held += len(got.content or b"")
            if held >= limit or i == batch.num_rows:
                kept = [batch.column(k).slice(first, i - first) for k in range(batch.num_columns - 3)]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(out, to_arrow_type(FETCHED))], columns)
                first, held, out = i, 0, []


def fetch(rows: DataFrame, get: Fetch = fetch_any, uri: str = "file_uri", etag: str = "last_etag", seen: str | None = None) -> DataFrame:
    """Add ``fetched`` for each URI; one failing URI is an error of its row only.

    Each row is one request, issued from whichever task holds the row.
    """
    none = F.lit(None).cast("string")
    known = F.col(etag) if etag in rows.columns else none
    since = none if seen is None else F.date_format(F.col(seen), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")
    asked = rows.select("*", F.col(uri).alias("asked_uri"), known.alias("asked_etag"), since.alias("asked_since"))
    schema = T.StructType([*rows.schema.fields, T.StructField("fetched", FETCHED)])
    columns = schema.fieldNames()
    return asked.mapInArrow(lambda batches: answered(batches, get, columns), schema)


def probe_types(rows: DataFrame, head: Callable[[str], str | None] = head_content_type, uri: str = "file_uri") -> DataFrame:
    """Add ``mime_type``: by extension, or else by asking the server of a web address."""

    @F.arrow_udf(T.StringType())
    def ask(uris: pa.Array) -> pa.Array:
        out = []
        for u in uris.to_pylist():
            try:
                out.append(None if u is None else head(u))
            except Exception:
                out.append(None)
        return pa.array(out, pa.string())

    unnamed = is_web(F.col(uri)) & ~has_known_extension(F.col(uri))
    asked = rows.withColumn("_told", ask.asNondeterministic()(F.when(unnamed, F.col(uri))))
    return asked.withColumn("mime_type", detect_mime(F.col(uri), F.col("_told"))).drop("_told")


def with_types(rows: DataFrame, head: Callable[[str], str | None] = head_content_type, uri: str = "file_uri") -> DataFrame:
    """``rows`` with a ``mime_type`` where none is given; only addresses without one are asked for."""
    given = F.nullif(F.col("mime_type"), F.lit("")) if "mime_type" in rows.columns else F.lit(None).cast("string")
    named = rows.withColumn("_given", given)
    asked = F.when(F.col("_given").isNull(), F.col(uri))
    probed = probe_types(named.withColumn("_asked", asked), head, "_asked")
    return probed.withColumn("mime_type", F.coalesce("_given", "mime_type")).drop("_given", "_asked")
