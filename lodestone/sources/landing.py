"""Files waiting to be ingested: type detection, allow-lists and the landing folder."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_UPLOAD_MB = 20

# MIME type by file extension.
EXTENSION_MIME = {
    "pdf": "application/pdf",
    "md": "text/markdown",
    "markdown": "text/markdown",
    "html": "text/html",
    "htm": "text/html",
    "txt": "text/plain",
    "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation",
    "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet",
    "csv": "text/csv",
    "json": "application/json",
    "xml": "application/xml",
}
ALLOWED_MIME = sorted({*EXTENSION_MIME.values(), "text/xml"})
REMOTE_SCHEMES = ("http://", "https://", "s3://")


def is_web(uri: Column) -> Column:
    return uri.rlike("^https?://")


def allowed_scheme(uri: Column) -> Column:
    """Remote sources only: a request may not read the server's own files."""
    lowered = F.lower(uri)
    hit = F.lit(False)
    for scheme in REMOTE_SCHEMES:
        hit = hit | lowered.startswith(scheme)
    return hit


def base_mime(mime: Column) -> Column:
    return F.trim(F.substring_index(mime, ";", 1))


def _by_extension(uri: Column) -> Column:
    path = F.substring_index(F.lower(uri), "?", 1)
    table = F.create_map(*[F.lit(x) for item in EXTENSION_MIME.items() for x in item])
    return F.try_element_at(table, F.regexp_extract(path, r"\.([a-z]+)$", 1))


def has_known_extension(uri: Column) -> Column:
    return _by_extension(uri).isNotNull()


def detect_mime(uri: Column, content_type: Column | None = None) -> Column:
    """By extension before any query string, then the server's answer, then a default."""
    told = F.lit(None).cast("string") if content_type is None else F.nullif(base_mime(content_type), F.lit(""))
    probed = F.when(is_web(uri), F.coalesce(told, F.lit("text/html"))).otherwise(F.lit("text/plain"))
    return F.coalesce(_by_extension(uri), probed)


def upload_error(name: Column, mime: Column, size: Column | None = None, max_mb: int = MAX_UPLOAD_MB) -> Column:
    """Why a file is refused, or NULL.  A name without extension is judged by MIME type only."""
    extension = F.lower(F.regexp_extract(F.regexp_extract(name, "([^/]*)$", 1), r"\.([^.]*)$", 1))
    dotted = F.regexp_extract(name, "([^/]*)$", 1).contains(".")
    checks = F.when(
        dotted & ~extension.isin(*EXTENSION_MIME), F.concat(F.lit("no reader for the extension ."), extension)
    ).when(~base_mime(mime).isin(*ALLOWED_MIME), F.concat(F.lit("no reader for the type "), base_mime(mime)))
    if size is not None:
        checks = F.when(size > max_mb * 1024 * 1024, F.lit("the file is larger than an upload may be")).otherwise(checks)
    return checks


_ORIGIN = "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?"


def upload_uri(path: Column, root: str) -> Column:
    """``upload://`` and the path below the landing root, so equal file names stay apart.

    A first folder that begins with ``@`` marks a version and is left out: a
    landing stream reads a path once, so a changed file lands as ``@2/name``.
    """
    below = re.sub(_ORIGIN, "", root).rstrip("/") + "/"
    relative = F.substring(F.regexp_replace(path, _ORIGIN, ""), F.lit(len(below) + 1), F.length(path))
    return F.concat(F.lit("upload://"), F.regexp_replace(relative, "^@[^/]*/", ""))


def as_uploads(listing: DataFrame, root: str, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """``binaryFile`` rows as uploads; a refused file carries the reason instead of content."""
    uri = upload_uri(F.col("path"), root)
    mime = detect_mime(F.col("path"))
    rows = listing.select(
        uri.alias("file_uri"),
        mime.alias("mime_type"),
        F.col("modificationTime").alias("modified"),
        "content",
        upload_error(F.col("path"), mime, F.col("length"), max_mb).alias("refused"),
    )
    return rows.withColumn("content", F.when(F.col("refused").isNull(), F.col("content")))


def read_landing(spark: SparkSession, path: str, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return as_uploads(listing, path, max_mb)


def stream_landing(spark: SparkSession, path: str, max_files: int = 1000, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """The landing folder as a stream; ``max_files`` per batch is the back-pressure.

    A path is read once: a new version of ``a/b.md`` lands as ``@2/a/b.md``.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    listing = (
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("maxFilesPerTrigger", max_files)
        .option("recursiveFileLookup", True)
        .load(path)
    )
    return as_uploads(listing, path, max_mb)
