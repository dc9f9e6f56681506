"""What may be ingested, decided before a job exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.metadata import is_json
from lodestone.sources.landing import MAX_UPLOAD_MB, allowed_scheme, upload_error


def refusal(files: DataFrame, max_mb: int = MAX_UPLOAD_MB) -> Column:
    """Why a row of ``files(file_uri, mime_type[, content, metadata, extra_json])`` is refused, or NULL.

    A row without content names a remote address, so its scheme has to be on the
    list; a row with content is judged by name, type and size.
    """

    def given(name: str, kind: str) -> Column:
        return (F.col(name) if name in files.columns else F.lit(None)).cast(kind)

    uri, content = F.trim("file_uri"), given("content", "binary")
    metadata, extra = given("metadata", "string"), given("extra_json", "string")
    return F.coalesce(
        F.when(F.coalesce(F.length(uri), F.lit(0)) == 0, "the address is empty"),
        F.when(content.isNull() & ~allowed_scheme(uri), "the address has no scheme that is fetched"),
        F.when(content.isNotNull(), upload_error(uri, F.coalesce("mime_type", F.lit("")), F.octet_length(content), max_mb)),
        F.when(metadata.isNotNull() & ~(is_json(metadata) & F.ltrim(metadata).startswith("{")), "the metadata is no JSON object"),
        F.when(extra.isNotNull() & (extra != "") & ~is_json(extra), "the extra JSON is not valid"),
    )


def admitted(files: DataFrame, max_mb: int = MAX_UPLOAD_MB) -> DataFrame:
    """``files`` with ``refused``: the reason, or NULL for a row that may become a job."""
    return files.withColumn("refused", refusal(files, max_mb))
