"""The periodic check of remote documents for changes."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.catalog import due_for_refresh, new_jobs
from lodestone.session import work_path
from lodestone.sources.landing import allowed_scheme
from lodestone.sources.remote import Fetch, fetch, fetch_any


@dataclass(frozen=True)
class Sweep:
    """``changed``: documents with new content and ETag; ``jobs`` and ``collections`` to store."""

    changed: DataFrame
    jobs: DataFrame
    collections: DataFrame


def refresh_sweep(collections: DataFrame, documents: DataFrame, now: datetime, get: Fetch = fetch_any) -> Sweep:
    """Ask the source of every document of a due collection whether it changed.

    Unchanged, unreachable and uploaded documents write nothing.  Each document
    is asked once: the answers go to a table before anything uses them.
    """
    spark = documents.sparkSession
    stamp = F.lit(now).cast("timestamp")
    due = due_for_refresh(collections, stamp).select(F.col("id").alias("collection_id"), "last_auto_refresh_at")
    asked = documents.where(allowed_scheme(F.col("file_uri"))).join(due, "collection_id")
    answers = fetch(asked, get, seen="last_auto_refresh_at")
    new = answers.where(~F.col("fetched.not_modified") & F.col("fetched.error").isNull())
    path = work_path(spark, "refresh")
    new.select(*documents.columns, F.col("fetched.content").alias("content"), F.col("fetched.etag").alias("new_etag")).write.parquet(path)
    changed = spark.read.parquet(path)
    jobs = new_jobs(changed.select("collection_id", "file_uri", "mime_type", "extra_json"), "auto_refresh", stamp)
    # One stamp per collection, not one per document.
    checked = due.select(F.col("collection_id").alias("id"), F.lit(True).alias("_checked"))
    stamped = F.when(F.col("_checked"), stamp).otherwise(F.col("last_auto_refresh_at"))
    touched = collections.join(checked, "id", "left").withColumn("last_auto_refresh_at", stamped)
    return Sweep(changed, jobs, touched.select(*collections.columns))
