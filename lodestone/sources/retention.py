"""Age and size limits for immutable telemetry files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.running import running_total
from lodestone.sources import files


def file_listing(spark: SparkSession, root: str) -> DataFrame:
    """``(path, modified, bytes)`` of all Parquet files; contents are not read."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", True)
    return listing.load(root).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"))


def kept_files(listing: DataFrame, now: Column, days: int, max_bytes: int) -> DataFrame:
    """Files young enough and within the newest ``max_bytes``.

    Deleting the oldest file until the total fits leaves exactly those files
    whose running total, counted from the newest, stays within the cap.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp("modified")
    young = listing.where(age <= F.lit(days * 86400))
    # All levels descend, so the total runs from the newest file to the oldest.  Files
    # of one instant are told apart by a hash: even a bulk copy spreads over tasks.
    micros = F.unix_micros("modified")
    levels = [
        -F.floor(micros / 86_400_000_000),
        -F.floor(micros / 1_000_000),
        -micros,
        F.pmod(F.xxhash64("path"), F.lit(1024)),
    ]
    total = running_total(young, "bytes", levels, [F.col("path")], "newer_bytes")
    return total.where(F.col("newer_bytes") <= max_bytes)


def enforce(spark: SparkSession, root: str, now: Column, days: int, max_mb: int) -> int:
    """Delete what may not stay and return how many files that was."""
    listing = file_listing(spark, root)
    kept = kept_files(listing, now, days, max_mb * 1024 * 1024).select("path")
    removed = 0
    for row in listing.join(kept, "path", "left_anti").toLocalIterator():
        removed += files.delete(spark, row.path)
    return removed
