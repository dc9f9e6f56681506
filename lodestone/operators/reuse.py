"""What a fresh parse of documents shares with their stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["document_id", "chunk_hash"]


def with_stored_vectors(fresh: DataFrame, stored: DataFrame, hashed: Column, deal: str, tasks: int) -> DataFrame:
    """Add ``stored_vector``: the vector of an equal chunk of the same document.

    One shuffle, by the column ``deal`` of both sides, after which rows can stay where
    they are.  Each of the ``tasks`` takes the deal of its number: by a hash several would
    meet in one task, whose sort would spill.  A deal holds all rows of a key, so a task finds a key's vectors among its
    own rows, and a repeated text cannot multiply them.  ``hashed`` makes a fresh row's
    hash anew behind the shuffle, which need not carry it.
    """
    known = stored.select(deal, *KEY, F.col("vector").alias("_known"))
    rows = fresh.drop("chunk_hash").withColumn("_fresh", F.lit(True)).unionByName(known, allowMissingColumns=True)
    rows = rows.repartitionById(tasks, deal).withColumn("chunk_hash", F.coalesce("chunk_hash", hashed))
    # Equal texts have equal vectors; of several the largest is the same on every run.
    vector = F.max("_known").over(Window.partitionBy(deal, *KEY))
    return rows.withColumn("stored_vector", vector).where("_fresh").drop("_fresh", "_known")


def to_embed(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh chunks without an equal stored chunk."""
    return fresh.join(stored.select(*KEY).distinct(), KEY, "left_anti")


def stale_chunks(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored chunks whose text no longer occurs in the fresh parse of their document."""
    return stored.join(fresh.select(*KEY).distinct(), KEY, "left_anti")


def reuse_counts(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Per document: chunks, how many were reused, how many old ones went stale."""
    matched = fresh.join(stored.select(*KEY).distinct().withColumn("_known", F.lit(1)), KEY, "left")
    now = matched.groupBy("document_id").agg(
        F.count("*").alias("chunk_count"), F.count("_known").alias("reused_chunks")
    )
    before = stored.groupBy("document_id").agg(F.count("*").alias("previous_chunks"))
    joined = now.join(before, "document_id", "left")
    stale = F.greatest(F.coalesce("previous_chunks", F.lit(0)) - F.col("reused_chunks"), F.lit(0))
    return joined.select("document_id", "chunk_count", "reused_chunks", stale.alias("stale_chunks"))
