"""Bounded training samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SALTS = 32


def held_out(doc_id: Column) -> Column:
    """Documents no model learns from: a fifth, by checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sized(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc_id``, the given columns, and what :func:`sample` has to know of the text: its bytes and a hash."""
    return docs.select("doc_id", *columns, F.octet_length("text").alias("_bytes"), F.xxhash64("text").alias("_text"))


def sample(docs: DataFrame, label: str, per_label: int, max_bytes: int, total: int) -> DataFrame:
    """From ``sized`` documents with a label: ``doc_id, <label>, _text`` of at most ``per_label`` documents of each label and ``total`` in all.

    Documents are taken in the order of a hash of their id, among those with a
    label, an id and a text of 1 to ``max_bytes`` bytes, held-out ones excepted;
    of equal texts with one label the first counts.  No text is shuffled.  Ranks are
    limited in each task, then in ``SALTS`` shares of a label, then for the label, so
    a label of a third of all rows meets in one task with ``SALTS * per_label`` rows
    at most.
    """
    usable = docs.where(
        F.col(label).isNotNull() & F.col("doc_id").isNotNull() & F.col("_bytes").between(1, max_bytes) & ~held_out(F.col("doc_id"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    share = F.pmod(F.xxhash64("doc_id", F.lit("share")), F.lit(SALTS))
    rank = F.row_number().over(Window.partitionBy(label).orderBy(*order))
    rank_in_share = F.row_number().over(Window.partitionBy(label, "_share").orderBy(*order))
    distinct = usable.groupBy(label, "_text").agg(F.min("doc_id").alias("doc_id"))
    shared = distinct.select("doc_id", label, "_text", share.alias("_share")).withColumn("_rank", rank_in_share)
    chosen = shared.where(F.col("_rank") <= per_label).withColumn("_rank", rank).where(F.col("_rank") <= per_label)
    return chosen.orderBy("_rank", *order).limit(total).select("doc_id", label, "_text").dropDuplicates(["doc_id"])


def sampled_texts(docs: DataFrame, chosen: DataFrame, label: str, max_bytes: int) -> DataFrame:
    """``doc_id, <label>, text`` of the chosen documents, one row each however often an id is repeated."""
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("_text")).where(F.octet_length("text") <= max_bytes)
    met = texts.join(F.broadcast(chosen), ["doc_id", "_text"]).select("doc_id", label, "text")
    return met.groupBy("doc_id").agg(F.first(label).alias(label), F.first("text").alias("text"))
