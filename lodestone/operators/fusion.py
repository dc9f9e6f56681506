"""Weighted reciprocal-rank fusion of a vector list and a keyword list."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_group


@dataclass(frozen=True)
class HybridSettings:
    full_text_weight: float = 0.3
    semantic_weight: float = 0.7
    rrf_k: float = 60.0
    full_text_limit: int = 200

    def __post_init__(self) -> None:
        if self.full_text_weight < 0 or self.semantic_weight < 0:
            raise ValueError("weights must be at least 0")
        if self.rrf_k <= 0:
            raise ValueError("rrf_k must be greater than 0")
        if not 1 <= self.full_text_limit <= 1000:
            raise ValueError("full_text_limit must be between 1 and 1000")


def contribution(weight: float, k: float, rank: Column) -> Column:
    """``weight / (k + rank)`` in single precision, ``rank`` counted from 0."""
    return (F.lit(weight).cast("float") / (F.lit(k).cast("float") + rank.cast("float"))).cast("float")


def fuse(
    vector_hits: DataFrame, keyword_hits: DataFrame, settings: HybridSettings, top_k: int, payload: tuple[str, ...] = ()
) -> DataFrame:
    """The best ``top_k`` ids per ``query_id`` of both ranked lists.

    Each list carries ``query_id, id, rank`` and its own score columns.  A full
    outer join on the id is a union followed by one grouping, which merges both
    sides in a single shuffle.
    """
    nothing = F.lit(None).cast("float")
    carried = F.struct(*payload).alias("_payload") if payload else F.lit(None).alias("_payload")
    left = vector_hits.select(
        "query_id",
        "id",
        carried,
        contribution(settings.semantic_weight, settings.rrf_k, F.col("rank")).alias("_semantic"),
        nothing.alias("_text"),
        "vector_distance",
        "vector_similarity",
        F.lit(None).cast("double").alias("keyword_bm25_score"),
    )
    right = keyword_hits.select(
        "query_id",
        "id",
        carried,
        nothing.alias("_semantic"),
        contribution(settings.full_text_weight, settings.rrf_k, F.col("rank")).alias("_text"),
        F.lit(None).cast("double").alias("vector_distance"),
        F.lit(None).cast("double").alias("vector_similarity"),
        "keyword_bm25_score",
    )
    merged = (
        left.unionByName(right)
        .groupBy("query_id", "id")
        .agg(
            F.any_value("_payload", F.lit(True)).alias("_payload"),
            *[
                F.max(c).alias(c)
                for c in ("_semantic", "_text", "vector_distance", "vector_similarity", "keyword_bm25_score")
            ],
        )
    )
    both = F.col("_semantic") + F.col("_text")
    scored = merged.withColumn("rrf_score", F.coalesce(both, "_semantic", "_text"))
    best = top_per_group(scored, ["query_id"], [F.col("rrf_score").desc(), F.col("id")], top_k)
    top = F.max("rrf_score").over(Window.partitionBy("query_id"))
    normalized = F.when(top > 0, (F.col("rrf_score") / top).cast("float") * F.lit(100).cast("float"))
    best = best.withColumn("rrf_score_normalized", normalized)
    shown = [F.col("_payload")[c].alias(c) for c in payload]
    return best.select(
        "query_id",
        "rank",
        "id",
        *shown,
        "vector_distance",
        "vector_similarity",
        "keyword_bm25_score",
        "rrf_score",
        "rrf_score_normalized",
    )


def ranked(hits: DataFrame, order: list[Column]) -> DataFrame:
    """Number an already limited list from 0, as the only query."""
    window = Window.partitionBy("query_id").orderBy(*order)
    return hits.withColumn("query_id", F.lit(0)).withColumn("rank", F.row_number().over(window) - 1)
