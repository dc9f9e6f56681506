"""Retrieval-augmented answers: retrieve, build the context, fill the prompt, complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import CONTEXT_SEPARATOR, context_block, render_prompt
from lodestone.operators.completion import LanguageModel, complete_column
from lodestone.plans.retrieval import at_least


def build_context(results: DataFrame) -> DataFrame:
    """``(query_id, context)``: the kept results in rank order, numbered from 1."""
    # A query keeps at most top_k results, so the list is bounded.
    listed = results.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "source_name", "chunk_header", "chunk_text"))).alias("_hits")
    )
    blocks = F.transform(
        "_hits", lambda h, i: context_block(i + 1, h["source_name"], h["chunk_header"], h["chunk_text"])
    )
    return listed.select("query_id", F.array_join(blocks, CONTEXT_SEPARATOR).alias("context"))


def answer(
    questions: DataFrame,
    results: DataFrame,
    template: str,
    model: LanguageModel,
    min_similarity: float | None = None,
    keyword_passes: bool = False,
) -> DataFrame:
    """One row per question; a question without results gets an empty context."""
    kept = at_least(results, min_similarity, keyword_passes)
    filled = questions.join(build_context(kept), "query_id", "left").withColumn(
        "formatted_prompt",
        render_prompt(F.lit(template), F.coalesce("context", F.lit("")), F.col("query_text")),
    )
    done = filled.withColumn("_c", complete_column(F.col("formatted_prompt"), model))
    return done.select("query_id", "query_text", "formatted_prompt", "_c.*", F.lit(model.model).alias("llm_model"))
