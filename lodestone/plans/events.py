"""Usage events of searches and answers, failed ones included."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.pricing import llm_cost
from lodestone.plans.ingest import Collection
from lodestone.plans.retrieval import SearchRequest, result_stats, trace_chunks
from lodestone.schemas import QUERY_EVENTS, QUERY_TRACES


def query_events(
    asked: DataFrame,
    results: DataFrame,
    request: SearchRequest,
    collection: Collection,
    endpoint: str,
    embed_model: str,
    local_models=(),
    filters_json: str | None = None,
) -> DataFrame:
    """One row per question of ``asked(query_id, query_text, event_id, ...)``.

    Optional columns are taken as they are: ``occurred_at, api_key_id, error,
    prompt_slug, llm_model, input_tokens, output_tokens, llm_ms`` and the stage
    timings.  A question with an error keeps the results it had found.
    """
    stats = result_stats(results)
    rows = asked.join(stats, "query_id", "left")

    def given(name: str, default=None):
        return F.col(name) if name in asked.columns else F.lit(default)

    listed = F.coalesce("results", F.array().cast(QUERY_EVENTS["results"].dataType))
    s = request.settings
    cost = llm_cost(given("llm_model").cast("string"), given("input_tokens"), given("output_tokens"), local_models)
    values = {
        "occurred_at": F.coalesce(given("occurred_at").cast("timestamp"), F.current_timestamp()),
        "collection_id": F.lit(collection.id),
        "collection_slug": F.lit(collection.slug),
        "origin": F.when(given("api_key_id").isNull(), "admin").otherwise("public"),
        "endpoint": F.lit(endpoint),
        "top_k": F.lit(request.top_k),
        "vector_search_only": F.lit(request.vector_search_only),
        "hybrid_settings": F.struct(
            F.lit(float(s.full_text_weight)).alias("full_text_weight"),
            F.lit(float(s.semantic_weight)).alias("semantic_weight"),
            F.lit(float(s.rrf_k)).alias("rrf_k"),
            F.lit(s.full_text_limit).alias("full_text_limit"),
        ),
        "embed_model": F.lit(embed_model),
        "result_count": F.size(listed),
        "results": listed,
        "status": F.when(given("error").isNull(), "complete").otherwise("failed"),
        "filters_json": F.lit(filters_json),
        "llm_input_tokens": given("input_tokens"),
        "llm_output_tokens": given("output_tokens"),
        "llm_cost_usd": F.when(given("error").isNull() & given("llm_model").isNotNull(), cost),
        **{c: given(c, 0) for c in ("embed_ms", "vector_search_ms", "total_ms")},
    }
    return rows.select(*[values.get(f.name, given(f.name)).cast(f.dataType).alias(f.name) for f in QUERY_EVENTS.fields])


def query_traces(asked: DataFrame, results: DataFrame) -> DataFrame:
    """The chunks shown to each question, with prompt and answer where there were any."""
    rows = asked.join(trace_chunks(results), "query_id", "left")

    def given(name: str):
        return F.col(name) if name in asked.columns else F.lit(None)

    values = {
        "occurred_at": F.coalesce(given("occurred_at").cast("timestamp"), F.current_timestamp()),
        "chunks": F.coalesce("chunks", F.array().cast(QUERY_TRACES["chunks"].dataType)),
    }
    return rows.select(*[values.get(f.name, given(f.name)).cast(f.dataType).alias(f.name) for f in QUERY_TRACES.fields])
