"""Dashboard panels and the questions around them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from lodestone.plans import analytics as plan
from lodestone.sources.adapters import ingestion_events, query_events, query_traces
from queries.common import TELEMETRY_CTE, Query, rounded

# The event table covers January 2024; the look-back starts at a fixed day.
START = datetime(2024, 1, 10)
AFTER = "occurred_at >= TIMESTAMP '2024-01-10 00:00:00'"


def _both(spark, sf):
    return ingestion_events(spark, sf), query_events(spark, sf)


def _volume(spark, sf):
    return plan.volume_over_time(*_both(spark, sf), START)


def _trace_drilldown(spark, sf):
    joined = plan.trace_drilldown(query_events(spark, sf), query_traces(spark, sf))
    chunk = F.try_element_at("chunks", F.lit(1))
    return rounded(
        joined.select(
            "event_id",
            "endpoint",
            "status",
            "total_ms",
            "formatted_prompt",
            "answer",
            chunk["chunk_text"].alias("first_chunk"),
            F.coalesce(F.size("chunks"), F.lit(0)).cast("bigint").alias("chunk_count"),
            F.col("results")[0]["similarity"].alias("top_similarity"),
        ),
        6,
        "top_similarity",
    )


QUERIES = {
    "volume_over_time": Query(
        _volume,
        TELEMETRY_CTE
        + f"""SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS day, 'ingestion' AS event_type,
                 CAST(count(*) AS BIGINT) AS "count" FROM ingestion_events WHERE {AFTER} GROUP BY 1
          UNION ALL
          SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d'), endpoint, CAST(count(*) AS BIGINT)
          FROM query_events WHERE {AFTER} GROUP BY 1, 2""",
    ),
    "volume_pivot": Query(
        lambda spark, sf: plan.volume_pivot(_volume(spark, sf)),
        TELEMETRY_CTE
        + f""", u AS (
            SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS day, 'ingestion' AS event_type
            FROM ingestion_events WHERE {AFTER}
            UNION ALL
            SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d'), endpoint FROM query_events WHERE {AFTER})
          SELECT day,
                 CAST(count(*) FILTER (WHERE event_type = 'ingestion') AS BIGINT) AS ingestion,
                 CAST(count(*) FILTER (WHERE event_type = 'query') AS BIGINT) AS query,
                 CAST(count(*) FILTER (WHERE event_type = 'rag') AS BIGINT) AS rag
          FROM u GROUP BY day""",
    ),
    "cost_by_collection": Query(
        lambda spark, sf: rounded(
            plan.cost_by_collection(*_both(spark, sf), START), 8, "ingestion_cost_usd", "llm_cost_usd"
        ),
        TELEMETRY_CTE
        + f""", spent AS (
            SELECT collection_slug AS slug, sum(embed_cost_usd) AS embedding FROM ingestion_events
            WHERE {AFTER} GROUP BY ALL),
          answered AS (
            SELECT collection_slug AS slug, sum(llm_cost_usd) AS answers FROM query_events WHERE {AFTER} GROUP BY ALL)
          SELECT coalesce(spent.slug, answered.slug) AS collection_slug,
                 round(ifnull(embedding, 0e0), 8) AS ingestion_cost_usd, round(ifnull(answers, 0e0), 8) AS llm_cost_usd
          FROM spent FULL JOIN answered ON spent.slug = answered.slug""",
    ),
    "latency": Query(
        lambda spark, sf: rounded(plan.latency(query_events(spark, sf), START), 6, "p50_ms", "p95_ms"),
        TELEMETRY_CTE
        + f"""SELECT endpoint, CAST(count(*) AS BIGINT) AS sample_count,
                 round(quantile_cont(total_ms, 0.5), 6) AS p50_ms, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms
          FROM query_events WHERE {AFTER} AND status = 'complete' GROUP BY endpoint""",
    ),
    "ingestion_success_rate": Query(
        lambda spark, sf: rounded(plan.ingestion_success_rate(ingestion_events(spark, sf), START), 8, "success_rate"),
        TELEMETRY_CTE
        + f"""SELECT mime_type, CAST(count(*) AS BIGINT) AS total_count,
                 round(avg(CASE WHEN status = 'complete' THEN 1e0 ELSE 0e0 END), 8) AS success_rate
          FROM ingestion_events WHERE {AFTER} GROUP BY mime_type""",
    ),
    "token_usage_by_collection": Query(
        lambda spark, sf: plan.token_usage_by_collection(*_both(spark, sf), START),
        TELEMETRY_CTE
        + f""", stored AS (
            SELECT collection_slug AS slug, sum(embed_tokens) AS embedded FROM ingestion_events
            WHERE {AFTER} GROUP BY ALL),
          asked AS (
            SELECT collection_slug AS slug, sum(embed_query_tokens) AS questions, sum(llm_input_tokens) AS read,
                   sum(llm_output_tokens) AS written FROM query_events WHERE {AFTER} GROUP BY ALL)
          SELECT ifnull(stored.slug, asked.slug) AS collection_slug,
                 CAST(ifnull(embedded, 0) AS BIGINT) AS ingestion_embed_tokens,
                 CAST(ifnull(questions, 0) AS BIGINT) AS query_embed_tokens,
                 CAST(ifnull(read, 0) AS BIGINT) AS llm_input_tokens,
                 CAST(ifnull(written, 0) AS BIGINT) AS llm_output_tokens
          FROM stored FULL JOIN asked ON stored.slug = asked.slug""",
    ),
    "weekly_spend": Query(
        lambda spark, sf: rounded(plan.weekly_spend(*_both(spark, sf)), 8, "cost_usd"),
        TELEMETRY_CTE
        + """SELECT collection_slug, strftime(date_trunc('week', occurred_at), '%Y-%m-%d') AS week,
                 round(sum(c), 8) AS cost_usd FROM (
            SELECT collection_slug, occurred_at, coalesce(embed_cost_usd, 0e0) AS c FROM ingestion_events
            UNION ALL
            SELECT collection_slug, occurred_at, coalesce(llm_cost_usd, 0e0) FROM query_events)
          GROUP BY 1, 2""",
    ),
    "hourly_volume": Query(
        lambda spark, sf: plan.hourly_volume(query_events(spark, sf)),
        TELEMETRY_CTE
        + """SELECT strftime(date_trunc('hour', occurred_at), '%Y-%m-%d %H:%M:%S') AS hour, endpoint,
                 CAST(count(*) AS BIGINT) AS "count" FROM query_events GROUP BY 1, 2""",
    ),
    "most_expensive_collections": Query(
        lambda spark, sf: rounded(plan.most_expensive_collections(*_both(spark, sf)), 8, "cost_usd"),
        TELEMETRY_CTE
        + """SELECT collection_slug, round(sum(c), 8) AS cost_usd FROM (
            SELECT collection_slug, coalesce(embed_cost_usd, 0e0) AS c FROM ingestion_events
            UNION ALL
            SELECT collection_slug, coalesce(llm_cost_usd, 0e0) FROM query_events)
          GROUP BY collection_slug""",
    ),
    "rag_p95": Query(
        lambda spark, sf: rounded(plan.rag_p95(query_events(spark, sf)), 6, "p95_ms"),
        TELEMETRY_CTE
        + """SELECT endpoint, CAST(count(*) AS BIGINT) AS sample_count, round(quantile_cont(total_ms, 0.95), 6) AS p95_ms
          FROM query_events WHERE endpoint = 'rag' GROUP BY endpoint""",
    ),
    "common_questions": Query(
        lambda spark, sf: plan.common_questions(query_events(spark, sf)),
        TELEMETRY_CTE
        + """SELECT query_text, CAST(count(*) AS BIGINT) AS "count" FROM query_events
          WHERE query_text IS NOT NULL GROUP BY query_text""",
    ),
    "failure_rate_by_mime": Query(
        lambda spark, sf: rounded(plan.failure_rate_by_mime(ingestion_events(spark, sf)), 8, "failure_rate"),
        TELEMETRY_CTE
        + """SELECT mime_type, round(avg(CASE WHEN status = 'failed' THEN 1e0 ELSE 0e0 END), 8) AS failure_rate
          FROM ingestion_events GROUP BY mime_type""",
    ),
    "throttle_trend": Query(
        lambda spark, sf: rounded(plan.throttle_trend(ingestion_events(spark, sf)), 6, "avg_wait_ms"),
        TELEMETRY_CTE
        + """SELECT strftime(date_trunc('day', occurred_at), '%Y-%m-%d') AS day,
                 CAST(sum(rate_limit_wait_ms) AS BIGINT) AS wait_ms, round(avg(rate_limit_wait_ms), 6) AS avg_wait_ms
          FROM ingestion_events GROUP BY 1""",
    ),
    "reingest_cost": Query(
        lambda spark, sf: rounded(plan.reingest_cost(ingestion_events(spark, sf)), 8, "cost_usd"),
        TELEMETRY_CTE
        + """SELECT document_id, round(sum(coalesce(embed_cost_usd, 0e0)), 8) AS cost_usd
          FROM ingestion_events WHERE intent = 'refresh' GROUP BY document_id""",
    ),
    "trace_drilldown": Query(
        _trace_drilldown,
        TELEMETRY_CTE
        + """, traces AS (
            SELECT event_id, 'prompt ' || event_id AS formatted_prompt, 'answer ' || event_id AS answer,
                   'chunk ' || event_id AS first_chunk FROM events WHERE event_type = 'purchase')
          SELECT CAST(q.event_id AS VARCHAR) AS event_id, endpoint, status, total_ms, formatted_prompt, answer, first_chunk,
                 CAST(CASE WHEN t.event_id IS NULL THEN 0 ELSE 1 END AS BIGINT) AS chunk_count,
                 round(value, 6) AS top_similarity
          FROM query_events q LEFT JOIN traces t ON t.event_id = q.event_id""",
    ),
}
