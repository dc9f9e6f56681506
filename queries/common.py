"""Shared pieces of the registered queries."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.session import apply_runtime_conf, ship_package


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def prepared(run: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def call(spark: SparkSession, sf_dir: str) -> DataFrame:
        apply_runtime_conf(spark)
        ship_package(spark)
        return run(spark, sf_dir)

    call.__doc__ = run.__doc__
    return call


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    """Floating sums depend on the order of addition; compare them at fixed precision."""
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def typed(df: DataFrame, **types: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast(t) for c, t in types.items()})


INGESTION_CTE = """ingestion_events AS (
  SELECT event_id, ts AS occurred_at,
         'c' || (user_id % 7) AS collection_slug,
         'd' || user_id AS document_id,
         CASE user_id % 3 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'text/html' ELSE 'text/csv' END AS mime_type,
         CASE k % 3 WHEN 0 THEN 'ingest' WHEN 1 THEN 'refresh' ELSE 'auto_refresh' END AS intent,
         CASE WHEN event_type = 'error' THEN 'failed' ELSE 'complete' END AS status,
         k * 3 AS rate_limit_wait_ms,
         CASE WHEN event_type <> 'error' THEN k END AS embed_tokens,
         CASE WHEN event_type <> 'error' THEN k / 1e6 * 0.02e0 END AS embed_cost_usd
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE event_type IN ('signup', 'error'))"""

QUERY_CTE = """query_events AS (
  SELECT event_id, ts AS occurred_at,
         'c' || (user_id % 7) AS collection_slug,
         CASE WHEN event_type = 'purchase' THEN 'rag' ELSE 'query' END AS endpoint,
         CASE WHEN k % 10 = 0 THEN 'failed' ELSE 'complete' END AS status,
         CAST(floor(value * 10) AS BIGINT) AS total_ms,
         'question ' || k AS query_text,
         value,
         user_id,
         k AS embed_query_tokens,
         CASE WHEN event_type = 'purchase' THEN k * 5 END AS llm_input_tokens,
         CASE WHEN event_type = 'purchase' THEN k * 2 END AS llm_output_tokens,
         CASE WHEN event_type = 'purchase' THEN (k * 5) / 1e6 * 0.15e0 + (k * 2) / 1e6 * 0.60e0 END AS llm_cost_usd
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
  WHERE event_type NOT IN ('signup', 'error'))"""

TELEMETRY_CTE = f"WITH {INGESTION_CTE},\n{QUERY_CTE}\n"

# The keyword tokenizer, as a list of lower-cased terms.
TOKENS_SQL = r"list_filter(regexp_split_to_array(lower({text}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tokens_sql(text: str) -> str:
    return TOKENS_SQL.format(text=text)
