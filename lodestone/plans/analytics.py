"""The usage dashboard: five panels and the questions planned around them."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.quantiles import exact_quantiles

EVENT_TYPES = ["ingestion", "query", "rag"]
DEFAULT_DAYS, MAX_DAYS = 30, 365


def cutoff(days: int | str | None, now: datetime | None = None) -> datetime:
    """Start of the look-back: 30 days unless a whole number says otherwise, kept in 1..365."""
    now = now or datetime.now(timezone.utc)
    try:
        wanted = DEFAULT_DAYS if days is None else int(days)
    except ValueError:
        wanted = DEFAULT_DAYS
    return now - timedelta(days=min(max(wanted, 1), MAX_DAYS))


def since(events: DataFrame, start: datetime | None) -> DataFrame:
    return events if start is None else events.where(F.col("occurred_at") >= F.lit(start))


def _bucket(unit: str, layout: str = "yyyy-MM-dd") -> Column:
    return F.date_format(F.date_trunc(unit, "occurred_at"), layout)


def volume_over_time(ingestion: DataFrame, queries: DataFrame, start: datetime | None = None) -> DataFrame:
    """Events per day and type, failed ones included."""
    day = _bucket("day").alias("day")
    ingested = since(ingestion, start).groupBy(day, F.lit("ingestion").alias("event_type"))
    asked = since(queries, start).groupBy(day, F.col("endpoint").alias("event_type"))
    counted = F.count("*").alias("count")
    return ingested.agg(counted).unionByName(asked.agg(counted)).orderBy("day", "event_type")


def volume_pivot(volume: DataFrame) -> DataFrame:
    """One row per day, one zero-filled column per event type."""
    return volume.groupBy("day").pivot("event_type", EVENT_TYPES).agg(F.sum("count")).na.fill(0).orderBy("day")


def _spend(ingestion: DataFrame, queries: DataFrame, *keys: Column) -> DataFrame:
    def known(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(0.0))

    none = F.lit(0.0)
    return ingestion.select(
        *keys, known("embed_cost_usd").alias("ingestion_cost_usd"), none.alias("llm_cost_usd")
    ).unionByName(
        queries.select(*keys, none.alias("ingestion_cost_usd"), known("llm_cost_usd").alias("llm_cost_usd"))
    )


def cost_by_collection(ingestion: DataFrame, queries: DataFrame, start: datetime | None = None) -> DataFrame:
    spend = _spend(since(ingestion, start), since(queries, start), F.col("collection_slug"))
    return (
        spend.groupBy("collection_slug")
        .agg(F.sum("ingestion_cost_usd").alias("ingestion_cost_usd"), F.sum("llm_cost_usd").alias("llm_cost_usd"))
        .orderBy((F.col("ingestion_cost_usd") + F.col("llm_cost_usd")).desc(), "collection_slug")
    )


def latency(queries: DataFrame, start: datetime | None = None) -> DataFrame:
    """Exact p50 and p95 of completed calls by endpoint."""
    done = since(queries, start).where(F.col("status") == "complete")
    return exact_quantiles(
        done, ["endpoint"], "total_ms", {"p50_ms": 0.5, "p95_ms": 0.95}, "sample_count"
    ).orderBy("endpoint")


def ingestion_success_rate(ingestion: DataFrame, start: datetime | None = None) -> DataFrame:
    complete = F.when(F.col("status") == "complete", F.lit(1.0)).otherwise(F.lit(0.0))
    return (
        since(ingestion, start)
        .groupBy("mime_type")
        .agg(F.count("*").alias("total_count"), F.avg(complete).alias("success_rate"))
        .orderBy(F.col("success_rate").asc(), F.col("total_count").desc(), "mime_type")
    )


def token_usage_by_collection(ingestion: DataFrame, queries: DataFrame, start: datetime | None = None) -> DataFrame:
    measures = {
        "ingestion_embed_tokens": ("embed_tokens", None),
        "query_embed_tokens": (None, "embed_query_tokens"),
        "llm_input_tokens": (None, "llm_input_tokens"),
        "llm_output_tokens": (None, "llm_output_tokens"),
    }

    def branch(events: DataFrame, side: int) -> DataFrame:
        zero = F.lit(0).cast("bigint")
        cols = [
            (F.coalesce(F.col(src[side]), zero) if src[side] else zero).alias(name)
            for name, src in measures.items()
        ]
        return since(events, start).select("collection_slug", *cols)

    both = branch(ingestion, 0).unionByName(branch(queries, 1))
    return both.groupBy("collection_slug").agg(*[F.sum(m).alias(m) for m in measures]).orderBy("collection_slug")


def weekly_spend(ingestion: DataFrame, queries: DataFrame) -> DataFrame:
    keys = [F.col("collection_slug"), _bucket("week").alias("week")]
    spend = _spend(ingestion, queries, *keys)
    total = F.sum(F.col("ingestion_cost_usd") + F.col("llm_cost_usd")).alias("cost_usd")
    return spend.groupBy("collection_slug", "week").agg(total).orderBy("week", "collection_slug")


def hourly_volume(queries: DataFrame) -> DataFrame:
    hour = _bucket("hour", "yyyy-MM-dd HH:mm:ss").alias("hour")
    return queries.groupBy(hour, "endpoint").agg(F.count("*").alias("count")).orderBy("hour", "endpoint")


def most_expensive_collections(ingestion: DataFrame, queries: DataFrame) -> DataFrame:
    spend = _spend(ingestion, queries, F.col("collection_slug"))
    total = F.sum(F.col("ingestion_cost_usd") + F.col("llm_cost_usd")).alias("cost_usd")
    return spend.groupBy("collection_slug").agg(total).orderBy(F.col("cost_usd").desc(), "collection_slug")


def rag_p95(queries: DataFrame) -> DataFrame:
    rag = queries.where(F.col("endpoint") == "rag")
    return exact_quantiles(rag, ["endpoint"], "total_ms", {"p95_ms": 0.95}, "sample_count")


def common_questions(queries: DataFrame, top: int | None = None) -> DataFrame:
    asked = queries.where(F.col("query_text").isNotNull()).groupBy("query_text").agg(F.count("*").alias("count"))
    ranked = asked.orderBy(F.col("count").desc(), "query_text")
    return ranked if top is None else ranked.limit(top)


def failure_rate_by_mime(ingestion: DataFrame) -> DataFrame:
    failed = F.when(F.col("status") == "failed", F.lit(1.0)).otherwise(F.lit(0.0))
    return ingestion.groupBy("mime_type").agg(F.avg(failed).alias("failure_rate")).orderBy("mime_type")


def throttle_trend(ingestion: DataFrame) -> DataFrame:
    """Daily rate-limit waiting; a rising line means the limiter is the bottleneck."""
    return (
        ingestion.groupBy(_bucket("day").alias("day"))
        .agg(
            F.sum("rate_limit_wait_ms").alias("wait_ms"),
            F.avg("rate_limit_wait_ms").alias("avg_wait_ms"),
        )
        .orderBy("day")
    )


def reingest_cost(ingestion: DataFrame) -> DataFrame:
    """What refreshing each document has cost so far."""
    again = ingestion.where(F.col("intent") == "refresh")
    return again.groupBy("document_id").agg(F.sum(F.coalesce("embed_cost_usd", F.lit(0.0))).alias("cost_usd"))


def trace_drilldown(queries: DataFrame, traces: DataFrame) -> DataFrame:
    """Each query's metrics beside its retrieved chunks, prompt and answer."""
    return queries.join(traces.drop("occurred_at"), "event_id", "left")
