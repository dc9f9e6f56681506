"""The driver's generic tables read as this engine's inputs.

``events`` become usage telemetry, ``part`` and ``orders`` become chunks with
typed metadata slots, ``documents`` become a corpus, ``embeddings`` vectors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.pricing import embed_cost, llm_cost
from lodestone.operators.skew import spread
from lodestone.schemas import INGESTION_EVENTS, QUERY_EVENTS

EMBED_MODEL = "text-embedding-3-small"
LLM_MODEL = "gpt-4o-mini"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _weight() -> Column:
    return F.get_json_object("props", "$.k").cast("bigint")


def _shaped(rows: DataFrame, schema, columns: dict[str, Column]) -> DataFrame:
    return rows.select(
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )


def ingestion_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingestion_from(table(spark, sf_dir, "events"))


def query_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries_from(table(spark, sf_dir, "events"))


def ingestion_from(events: DataFrame) -> DataFrame:
    events = events.where(F.col("event_type").isin("signup", "error"))
    k, user = _weight(), F.col("user_id")
    failed = F.col("event_type") == "error"
    tokens = F.when(~failed, k)
    slug = F.concat(F.lit("c"), (user % 7).cast("string"))
    mime = F.element_at(F.array(F.lit("application/pdf"), F.lit("text/html"), F.lit("text/csv")), (user % 3 + 1).cast("int"))
    intent = F.element_at(F.array(F.lit("ingest"), F.lit("refresh"), F.lit("auto_refresh")), (k % 3 + 1).cast("int"))
    zero = F.lit(0)
    return _shaped(
        events,
        INGESTION_EVENTS,
        {
            "event_id": F.col("event_id"),
            "occurred_at": F.col("ts"),
            "job_id": F.concat(F.lit("j"), F.col("event_id")),
            "document_id": F.concat(F.lit("d"), user),
            "collection_id": slug,
            "collection_slug": slug,
            "file_uri": F.concat(F.lit("upload://u"), user),
            "mime_type": mime,
            "intent": intent,
            "status": F.when(failed, "failed").otherwise("complete"),
            "error": F.when(failed, "parse error"),
            "embed_model": F.lit(EMBED_MODEL),
            "chunk_count": F.when(failed, 0).otherwise(k),
            "fetch_ms": k,
            "parse_chunk_ms": k * 2,
            "rate_limit_wait_ms": k * 3,
            "embed_ms": k * 4,
            "insert_ms": zero,
            "optimize_index_ms": zero,
            "total_ms": k * 10,
            "embed_tokens": tokens,
            "embed_cost_usd": F.when(~failed, embed_cost(F.lit(EMBED_MODEL), tokens)),
        },
    )


def queries_from(events: DataFrame) -> DataFrame:
    events = events.where(~F.col("event_type").isin("signup", "error"))
    k, user = _weight(), F.col("user_id")
    rag = F.col("event_type") == "purchase"
    slug = F.concat(F.lit("c"), (user % 7).cast("string"))
    failed = k % 10 == 0
    stat = F.struct(
        F.concat(F.lit("s"), user).alias("source_name"),
        F.col("value").alias("similarity"),
        F.lit(0.0).alias("bm25_score"),
        F.lit(0.0).alias("rrf_score"),
    )
    settings = F.struct(
        F.lit(0.3).alias("full_text_weight"),
        F.lit(0.7).alias("semantic_weight"),
        F.lit(60.0).alias("rrf_k"),
        F.lit(200).alias("full_text_limit"),
    )
    return _shaped(
        events,
        QUERY_EVENTS,
        {
            "event_id": F.col("event_id"),
            "occurred_at": F.col("ts"),
            "collection_id": slug,
            "collection_slug": slug,
            "origin": F.lit("public"),
            "endpoint": F.when(rag, "rag").otherwise("query"),
            "top_k": F.lit(5),
            "vector_search_only": F.lit(False),
            "hybrid_settings": settings,
            "embed_model": F.lit(EMBED_MODEL),
            "embed_ms": k,
            "vector_search_ms": k,
            "total_ms": F.floor(F.col("value") * 10),
            "result_count": F.lit(1),
            "results": F.array(stat),
            "status": F.when(failed, "failed").otherwise("complete"),
            "error": F.when(failed, "search failed"),
            "query_text": F.concat(F.lit("question "), k),
            "embed_query_tokens": k,
            "llm_model": F.when(rag, LLM_MODEL),
            "llm_input_tokens": F.when(rag, k * 5),
            "llm_output_tokens": F.when(rag, k * 2),
            "llm_cost_usd": F.when(rag, llm_cost(F.lit(LLM_MODEL), k * 5, k * 2)),
        },
    )


def query_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace per RAG call that has a user's document to show."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "purchase")
    chunk = F.struct(
        F.concat(F.lit("s"), F.col("user_id")).alias("source_name"),
        F.lit(None).cast("string").alias("chunk_header"),
        F.concat(F.lit("chunk "), F.col("event_id")).alias("chunk_text"),
        F.col("value").alias("similarity"),
        F.lit(0.0).alias("bm25_score"),
    )
    return events.select(
        F.col("event_id").cast("string").alias("event_id"),
        F.col("ts").cast("timestamp").alias("occurred_at"),
        F.array(chunk).alias("chunks"),
        F.concat(F.lit("prompt "), F.col("event_id")).alias("formatted_prompt"),
        F.concat(F.lit("answer "), F.col("event_id")).alias("answer"),
    )


# name -> (type, slot) of the metadata fields the slot views declare.
PART_FIELDS = {"brand": ("str", 1), "price": ("num", 1), "large": ("bool", 1), "words": ("arr", 1)}
ORDER_FIELDS = {"priority": ("str", 1), "total": ("num", 1), "open": ("bool", 1), "ordered": ("date", 1)}


def part_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.lit("text/plain").alias("mime_type"),
        F.col("p_name").alias("source_name"),
        F.col("p_brand").alias("metadata_str_1"),
        F.col("p_retailprice").alias("metadata_num_1"),
        (F.col("p_size") > 25).alias("metadata_bool_1"),
        F.split("p_name", " ").alias("metadata_arr_1"),
    )


def order_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    seconds = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.col("o_custkey").alias("document_id"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("metadata_str_1"),
        F.col("o_totalprice").alias("metadata_num_1"),
        (F.col("o_orderstatus") == "O").alias("metadata_bool_1"),
        seconds.alias("metadata_date_1"),
        seconds.alias("created_at"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as keyword-searchable chunks."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").alias("id"), F.col("text").alias("chunk_text"), "source", "lang"
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as plain-text files, ready to ingest."""
    return spread(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("upload://doc_"), F.col("doc_id"), F.lit(".txt")).alias("file_uri"),
        F.lit("text/plain").alias("mime_type"),
        F.col("text").cast("binary").alias("content"),
    )


def web_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "pages"), "page_id").select(
        F.col("page_id").cast("string").alias("document_id"),
        F.col("url").alias("file_uri"),
        F.lit("text/html").alias("mime_type"),
        F.col("html").cast("binary").alias("content"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )
