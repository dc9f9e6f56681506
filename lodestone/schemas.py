"""Row types of the chunk table, the telemetry fact tables and the catalog."""

from __future__ import annotations

from pyspark.sql import types as T

STR, INT, LONG, DBL, BOOL, TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _struct(required: dict, optional: dict | None = None) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    fields += [T.StructField(n, t, True) for n, t in (optional or {}).items()]
    return T.StructType(fields)


# Slots per metadata type.
SLOT_COUNTS = {"str": 20, "num": 10, "bool": 10, "date": 10, "arr": 10}

SLOT_TYPES = {
    "str": STR,
    "num": DBL,
    "bool": BOOL,
    "date": LONG,
    "arr": T.ArrayType(STR),
}


def slot_column(field_type: str, slot: int) -> str:
    return f"metadata_{field_type}_{slot}"


SLOT_COLUMNS = {
    slot_column(kind, n): SLOT_TYPES[kind]
    for kind, count in SLOT_COUNTS.items()
    for n in range(1, count + 1)
}

CHUNKS = _struct(
    {
        "id": STR,
        "document_id": STR,
        "chunk_hash": STR,
        "chunk_index": INT,
        "vector": T.ArrayType(T.FloatType()),
        "created_at": LONG,
        "updated_at": LONG,
        "mime_type": STR,
        "file_uri": STR,
        "source_name": STR,
    },
    {
        "chunk_text": STR,
        "chunk_header": STR,
        "external_id": STR,
        "extra_json": STR,
        **SLOT_COLUMNS,
    },
)

UNIT = T.StructType(
    [
        T.StructField("kind", STR),
        T.StructField("text", STR),
        T.StructField("metadata", T.MapType(STR, STR)),
    ]
)
UNITS = T.ArrayType(UNIT)

CHUNK = T.StructType(
    [
        T.StructField("chunk_index", INT),
        T.StructField("chunk_text", STR),
        T.StructField("chunk_header", STR),
    ]
)

INGESTION_EVENTS = _struct(
    {
        "event_id": STR,
        "occurred_at": TS,
        "job_id": STR,
        "document_id": STR,
        "collection_id": STR,
        "collection_slug": STR,
        "file_uri": STR,
        "mime_type": STR,
        "intent": STR,
        "status": STR,
        "embed_model": STR,
        "chunk_count": INT,
        "fetch_ms": LONG,
        "parse_chunk_ms": LONG,
        "rate_limit_wait_ms": LONG,
        "embed_ms": LONG,
        "insert_ms": LONG,
        "optimize_index_ms": LONG,
        "total_ms": LONG,
    },
    {"error": STR, "embed_tokens": LONG, "embed_cost_usd": DBL},
)

# Nested members are nullable, as every Parquet read returns them.
HYBRID_SETTINGS = _struct(
    {}, {"full_text_weight": DBL, "semantic_weight": DBL, "rrf_k": DBL, "full_text_limit": INT}
)
RESULT_STAT = _struct(
    {}, {"source_name": STR, "similarity": DBL, "bm25_score": DBL, "rrf_score": DBL}
)

QUERY_EVENTS = _struct(
    {
        "event_id": STR,
        "occurred_at": TS,
        "collection_id": STR,
        "collection_slug": STR,
        "origin": STR,
        "endpoint": STR,
        "top_k": INT,
        "vector_search_only": BOOL,
        "hybrid_settings": HYBRID_SETTINGS,
        "embed_model": STR,
        "embed_ms": LONG,
        "vector_search_ms": LONG,
        "total_ms": LONG,
        "result_count": INT,
        "results": T.ArrayType(RESULT_STAT),
        "status": STR,
    },
    {
        "api_key_id": STR,
        "query_text": STR,
        "filters_json": STR,
        "embed_query_tokens": LONG,
        "error": STR,
        "prompt_slug": STR,
        "llm_model": STR,
        "llm_input_tokens": LONG,
        "llm_output_tokens": LONG,
        "llm_cost_usd": DBL,
        "llm_ms": LONG,
    },
)

TRACE_CHUNK = _struct(
    {},
    {"source_name": STR, "chunk_header": STR, "chunk_text": STR, "similarity": DBL, "bm25_score": DBL},
)
QUERY_TRACES = _struct(
    {"event_id": STR, "occurred_at": TS, "chunks": T.ArrayType(TRACE_CHUNK)},
    {"formatted_prompt": STR, "answer": STR},
)

TELEMETRY_TABLES = {
    "ingestion_events": INGESTION_EVENTS,
    "query_events": QUERY_EVENTS,
    "query_traces": QUERY_TRACES,
}

COLLECTIONS = _struct(
    {
        "id": STR,
        "name": STR,
        "slug": STR,
        "table_name": STR,
        "embed_model": STR,
        "vector_dim": INT,
        "created_at": TS,
    },
    {
        "chunk_strategy": STR,
        "chunk_size": INT,
        "chunk_overlap": INT,
        "refresh_enabled": BOOL,
        "refresh_interval_seconds": INT,
        "last_auto_refresh_at": TS,
    },
)
DOCUMENTS = _struct(
    {
        "id": STR,
        "collection_id": STR,
        "file_uri": STR,
        "mime_type": STR,
        "chunk_count": INT,
        "status": STR,
        "created_at": TS,
        "updated_at": TS,
    },
    {
        "job_id": STR,
        "name": STR,
        "external_id": STR,
        "extra_json": STR,
        "error": STR,
        "last_etag": STR,
    },
)
JOBS = _struct(
    {
        "id": STR,
        "collection_id": STR,
        "file_uri": STR,
        "mime_type": STR,
        "status": STR,
        "intent": STR,
        "force": BOOL,
        "created_at": TS,
        "updated_at": TS,
    },
    {"display_name": STR, "extra_json": STR, "metadata": STR, "error": STR, "executed_at": TS},
)
METADATA_FIELDS = _struct(
    {"id": STR, "collection_id": STR, "name": STR, "type": STR, "slot": INT, "created_at": TS}
)
API_KEYS = _struct({"id": STR, "name": STR, "key_hash": STR, "key_hint": STR, "created_at": TS})
KEY_GRANTS = _struct({"api_key_id": STR, "permission": STR}, {"collection_id": STR})
ADMIN_GRANTS = _struct({"api_key_id": STR, "resource_type": STR, "permission": STR})
PROMPTS = _struct(
    {"id": STR, "name": STR, "slug": STR, "content": STR, "is_system": BOOL, "created_at": TS, "updated_at": TS}
)

CATALOG_TABLES = {
    "collections": COLLECTIONS,
    "documents": DOCUMENTS,
    "jobs": JOBS,
    "metadata_fields": METADATA_FIELDS,
    "api_keys": API_KEYS,
    "key_grants": KEY_GRANTS,
    "admin_grants": ADMIN_GRANTS,
    "prompts": PROMPTS,
}
