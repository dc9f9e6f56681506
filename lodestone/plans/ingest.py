"""Files to stored chunks: parse, chunk, reuse or embed, swap, report."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from lodestone.functions.metadata import MetadataField, with_slots
from lodestone.functions.pricing import embed_cost
from lodestone.functions.text import embedded_text, name_from_uri
from lodestone.functions.vectors import l2_normalize
from lodestone.operators.chunking import ChunkConfig, chunk_documents, chunk_fingerprint, explode_chunks
from lodestone.operators.embedding import Embedder, embed_rows
from lodestone.operators.parsing import parse_documents
from lodestone.operators.reuse import with_stored_vectors
from lodestone.operators.skew import KEY_ROWS, TASKS_A_CORE, fits_broadcast
from lodestone.schemas import CHUNKS, INGESTION_EVENTS
from lodestone.session import work_path
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.files import delete, list_dir

CALLS_PER_SECOND = 10.0  # of a remote embedder, unless told otherwise
# Of the chunks' work table: what a task takes of a large one, and the least that is worth a task.
DEAL_BYTES, LEAST_BYTES = 16 * 1024 * 1024, 1024 * 1024
CARRIED = ("document_id", "file_uri", "mime_type", "extra_json", "metadata", "external_id")


@dataclass(frozen=True)
class Collection:
    id: str
    slug: str
    chunking: ChunkConfig = ChunkConfig()
    fields: tuple[MetadataField, ...] = ()


@dataclass(frozen=True)
class IngestReport:
    """``documents``: status per document; ``events``: rows for ``ingestion_events``; ``totals``: chunks, tokens and times
    of the whole batch, counted where its chunks were written."""

    documents: DataFrame
    events: DataFrame
    totals: dict[str, int] = field(default_factory=dict)


def chunked_documents(files: DataFrame, config: ChunkConfig) -> DataFrame:
    """Raw files to one row per document with its chunk array, title and error; no shuffle."""
    for c in CARRIED:
        if c not in files.columns:
            files = files.withColumn(c, F.lit(None).cast("string"))
    kept = [*CARRIED, *(["job_id"] if "job_id" in files.columns else [])]
    parsed = parse_documents(files.select(*kept, "content")).drop("content")
    return chunk_documents(parsed, config)


def _deals(spark, path: str, buckets: int) -> int:
    """Among how many tasks the chunks of a work table are dealt: as many for each bucket, so a bucket gets as many files."""
    size = sum(length for *_, length, _ in list_dir(spark, path))
    cores = spark.sparkContext.defaultParallelism * TASKS_A_CORE
    return buckets * max(1, -(-max(size // DEAL_BYTES, min(cores, size // LEAST_BYTES)) // buckets))


def _deal(store: ChunkStore, deals: int) -> Column:
    """The store's bucket, cut by the text: a huge document spreads over all deals of its bucket."""
    cut = deals // store.buckets
    return store.bucket() * F.lit(cut) + F.pmod(F.xxhash64("chunk_hash"), F.lit(cut)).cast("int")


def ingest(
    files: DataFrame,
    store: ChunkStore,
    collection: Collection,
    embedder: Embedder,
    now: datetime | None = None,
    intent: str = "ingest",
    calls_per_second: float | None = CALLS_PER_SECOND,
) -> IngestReport:
    """Bring the stored chunks of ``files`` up to date.

    ``files`` has one row per document: ``document_id, file_uri, mime_type,
    content`` and optionally ``extra_json, metadata, external_id, job_id``.
    Chunks whose fingerprint is already stored keep their vector; only the rest
    is sent to the embedder, at ``calls_per_second`` for all tasks together where the
    embedder is a remote one.  Documents that cannot be read, or one of whose texts
    the embedder refuses, fail alone and keep their old chunks.
    """
    spark = files.sparkSession
    started = time.monotonic()
    stamp = int((now or datetime.now(timezone.utc)).timestamp())
    base = store.manifest()

    # Parsing is the expensive pass, and three consumers follow: it is done once, into a table.
    chunked_path = work_path(spark, "chunked")
    chunked_documents(files, collection.chunking).write.option("compression", "zstd").parquet(chunked_path)
    chunked = spark.read.parquet(chunked_path)
    outcome = chunked.drop("chunks", "extra_json", "metadata", "external_id")
    rows = explode_chunks(chunked, collection.chunking, *CARRIED)
    replaced = outcome.where(F.col("error").isNull()).select("document_id")
    touched = store.touched(replaced)
    stored = store.read(touched, base)

    # Chunks move once: where they meet their stored vectors, their task also embeds and writes them.
    deals = _deals(spark, chunked_path, store.buckets)
    rows, hashed = rows.withColumn("_deal", _deal(store, deals)), chunk_fingerprint(collection.chunking)
    if any(b in base.folders for b in touched):
        # Where the documents are many, the matching itself passes over the rest.
        wanted = stored.join(F.broadcast(replaced), "document_id", "left_semi") if fits_broadcast(replaced, KEY_ROWS) else stored
        matched = with_stored_vectors(rows, wanted.withColumn("_deal", _deal(store, deals)), hashed, "_deal", deals)
    else:
        matched = rows.drop("chunk_hash").repartitionById(deals, "_deal")
        matched = matched.withColumns({"chunk_hash": hashed, "stored_vector": F.lit(None).cast(CHUNKS["vector"].dataType)})
    matched = matched.drop("_deal")
    metered = calls_per_second if not embedder.local else None
    if metered:  # two branches follow
        matched_path = work_path(spark, "matched")
        matched.write.option("compression", "zstd").parquet(matched_path)
        matched = spark.read.schema(matched.schema).parquet(matched_path)
    text = embedded_text(F.col("chunk_header"), F.col("chunk_text"))
    embedded = embed_rows(matched, F.when(F.col("stored_vector").isNull(), text), embedder, metered)
    embedded = with_slots(embedded, "metadata", collection.fields)
    columns = {
        "id": F.uuid(),
        "vector": F.coalesce("stored_vector", l2_normalize(F.col("_call.vector"))),
        "created_at": F.lit(stamp),
        "updated_at": F.lit(stamp),
        "source_name": name_from_uri(F.col("file_uri")),
    }
    fresh = embedded.select(
        *[columns.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in CHUNKS.fields],
        F.col("stored_vector").isNotNull().alias("_reused"),
        F.coalesce("_call.tokens", F.lit(0)).alias("_tokens"),
        F.coalesce("_call.wait_ms", F.lit(0)).alias("_wait_ms"),
        F.coalesce("_call.embed_ms", F.lit(0)).alias("_embed_ms"),
        F.col("_call.error").alias("_error"),
    )
    # Embedding costs money and ids are random: both happen once, into the files that are published below.
    seen = Observation("ingest")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c.strip("_"))
    counted = fresh.observe(seen, F.count("*").alias("chunks"), total("_tokens"), total("_wait_ms"), total("_embed_ms"))
    staged = store.stage(counted, dealt=not metered)
    fresh = store.read_staged(staged, fresh.schema)
    loop_ms = int((time.monotonic() - started) * 1000)
    # A document with a refused text is not stored in part.
    refused = fresh.where(F.col("_error").isNotNull()).groupBy("document_id").agg(F.min_by("_error", "chunk_index").alias("_refused"))
    refused_path = work_path(spark, "refused")
    refused.write.parquet(refused_path)
    refused = spark.read.schema(refused.schema).parquet(refused_path)
    outcome = outcome.join(refused, "document_id", "left").withColumn("error", F.coalesce("error", "_refused")).drop("_refused")

    counts = fresh.groupBy("document_id").agg(
        F.count("*").cast("int").alias("chunk_count"),
        F.count_if("_reused").alias("reused_chunks"),
        F.sum("_tokens").alias("embed_tokens"),
        F.sum("_wait_ms").alias("wait_ms"),
        F.sum("_embed_ms").alias("embed_ms"),
    )
    before = stored.join(replaced, "document_id", "left_semi").groupBy("document_id").agg(F.count("*").alias("previous_chunks"))
    zero = F.lit(0)
    report = (
        outcome.join(counts, "document_id", "left")
        .join(before, "document_id", "left")
        .na.fill(0, ["chunk_count", "reused_chunks", "embed_tokens", "wait_ms", "embed_ms", "previous_chunks"])
        .withColumns({c: F.when(F.col("error").isNull(), F.col(c)).otherwise(0) for c in ("chunk_count", "reused_chunks")})
        .withColumn("stale_chunks", F.when(F.col("error").isNull(), F.greatest(F.col("previous_chunks") - F.col("reused_chunks"), zero)).otherwise(zero))
        .withColumn("status", F.when(F.col("error").isNull(), "complete").otherwise("failed"))
    )
    report_path = work_path(spark, "report")
    report.write.option("compression", "zstd").parquet(report_path)
    report = spark.read.parquet(report_path)
    report = report.withColumn("name", F.coalesce("title", F.nullif(name_from_uri(F.col("file_uri")), F.lit(""))))

    store.index_ms, inserting = 0, time.monotonic()
    store.replace_staged(replaced.join(refused, "document_id", "left_anti"), staged, refused.select("document_id"), base)
    insert_ms = int((time.monotonic() - inserting) * 1000)
    for path in (chunked_path, refused_path, *([matched_path] if metered else [])):
        delete(spark, path)
    total_ms = int((time.monotonic() - started) * 1000)
    events = _events(report, collection, embedder, intent, loop_ms, insert_ms - store.index_ms, store.index_ms, total_ms, stamp)
    return IngestReport(report, events, seen.get)


def _events(report, collection, embedder, intent, loop_ms, insert_ms, index_ms, total_ms, stamp) -> DataFrame:
    """One event per document; stage times are those of the batch it was part of."""
    if "job_id" not in report.columns:
        report = report.withColumn("job_id", F.lit(""))
    local = [embedder.model] if embedder.local else []
    tokens = F.when(F.col("embed_tokens") > 0, F.col("embed_tokens"))
    parse_ms = F.greatest(F.lit(loop_ms) - F.col("wait_ms") - F.col("embed_ms"), F.lit(0))
    values = {
        "event_id": F.uuid(),
        "occurred_at": F.timestamp_seconds(F.lit(stamp)),
        "collection_id": F.lit(collection.id),
        "collection_slug": F.lit(collection.slug),
        "intent": F.lit(intent),
        "embed_model": F.lit(embedder.model),
        "fetch_ms": F.lit(0),
        "parse_chunk_ms": parse_ms,
        "rate_limit_wait_ms": F.col("wait_ms"),
        "insert_ms": F.lit(insert_ms),
        "optimize_index_ms": F.lit(index_ms),
        "total_ms": F.lit(total_ms),
        "embed_tokens": tokens,
        "embed_cost_usd": embed_cost(F.lit(embedder.model), F.col("embed_tokens"), local),
    }
    return report.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in INGESTION_EVENTS.fields]
    )


def failed_events(
    rows: DataFrame, collection: Collection, embedder: Embedder, intent: str, now: datetime | None = None
) -> DataFrame:
    """One failed event for each ``rows(document_id, file_uri, mime_type, error[, job_id, took_ms])`` that never came to chunks."""
    took = F.coalesce(F.col("took_ms"), F.lit(0)) if "took_ms" in rows.columns else F.lit(0)
    values = {
        "event_id": F.uuid(),
        "job_id": F.col("job_id") if "job_id" in rows.columns else F.lit(""),
        "occurred_at": F.current_timestamp() if now is None else F.lit(now),
        "collection_id": F.lit(collection.id),
        "collection_slug": F.lit(collection.slug),
        "intent": F.lit(intent),
        "embed_model": F.lit(embedder.model),
        "status": F.lit("failed"),
        "fetch_ms": took,
        "total_ms": took,
    }
    zero = {f.name: F.lit(0) for f in INGESTION_EVENTS.fields if f.dataType.typeName() in ("integer", "long") and not f.nullable}
    known = {c: F.col(c) for c in ("document_id", "file_uri", "mime_type", "error")}
    values = {**zero, **known, **values}
    return rows.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in INGESTION_EVENTS.fields]
    )


def patch_document(store: ChunkStore, document_id: str, fields: Sequence[MetadataField], metadata: str | None = None, extra_json: str | None = None):
    """Change metadata or extra JSON on every chunk of a document; ``""`` clears the JSON."""
    from lodestone.functions.metadata import patch_slots

    changes = {}
    if extra_json is not None:
        changes["extra_json"] = F.lit(extra_json) if extra_json else None
    if metadata is not None:
        changes |= patch_slots(F.lit(metadata), fields)
    return store.update_document(document_id, changes) if changes else store.manifest()
