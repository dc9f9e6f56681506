"""Ingest jobs: what to run, and what a run leaves behind in the catalog."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.embedding import Embedder
from lodestone.operators.ranking import top_per_group
from lodestone.plans.catalog import latest_by_uri, skip_completed, upsert
from lodestone.plans.ingest import CALLS_PER_SECOND, Collection, IngestReport, failed_events, ingest
from lodestone.schemas import DOCUMENTS, JOBS
from lodestone.session import work_path
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.remote import Fetch, fetch, fetch_any
from lodestone.sources.snapshots import SnapshotTable

HELD = "another job holds this document"


@dataclass
class Catalog:
    """The job and document tables of all collections."""

    jobs: SnapshotTable
    documents: SnapshotTable

    @classmethod
    def open(cls, spark: SparkSession, root: str, buckets: int = 16) -> Catalog:
        return cls(
            SnapshotTable(spark, f"{root}/jobs", JOBS, "id", buckets),
            SnapshotTable(spark, f"{root}/documents", DOCUMENTS, "id", buckets),
        )

    def submit(self, jobs: DataFrame) -> int:
        """Store new jobs, leaving out plain ingests of complete documents; how many are new."""
        path = work_path(jobs.sparkSession, "submitted")
        # Ids are random: they are drawn once, into a table.
        skip_completed(jobs, self.documents.read()).write.parquet(path)
        new = jobs.sparkSession.read.parquet(path)
        replace_rows(self.jobs, new)
        return new.count()


def replace_rows(table: SnapshotTable, rows: DataFrame) -> None:
    """Upsert by id, rewriting only the buckets those ids fall into."""
    base = table.manifest()
    touched = table.touched(rows)
    table.commit(upsert(table.read(touched, base), rows, ["id"]), touched, base)


def assign(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Unfinished jobs with ``decision`` (run, skip, held) and the document they concern.

    Pending and interrupted jobs are both unfinished.  Of several jobs for one
    URI the oldest runs.  A document another job is ingesting is held.
    """
    open_jobs = jobs.where(F.col("status").isin("pending", "processing"))
    first = top_per_group(open_jobs, ["collection_id", "file_uri"], [F.col("created_at"), F.col("id")], 1)
    turn = open_jobs.join(first.select("id", F.lit(True).alias("_first")), "id", "left")
    known = latest_by_uri(documents).select(
        "collection_id",
        "file_uri",
        F.col("id").alias("document_id"),
        F.col("status").alias("document_status"),
        F.col("job_id").alias("document_job"),
        F.col("created_at").alias("document_created"),
        "last_etag",
    )
    joined = turn.join(known, ["collection_id", "file_uri"], "left")
    own = F.col("document_job").eqNullSafe(F.col("id"))
    held = F.col("_first").isNull() | ((F.col("document_status") == "ingesting") & ~own)
    done = (F.col("intent") == "ingest") & ~F.coalesce("force", F.lit(False)) & (F.col("document_status") == "complete")
    return joined.withColumn("decision", F.when(held, "held").when(done, "skip").otherwise("run")).drop("_first")


def run_jobs(
    catalog: Catalog,
    store: ChunkStore,
    collection: Collection,
    embedder: Embedder,
    now: datetime,
    uploads: DataFrame | None = None,
    get: Fetch = fetch_any,
    intent: str = "ingest",
    calls_per_second: float | None = CALLS_PER_SECOND,
) -> IngestReport:
    """Run one collection's unfinished jobs as one batch.

    ``uploads(file_uri, content[, etag])`` carries bytes already at hand; every
    other URI is fetched.  A document that cannot be fetched or read fails alone.
    """
    spark = store.spark
    stamp = F.lit(now).cast("timestamp")
    mine = F.col("collection_id") == collection.id
    path = work_path(spark, "assigned")
    chosen = assign(catalog.jobs.read().where(mine), catalog.documents.read().where(mine))
    # New documents get random ids, and the decisions must not change while the tables do.
    chosen.withColumn("document_id", F.coalesce("document_id", F.uuid())).write.parquet(path)
    assigned = spark.read.parquet(path)
    running = assigned.where(F.col("decision") == "run")

    _store_documents(catalog, running.withColumn("new_status", F.lit("ingesting")), stamp)
    _store_jobs(catalog, running.withColumn("new_status", F.lit("processing")), stamp)

    content_path = work_path(spark, "content")
    _with_content(running, uploads, get).write.parquet(content_path)
    content = spark.read.parquet(content_path)
    files = content.where(F.col("fetch_error").isNull()).select(
        "document_id", "file_uri", "mime_type", "extra_json", "metadata", F.col("id").alias("job_id"), "content"
    )
    report = ingest(files, store, collection, embedder, now, intent, calls_per_second)

    results = content.drop("content").join(
        report.documents.select("document_id", "name", "chunk_count", F.col("error").alias("read_error")), "document_id", "left"
    )
    failed = F.coalesce("fetch_error", "read_error")
    results = results.withColumn("new_error", failed).withColumn(
        "new_status", F.when(failed.isNull(), "complete").otherwise("failed")
    )
    _store_documents(catalog, results, stamp)
    others = assigned.where(F.col("decision") != "run").select(
        "*",
        F.when(F.col("decision") == "held", HELD).alias("new_error"),
        F.when(F.col("decision") == "held", "failed").otherwise("complete").alias("new_status"),
    )
    _store_jobs(catalog, results.unionByName(others, allowMissingColumns=True), stamp)
    lost = content.where(F.col("fetch_error").isNotNull()).select(
        "document_id", "file_uri", "mime_type", F.col("fetch_error").alias("error"), F.col("id").alias("job_id"), "took_ms"
    )
    # A document is charged with its own request, as its task measured it.
    own = content.select("document_id", F.coalesce("took_ms", F.lit(0)).alias("_took"))
    events = report.events.join(own, "document_id", "left")
    took = F.coalesce("_took", F.lit(0)).cast("long")
    events = events.withColumns({"fetch_ms": took, "total_ms": F.col("total_ms") + took}).select(*report.events.columns)
    lost = failed_events(lost, collection, embedder, intent, now)
    return IngestReport(report.documents, events.unionByName(lost), report.totals)


def _with_content(running: DataFrame, uploads: DataFrame | None, get: Fetch) -> DataFrame:
    none = F.lit(None).cast("string")
    if uploads is None:
        at_hand, remote = running.where(F.lit(False)), running
        at_hand = at_hand.withColumns({"content": F.lit(None).cast("binary"), "new_etag": none})
    else:
        etag = F.col("etag") if "etag" in uploads.columns else none
        given = uploads.select("file_uri", "content", etag.alias("new_etag"))
        at_hand = running.join(given, "file_uri")
        remote = running.join(given.select("file_uri"), "file_uri", "left_anti")
    got = fetch(remote.withColumn("_etag", none), get, etag="_etag").drop("_etag")
    fetched = got.select(
        *running.columns,
        F.col("fetched.content").alias("content"),
        F.col("fetched.etag").alias("new_etag"),
        F.col("fetched.error").alias("fetch_error"),
        F.col("fetched.took_ms").alias("took_ms"),
    )
    at_hand = at_hand.select(*running.columns, "content", "new_etag", none.alias("fetch_error"), F.lit(None).cast("long").alias("took_ms"))
    return at_hand.unionByName(fetched)


def _optional(rows: DataFrame, column: str, kind: str):
    return (F.col(column) if column in rows.columns else F.lit(None)).cast(kind)


def _store_documents(catalog: Catalog, rows: DataFrame, stamp) -> None:
    complete = F.col("new_status") == "complete"
    replace_rows(
        catalog.documents,
        rows.select(
            F.col("document_id").alias("id"),
            "collection_id",
            "file_uri",
            "mime_type",
            F.coalesce(F.when(complete, _optional(rows, "chunk_count", "int")), F.lit(0)).alias("chunk_count"),
            F.col("new_status").alias("status"),
            F.coalesce("document_created", stamp).alias("created_at"),
            stamp.alias("updated_at"),
            F.col("id").alias("job_id"),
            _optional(rows, "name", "string").alias("name"),
            F.lit(None).cast("string").alias("external_id"),
            "extra_json",
            _optional(rows, "new_error", "string").alias("error"),
            F.coalesce(F.when(complete, _optional(rows, "new_etag", "string")), "last_etag").alias("last_etag"),
        ),
    )


def _store_jobs(catalog: Catalog, rows: DataFrame, stamp) -> None:
    changed = {
        "status": F.col("new_status"),
        "error": _optional(rows, "new_error", "string"),
        "updated_at": stamp,
        "executed_at": F.coalesce("executed_at", stamp),
    }
    replace_rows(catalog.jobs, rows.select(*[changed.get(f, F.col(f)).alias(f) for f in JOBS.fieldNames()]))
