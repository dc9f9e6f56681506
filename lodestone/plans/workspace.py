"""The whole surface on one storage root: collections, documents, search, answers, keys."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import slugify
from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.embedding import Registry
from lodestone.plans import catalog as rules
from lodestone.plans.events import query_events, query_traces
from lodestone.plans.guards import admitted
from lodestone.plans.ingest import Collection, IngestReport, failed_events, patch_document
from lodestone.plans.jobs import Catalog, run_jobs
from lodestone.plans.rag import answer
from lodestone.plans.retrieval import RAG_TOP_K, SearchRequest, at_least, search_stored
from lodestone.schemas import CATALOG_TABLES
from lodestone.session import work_path
from lodestone.sources.chunk_store import DEFAULT_BUCKETS, ChunkStore
from lodestone.sources.files import write_new
from lodestone.sources.remote import Fetch, fetch_any, head_content_type, with_types
from lodestone.sources.snapshots import SnapshotTable
from lodestone.sources.telemetry import append_events, prepare_events, read_events
from lodestone.streaming.refresh import refresh_sweep

SMALL_TABLES = ("collections", "metadata_fields", "api_keys", "key_grants", "admin_grants", "prompts")


class Workspace:
    """Catalog, chunk stores and telemetry below ``root``; ``now`` is passed in, so runs repeat."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        embedders: Registry,
        models: Registry,
        chunking: ChunkConfig = ChunkConfig(),
        buckets: int = DEFAULT_BUCKETS,
        redact: bool = False,
    ) -> None:
        self.spark, self.root, self.buckets, self.redact = spark, root.rstrip("/"), buckets, redact
        self.embedders, self.models, self.chunking = embedders, models, chunking
        self.work = Catalog.open(spark, f"{self.root}/catalog")
        self.tables = {t: SnapshotTable(spark, f"{self.root}/catalog/{t}", CATALOG_TABLES[t]) for t in SMALL_TABLES}

    def rows(self, table: str) -> DataFrame:
        return self.tables[table].read()

    def _add(self, table: str, new: DataFrame, *unique: list[str]) -> None:
        base = self.tables[table].manifest()
        both = self.tables[table].read(at=base).unionByName(new.select(*CATALOG_TABLES[table].fieldNames()))
        rules.check_unique(both, *unique)
        self.tables[table].commit(both, None, base)

    def _one(self, table: str, **equal) -> Row:
        row = rules.matching(self.rows(table), **equal).first()
        if row is None:
            raise KeyError(f"no such entry in {table}: {equal}")
        return row

    # --- collections ---------------------------------------------------------

    def create_collection(self, name: str, now: datetime, embed_model: str | None = None, **chunking) -> Row:
        embedder = self.embedders.get(embed_model)
        new = rules.new_collection(self.spark, str(uuid.uuid4()), name, embedder.model, embedder.dim, now, **chunking)
        self._add("collections", new, ["slug"], ["name", "embed_model"])
        row = self._one("collections", name=name, embed_model=embedder.model)
        try:
            self.store(row).create(text_index=True)
        except Exception:
            self.tables["collections"].rewrite(lambda t: t.where(F.col("id") != row.id))
            raise
        return row

    def collection(self, slug: str) -> Row:
        return self._one("collections", slug=slug)

    def list_collections(self, limit=None, offset=None) -> DataFrame:
        return rules.page(self.rows("collections"), [F.col("created_at").desc(), F.col("id")], limit, offset)

    def patch_collection(self, slug: str, **changes) -> Row:
        row = self.collection(slug)
        self.tables["collections"].rewrite(lambda t: rules.apply_patch(t, F.col("id") == row.id, changes))
        return self._one("collections", id=row.id)

    def delete_collection(self, slug: str) -> None:
        """Drop the chunks, then the entry and everything that belongs to it."""
        row = self.collection(slug)
        self.store(row).drop()
        others = F.coalesce(F.col("collection_id") != row.id, F.lit(True))
        for table in ("metadata_fields", "key_grants"):
            self.tables[table].rewrite(lambda t: t.where(others))
        for table in (self.work.jobs, self.work.documents):
            table.rewrite(lambda t: t.where(others))
        self.tables["collections"].rewrite(lambda t: t.where(F.col("id") != row.id))

    def store(self, collection: Row) -> ChunkStore:
        """The collection's chunks; the slots of its fields are the indexed columns."""
        fields = rules.collection_fields(self.rows("metadata_fields"), collection.id)
        return ChunkStore(self.spark, f"{self.root}/chunks", collection.id, self.buckets, [f.column for f in fields])

    def _described(self, row: Row) -> Collection:
        config = self.chunking.override(row.chunk_strategy, row.chunk_size, row.chunk_overlap)
        fields = rules.collection_fields(self.rows("metadata_fields"), row.id)
        return Collection(row.id, row.slug, config, tuple(fields))

    # --- metadata fields -----------------------------------------------------

    def register_fields(self, slug: str, wanted: list[tuple[str, str]], now: datetime) -> None:
        """All or nothing: the catalog is written after every slot was cleared."""
        row = self.collection(slug)
        fields, added = rules.register_fields(self.rows("metadata_fields"), row.id, wanted, now)
        self.store(row).index_slots([f.column for f in added])
        self.tables["metadata_fields"].commit(fields)

    def delete_field(self, slug: str, name: str) -> None:
        row = self.collection(slug)
        fields, freed = rules.delete_field(self.rows("metadata_fields"), row.id, name)
        self.tables["metadata_fields"].commit(fields)
        self.store(row).drop_slot(freed.column)

    # --- documents and jobs --------------------------------------------------

    def ingest(
        self,
        slug: str,
        files: DataFrame,
        now: datetime,
        intent: str = "ingest",
        force: bool = False,
        get: Fetch = fetch_any,
        head: Callable[[str], str | None] = head_content_type,
    ) -> IngestReport:
        """Submit ``files(file_uri, mime_type[, content, metadata, extra_json, etag])`` and run them.

        Rows with content are uploads, rows without are fetched; of an address without
        a type, the extension or else its server tells it.  Rows that may not
        be ingested become failed events with the reason, never jobs.
        """
        row = self.collection(slug)
        stamp = F.lit(now).cast("timestamp")
        # Judged once, into a table: jobs and refusals must not see different answers.
        path = work_path(self.spark, "judged")
        admitted(with_types(files, head)).write.parquet(path)
        judged = self.spark.read.parquet(path)
        files = judged.where(F.col("refused").isNull()).drop("refused")
        asked = files.withColumn("collection_id", F.lit(row.id))
        self.work.submit(rules.new_jobs(asked, intent, stamp, force))
        uploads = files.where(F.col("content").isNotNull()) if "content" in files.columns else None
        embedder = self.embedders.get(row.embed_model)
        report = run_jobs(self.work, self.store(row), self._described(row), embedder, now, uploads, get, intent)
        refused = judged.where(F.col("refused").isNotNull()).select(
            F.lit("").alias("document_id"),
            F.coalesce("file_uri", F.lit("")).alias("file_uri"),
            F.coalesce("mime_type", F.lit("")).alias("mime_type"),
            F.col("refused").alias("error"),
        )
        lost = failed_events(refused, self._described(row), embedder, intent, now)
        self._record("ingestion_events", report.events.unionByName(lost))
        return report

    def refresh(self, now: datetime, get: Fetch = fetch_any) -> int:
        """Check the documents of due collections and ingest what changed; how many did."""
        collections = self.rows("collections")
        sweep = refresh_sweep(collections, self.work.documents.read(), now, get)
        path = work_path(self.spark, "swept")
        sweep.collections.write.parquet(path)
        self.tables["collections"].commit(self.spark.read.schema(collections.schema).parquet(path))
        changed = sweep.changed.groupBy("collection_id").agg(F.count("*").alias("n")).collect()
        for found in changed:
            row = self._one("collections", id=found.collection_id)
            mine = sweep.changed.where(F.col("collection_id") == row.id)
            files = mine.select("file_uri", "mime_type", "extra_json", "content", F.col("new_etag").alias("etag"))
            self.ingest(row.slug, files, now, "auto_refresh", get=get)
        return sum(found.n for found in changed)

    def list_documents(self, slug: str | None = None, **options) -> DataFrame:
        collection_id = None if slug is None else self.collection(slug).id
        return rules.list_documents(self.work.documents.read(), collection_id=collection_id, **options)

    def list_jobs(self, slug: str | None = None, status: str | None = None, limit=None, offset=None) -> DataFrame:
        collection_id = None if slug is None else self.collection(slug).id
        rows = rules.matching(self.work.jobs.read(), collection_id=collection_id, status=status)
        return rules.page(rows, [F.col("created_at").desc(), F.col("id")], limit, offset)

    def delete_job(self, job_id: str) -> None:
        job = rules.matching(self.work.jobs.read(), id=job_id).first()
        if job is None:
            raise KeyError(f"no such job: {job_id}")
        if not rules.may_delete_job(job.status):
            raise rules.Conflict("the job has not ended yet")
        own = self.spark.createDataFrame([(job_id,)], "id string")
        self.work.jobs.rewrite(lambda t: t.where(F.col("id") != job_id), self.work.jobs.touched(own))

    def list_chunks(self, slug: str, document_id: str, limit=None, offset=None) -> DataFrame:
        store = self.store(self.collection(slug))
        key = self.spark.createDataFrame([(document_id,)], "document_id string")
        return rules.list_chunks(store.read(store.touched(key)), document_id, limit, offset)

    def document_metadata(self, slug: str, document_id: str) -> DataFrame:
        row = self.collection(slug)
        store, key = self.store(row), self.spark.createDataFrame([(document_id,)], "document_id string")
        mine = store.read(store.touched(key)).where(F.col("document_id") == document_id)
        return rules.consistent_metadata(mine, self._described(row).fields)

    def update_document(
        self, slug: str, document_id: str, name: str | None = None, metadata: str | None = None, extra_json: str | None = None
    ) -> None:
        row = self.collection(slug)
        patch_document(self.store(row), document_id, self._described(row).fields, metadata, extra_json)
        key = self.spark.createDataFrame([(document_id,)], "id string")
        values = {"name": name, "extra_json": extra_json or None}
        clear = ["extra_json"] if extra_json == "" else []
        self.work.documents.rewrite(
            lambda t: rules.apply_patch(t, F.col("id") == document_id, values, clear), self.work.documents.touched(key)
        )

    def delete_document(self, slug: str, document_id: str) -> None:
        store = self.store(self.collection(slug))
        store.delete_documents(self.spark.createDataFrame([(document_id,)], "document_id string"))
        key = self.spark.createDataFrame([(document_id,)], "id string")
        self.work.documents.rewrite(lambda t: t.where(F.col("id") != document_id), self.work.documents.touched(key))

    # --- search and answers --------------------------------------------------

    def _search(self, row: Row, text: str, request: SearchRequest) -> tuple[DataFrame, dict[str, int]]:
        """The results, and what the question cost: embedding tokens and the time of each stage."""
        started = time.monotonic()
        embedder = self.embedders.get(row.embed_model)
        vectors, tokens = embedder.embed([text])
        vector = vectors[0]
        embedded = time.monotonic()
        norm = sum(x * x for x in vector) ** 0.5
        unit = [x / norm for x in vector] if norm else vector
        path = work_path(self.spark, "results")
        # At most top_k rows: kept so that the answer and the event see the same ones.
        search_stored(self.store(row), text, unit, request).write.parquet(path)
        done = time.monotonic()
        figures = {
            "embed_query_tokens": tokens,
            "embed_ms": int((embedded - started) * 1000),
            "vector_search_ms": int((done - embedded) * 1000),
            "total_ms": int((done - started) * 1000),
        }
        return self.spark.read.parquet(path), figures

    def _request(self, row: Row, **options) -> SearchRequest:
        return SearchRequest(fields=self._described(row).fields, **options)

    def _record(self, table: str, events: DataFrame) -> None:
        append_events(prepare_events(events, table, self.redact), f"{self.root}/telemetry", table)

    def _asked(self, text: str, now: datetime, key_id: str | None, figures=None, error: str | None = None) -> DataFrame:
        row = (0, text, str(uuid.uuid4()), now, key_id)
        schema = "query_id int, query_text string, event_id string, occurred_at timestamp, api_key_id string"
        asked = self.spark.createDataFrame([row], schema)
        told = {c: F.lit(v).cast("long") for c, v in (figures or {}).items()}
        return asked.withColumns(told | ({"error": F.lit(error)} if error else {}))

    def _failed(self, row: Row, text: str, now: datetime, key_id: str | None, request: SearchRequest, endpoint: str, error: Exception, filters_json=None, took_ms: int = 0) -> None:
        """A failed question is an event too."""
        asked = self._asked(text, now, key_id, {"total_ms": took_ms}, f"{type(error).__name__}: {error}"[:2000])
        none = self.spark.createDataFrame(
            [], "query_id int, rank int, source_name string, vector_similarity double, keyword_bm25_score double, rrf_score float"
        )
        events = query_events(
            asked, none, request, self._described(row), endpoint, row.embed_model, filters_json=filters_json
        )
        self._record("query_events", events)

    def search(self, slug: str, text: str, now: datetime, key_id: str | None = None, **options) -> DataFrame:
        row = self.collection(slug)
        request = self._request(row, **options)
        filters = str(options["filters"]) if options.get("filters") else None
        started = time.monotonic()
        try:
            results, figures = self._search(row, text, request)
        except Exception as err:
            took = int((time.monotonic() - started) * 1000)
            self._failed(row, text, now, key_id, request, "query", err, filters, took)
            raise
        asked = self._asked(text, now, key_id, figures)
        events = query_events(
            asked, results, request, self._described(row), "query", row.embed_model, filters_json=filters
        )
        self._record("query_events", events)
        self._record("query_traces", query_traces(asked, results))
        return results.orderBy("rank")

    def rag(
        self,
        slug: str,
        text: str,
        now: datetime,
        prompt: str = rules.DEFAULT_PROMPT,
        model: str | None = None,
        min_similarity: float | None = None,
        key_id: str | None = None,
        top_k: int = RAG_TOP_K,
        **options,
    ) -> tuple[DataFrame, DataFrame]:
        """The answer row and the chunks it was given; a failed completion is recorded too."""
        row = self.collection(slug)
        template = self._one("prompts", slug=prompt)
        request = self._request(row, top_k=top_k, **options)
        provider = self.models.get(model)
        started = time.monotonic()
        try:
            results, figures = self._search(row, text, request)
        except Exception as err:
            self._failed(row, text, now, key_id, request, "rag", err, took_ms=int((time.monotonic() - started) * 1000))
            raise
        kept = at_least(results, min_similarity)
        asked = self._asked(text, now, key_id, figures)
        path = work_path(self.spark, "answers")
        # The completion is paid for once.
        done = answer(asked, kept, template.content, provider).join(asked.drop("query_text"), "query_id")
        done.withColumn("prompt_slug", F.lit(prompt)).write.parquet(path)
        total_ms = int((time.monotonic() - started) * 1000)
        done = self.spark.read.parquet(path).withColumn("total_ms", F.lit(total_ms).cast("long"))
        events = query_events(
            done, kept, request, self._described(row), "rag", row.embed_model, self.models.local_models()
        )
        self._record("query_events", events)
        self._record("query_traces", query_traces(done, kept))
        return done, kept.orderBy("rank")

    def events(self, table: str, since: datetime | None = None) -> DataFrame:
        return read_events(self.spark, f"{self.root}/telemetry", table, since)

    # --- prompts -------------------------------------------------------------

    def seed_prompts(self, now: datetime) -> None:
        self.tables["prompts"].commit(rules.seed_prompts(self.rows("prompts"), now))

    def create_prompt(self, name: str, content: str, now: datetime) -> None:
        values = (str(uuid.uuid4()), name, "", content, False, now, now)
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in CATALOG_TABLES["prompts"].fields)
        new = self.spark.createDataFrame([values], fields).withColumn("slug", slugify(F.col("name")))
        self._add("prompts", new, ["name"], ["slug"])

    def _own_prompt(self, slug: str) -> Column:
        if self._one("prompts", slug=slug).is_system:
            raise PermissionError("system prompts are read-only")
        return F.col("slug") == slug

    def update_prompt(self, slug: str, now: datetime, name: str | None = None, content: str | None = None) -> None:
        own = self._own_prompt(slug)
        values = {"name": name, "content": content, "updated_at": now}
        renamed = slugify(F.col("name"))

        def change(t: DataFrame) -> DataFrame:
            patched = rules.apply_patch(t.withColumn("_own", own), F.col("_own"), values)
            return patched.withColumn("slug", F.when(F.col("_own") & F.lit(name is not None), renamed).otherwise(F.col("slug")))

        self.tables["prompts"].rewrite(change)

    def delete_prompt(self, slug: str) -> None:
        own = self._own_prompt(slug)
        self.tables["prompts"].rewrite(lambda t: t.where(~own))

    def list_prompts(self, limit=None, offset=None) -> DataFrame:
        return rules.page(rules.editable_prompts(self.rows("prompts")), [F.col("created_at").desc(), F.col("id")], limit, offset)

    # --- keys ----------------------------------------------------------------

    def create_key(self, name: str, now: datetime, grants=(), admin_grants=(), plaintext: str | None = None) -> str:
        """Grants are stored before the key, so a half-stored key opens nothing."""
        plaintext, key, own, admin = rules.new_api_key(
            self.spark, str(uuid.uuid4()), name, now, grants, admin_grants, plaintext
        )
        try:
            self._add("key_grants", own)
            self._add("admin_grants", admin)
            self._add("api_keys", key, ["key_hash"])
        except Exception:
            # Nothing of a key that could not be stored stays behind.
            key_id = key.first().id
            for table in ("key_grants", "admin_grants"):
                self.tables[table].rewrite(lambda t: t.where(F.col("api_key_id") != key_id))
            raise
        return plaintext

    def first_key(self, now: datetime) -> str | None:
        """The master key of a workspace that has no key yet, kept in its ``api_key`` file; None where there are keys."""
        if not self.rows("api_keys").isEmpty():
            return None
        plaintext = self.create_key("master", now, [(None, "both")], [("*", "both")])
        write_new(self.spark, f"{self.root}/api_key", plaintext + "\n")
        return plaintext

    def key(self, plaintext: str) -> Row | None:
        return rules.validate_key(self.rows("api_keys"), plaintext).first()

    def may(self, plaintext: str, collection_id: str, required: str) -> bool:
        """Unknown keys and missing grants are refused."""
        key = self.key(plaintext)
        if key is None:
            return False
        asked = self.spark.createDataFrame(
            [(key.id, collection_id, required)], "api_key_id string, collection_id string, required string"
        )
        return rules.allowed_requests(asked, self.rows("key_grants")).first() is not None

    def delete_key(self, key_id: str) -> None:
        self.tables["api_keys"].rewrite(lambda t: t.where(F.col("id") != key_id))
        for table in ("key_grants", "admin_grants"):
            self.tables[table].rewrite(lambda t: t.where(F.col("api_key_id") != key_id))
