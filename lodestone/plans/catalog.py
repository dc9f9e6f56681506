"""Collections, documents, jobs, prompts, keys and grants as DataFrame operators."""

from __future__ import annotations

import secrets
from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.metadata import MetadataField
from lodestone.functions.text import hash_api_key, key_hint, name_from_uri, slugify, table_name
from lodestone.schemas import CATALOG_TABLES, SLOT_COUNTS

# The read-only prompts, slug -> (id, name, content).
SYSTEM_PROMPTS = {
    "basic_rag": (
        "a0000000-0000-0000-0000-000000000001",
        "Basic RAG",
        "You are a helpful assistant. Answer the user's question using the information in the context below, "
        "including reasonable inferences that follow directly from what is stated — the answer does not need to be "
        "a verbatim quote. Answer naturally and directly — do not cite sources or reference the documents.\n\n"
        "<context>\n{{context}}\n</context>\n\n"
        "Only say \"I don't have enough information to answer this.\" if the context truly has nothing relevant to "
        "the question. Do not explain why, do not reference the documents, and do not use outside knowledge.\n\n"
        "Question: {{question}}",
    ),
    "rag_with_citations": (
        "a0000000-0000-0000-0000-000000000002",
        "RAG with Citations",
        "You are a helpful research assistant. Answer the question below using the provided context, including "
        "reasonable inferences that follow directly from what is stated.\n\n"
        "<context>\n{{context}}\n</context>\n\n"
        "Guidelines:\n"
        "- Write a clear, direct answer. Cite sources the way an academic paper does: a bracketed number immediately "
        "after the claim it supports, e.g. \"Growth elasticity of poverty depends on the level of inequality [1].\" "
        "Use the number from the source's context label (e.g. [Source 2: ...] becomes [2]). If a claim draws on more "
        "than one source, cite them together, e.g. [1][2].\n"
        "- Do not write \"According to Source X\" as a sentence prefix — the bracketed number is the citation.\n"
        "- Only say \"The provided documents don't contain enough information to answer this fully.\" if the context "
        "truly has nothing relevant to the question.\n"
        "- Do not speculate or use outside knowledge.\n\n"
        "Question: {{question}}",
    ),
    "concise_rag": (
        "a0000000-0000-0000-0000-000000000003",
        "Concise Answer",
        "Answer in 2-3 sentences using the context provided, including reasonable inferences that follow directly "
        "from what is stated. Answer naturally — do not cite sources. Only say \"I don't have that information.\" "
        "if the context truly has nothing relevant to the question.\n\n"
        "<context>\n{{context}}\n</context>\n\n"
        "Question: {{question}}",
    ),
}
DEFAULT_PROMPT = "basic_rag"
DOCUMENT_SORTS, DEFAULT_SORT = ("name", "status", "created_at", "updated_at"), "updated_at"
DEFAULT_LIMIT, CHUNK_LIMIT, MAX_LIMIT = 50, 20, 500
# Names a metadata field may not take.
RESERVED_FIELDS = {
    "created_at", "updated_at", "mime_type", "source_name", "external_id",
    "document_id", "chunk_text", "chunk_header", "file_uri", "extra_json",
}
MAX_FIELDS, MAX_FIELD_NAME = 60, 64
PERMISSIONS = ("read", "write", "both")
RESOURCES = ("keys", "prompts", "collections", "*")


class Conflict(ValueError):
    """The change collides with what is stored."""


# --- paging and lookups -----------------------------------------------------


def page_bounds(limit: str | int | None, offset: str | int | None, default: int = DEFAULT_LIMIT) -> tuple[int, int]:
    """Unusable values fall back to the default; the limit never exceeds 500."""

    def number(value) -> int | None:
        try:
            return int(value)
        except (TypeError, ValueError):
            return None

    n, skip = number(limit), number(offset)
    n = default if n is None or n <= 0 else min(n, MAX_LIMIT)
    return n, 0 if skip is None or skip < 0 else skip


def matching(rows: DataFrame, **equal) -> DataFrame:
    """Keep rows equal to every value that was given; None means "any"."""
    for column, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def page(rows: DataFrame, order: Sequence[Column], limit=None, offset=None, default: int = DEFAULT_LIMIT) -> DataFrame:
    n, skip = page_bounds(limit, offset, default)
    ordered = rows.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(n)


def list_documents(
    documents: DataFrame, sort_by: str | None = None, sort_dir: str | None = None, limit=None, offset=None, **equal
) -> DataFrame:
    """One page; an unknown sort column means ``updated_at``, the default direction is descending."""
    column = F.col(sort_by if sort_by in DOCUMENT_SORTS else DEFAULT_SORT)
    first = column.asc() if sort_dir == "asc" else column.desc()
    return page(matching(documents, **equal), [first, F.col("id")], limit, offset)


def list_chunks(chunks: DataFrame, document_id, limit=None, offset=None) -> DataFrame:
    rows = matching(chunks, document_id=document_id)
    return page(rows, [F.col("chunk_index"), F.col("id")], limit, offset, CHUNK_LIMIT)


def latest_by_uri(documents: DataFrame, key: str = "file_uri") -> DataFrame:
    """The most recently created document of each (collection, URI)."""
    newest = F.max_by(F.struct(*documents.columns), F.struct("created_at", "id"))
    return documents.groupBy("collection_id", key).agg(newest.alias("_d")).select("_d.*")


def collection_overview(collections: DataFrame, documents: DataFrame) -> DataFrame:
    """Collections with their document counts, zero where there are none."""
    counts = documents.groupBy("collection_id").agg(F.count("*").alias("document_count"))
    joined = collections.join(counts, collections["id"] == counts["collection_id"], "left").drop("collection_id")
    return joined.withColumn("document_count", F.coalesce("document_count", F.lit(0)))


# --- writes -----------------------------------------------------------------


def apply_patch(rows: DataFrame, where: Column, values: dict, clear: Sequence[str] = ()) -> DataFrame:
    """Set the given columns on matching rows; ``clear`` sets NULL, the rest stays."""
    changes = {c: F.lit(v) for c, v in values.items() if v is not None}
    changes |= {c: F.lit(None) for c in clear}
    return rows.withColumns(
        {c: F.when(where, v.cast(rows.schema[c].dataType)).otherwise(F.col(c)) for c, v in changes.items()}
    )


def upsert(rows: DataFrame, new: DataFrame, key: Sequence[str], unless_equal: Sequence[str] = ()) -> DataFrame:
    """Replace rows by key and append the others.

    With ``unless_equal`` a stored row survives untouched when those columns
    already agree, so its timestamps do not move.
    """
    if unless_equal:
        agrees = F.lit(True)
        for c in unless_equal:
            agrees = agrees & F.col(f"_old.{c}").eqNullSafe(F.col(f"_new.{c}"))
        same_key = [F.col(f"_old.{k}").eqNullSafe(F.col(f"_new.{k}")) for k in key]
        changed = new.alias("_new").join(rows.alias("_old"), [*same_key, agrees], "left_anti")
        new = changed.select("_new.*")
    return rows.join(new, list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def claim_document(documents: DataFrame, document_id: str, job_id: str, now: datetime) -> DataFrame:
    """Mark a document as being ingested by a job; refuse when another job holds it."""
    mine = F.col("id") == document_id
    held = documents.where(mine).select("status").first()
    if held is None or held.status == "ingesting":
        raise Conflict("another job holds this document")
    values = {"job_id": job_id, "status": "ingesting", "chunk_count": 0, "updated_at": now}
    return apply_patch(documents, mine, values, clear=["error"])


def may_delete_job(job_status: str) -> bool:
    return job_status not in ("pending", "processing")


def due_for_refresh(collections: DataFrame, now: Column) -> DataFrame:
    """Enabled, with an interval, and never checked or checked long enough ago."""
    age = F.unix_timestamp(now) - F.unix_timestamp("last_auto_refresh_at")
    never = F.col("last_auto_refresh_at").isNull()
    return collections.where(
        F.col("refresh_enabled")
        & F.col("refresh_interval_seconds").isNotNull()
        & (never | (age >= F.col("refresh_interval_seconds")))
    )


def skip_completed(jobs: DataFrame, documents: DataFrame) -> DataFrame:
    """Jobs left to run: a plain ingest of an already complete document is skipped."""
    done = latest_by_uri(documents).where(F.col("status") == "complete").select("collection_id", "file_uri")
    plain = (F.col("intent") == "ingest") & ~F.coalesce("force", F.lit(False))
    return jobs.where(~plain).unionByName(jobs.where(plain).join(done, ["collection_id", "file_uri"], "left_anti"))


# --- rows to store ----------------------------------------------------------


def _rows(spark: SparkSession, table: str, values: Sequence[dict]) -> DataFrame:
    schema = CATALOG_TABLES[table]
    return spark.createDataFrame([tuple(v.get(f) for f in schema.fieldNames()) for v in values], _nullable(schema))


def _nullable(schema):
    from pyspark.sql import types as T

    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields])


def new_collection(
    spark: SparkSession, collection_id: str, name: str, embed_model: str, vector_dim: int, now: datetime, **settings
) -> DataFrame:
    if not 1 <= len(name) <= 100:
        raise ValueError("name must have 1 to 100 characters")
    size, overlap = settings.get("chunk_size"), settings.get("chunk_overlap")
    if size is not None and not 100 <= size <= 32000:
        raise ValueError("chunk_size must be between 100 and 32000")
    if overlap is not None and not 0 <= overlap <= 1000:
        raise ValueError("chunk_overlap must be between 0 and 1000")
    row = {
        "id": collection_id, "name": name, "embed_model": embed_model, "vector_dim": vector_dim,
        "created_at": now, "refresh_enabled": False, **settings,
    }
    return _rows(spark, "collections", [row]).withColumns(
        {
            "slug": slugify(F.concat_ws("_", "name", "embed_model")),
            "table_name": table_name(F.col("name"), F.col("id")),
        }
    )


def check_unique(rows: DataFrame, *keys: Sequence[str]) -> None:
    """Raise when a key occurs twice; each key is counted with map-side combining."""
    for key in keys:
        twice = rows.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").first()
        if twice is not None:
            raise Conflict(f"{', '.join(key)} {tuple(twice)[:-1]!r} already exists")


def new_jobs(files: DataFrame, intent: str, now: Column, force: bool = False) -> DataFrame:
    """One pending job per ``(collection_id, file_uri, mime_type)`` row."""
    if intent not in ("ingest", "refresh", "auto_refresh"):
        raise ValueError(f"unknown intent {intent!r}")
    given = {c: F.col(c) for c in ("extra_json", "metadata") if c in files.columns}
    return files.select(
        F.uuid().alias("id"),
        "collection_id",
        "file_uri",
        "mime_type",
        F.lit("pending").alias("status"),
        F.lit(intent).alias("intent"),
        F.lit(force).alias("force"),
        now.alias("created_at"),
        now.alias("updated_at"),
        F.nullif(name_from_uri(F.col("file_uri")), F.lit("")).alias("display_name"),
        *[given.get(c, F.lit(None).cast("string")).alias(c) for c in ("extra_json", "metadata")],
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("timestamp").alias("executed_at"),
    )


def system_prompts(spark: SparkSession, now: datetime) -> DataFrame:
    rows = [
        {"id": i, "name": n, "slug": s, "content": c, "is_system": True, "created_at": now, "updated_at": now}
        for s, (i, n, c) in SYSTEM_PROMPTS.items()
    ]
    return _rows(spark, "prompts", rows)


def seed_prompts(prompts: DataFrame, now: datetime) -> DataFrame:
    """Upsert the system prompts; unchanged ones keep their timestamps."""
    return upsert(prompts, system_prompts(prompts.sparkSession, now), ["id"], ["name", "slug", "content"])


def editable_prompts(prompts: DataFrame) -> DataFrame:
    return prompts.where(~F.col("is_system"))


def new_api_key(
    spark: SparkSession, key_id: str, name: str, now: datetime, grants=(), admin_grants=(), plaintext: str | None = None
) -> tuple[str, DataFrame, DataFrame, DataFrame]:
    """The plaintext (shown once) and the three frames to store together.

    ``grants`` are ``(collection id or None, permission)``, ``admin_grants``
    ``(resource, permission)``; a key needs at least one of either.
    """
    if not grants and not admin_grants:
        raise ValueError("a key needs at least one grant")
    for _, permission in [*grants, *admin_grants]:
        if permission not in PERMISSIONS:
            raise ValueError(f"unknown permission {permission!r}")
    for resource, _ in admin_grants:
        if resource not in RESOURCES:
            raise ValueError(f"unknown resource {resource!r}")
    plaintext = plaintext or "rp_" + secrets.token_hex(32)
    key = _rows(spark, "api_keys", [{"id": key_id, "name": name, "created_at": now}]).withColumns(
        {"key_hash": hash_api_key(F.lit(plaintext)), "key_hint": key_hint(F.lit(plaintext))}
    )
    own = _rows(spark, "key_grants", [{"api_key_id": key_id, "collection_id": c, "permission": p} for c, p in grants])
    admin = _rows(
        spark, "admin_grants", [{"api_key_id": key_id, "resource_type": r, "permission": p} for r, p in admin_grants]
    )
    return plaintext, key, own, admin


def validate_key(keys: DataFrame, plaintext: str) -> DataFrame:
    """The key row that matches, if any."""
    return keys.where(F.col("key_hash") == hash_api_key(F.lit(plaintext)))


# --- access -----------------------------------------------------------------


def covers(granted: Column, required: Column) -> Column:
    return (granted == "both") | (granted == required)


def _ability(grants: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: which of read and write any of its grants covers."""
    return grants.groupBy(*keys).agg(
        F.bool_or(covers(F.col("permission"), F.lit("read"))).alias("read"),
        F.bool_or(covers(F.col("permission"), F.lit("write"))).alias("write"),
        F.bool_or(F.col("permission") == "both").alias("both"),
    )


def _able(name: str) -> Column:
    required = F.col("required")
    able = F.when(required == "read", F.col(f"{name}.read")).when(required == "write", F.col(f"{name}.write"))
    return F.coalesce(able.otherwise(F.col(f"{name}.both")), F.lit(False))


def allowed_requests(requests: DataFrame, grants: DataFrame) -> DataFrame:
    """Requests ``(api_key_id, collection_id, required)`` that some grant covers.

    A wildcard grant has no collection.  Grants are first reduced to one row per
    key (and collection), so both joins are plain equi-joins against unique keys
    rather than one join with an OR; anything unmatched is refused.
    """
    everywhere = _ability(grants.where(F.col("collection_id").isNull()), ["api_key_id"]).alias("w")
    somewhere = _ability(grants.where(F.col("collection_id").isNotNull()), ["api_key_id", "collection_id"]).alias("s")
    r = requests.alias("r")
    joined = r.join(everywhere, F.col("r.api_key_id") == F.col("w.api_key_id"), "left").join(
        somewhere,
        (F.col("r.api_key_id") == F.col("s.api_key_id")) & (F.col("r.collection_id") == F.col("s.collection_id")),
        "left",
    )
    return joined.where(_able("w") | _able("s")).select("r.*")


def wildcard_keys(grants: DataFrame, required: str) -> DataFrame:
    """Keys that may act on every collection at once."""
    everywhere = F.col("collection_id").isNull() & covers(F.col("permission"), F.lit(required))
    return grants.where(everywhere).select("api_key_id").distinct()


def allowed_admin(requests: DataFrame, admin_grants: DataFrame) -> DataFrame:
    """Requests ``(api_key_id, resource_type, required)``; ``*`` matches every resource."""
    star = admin_grants.where(F.col("resource_type") == "*").select(
        "api_key_id", F.lit(None).cast("string").alias("collection_id"), "permission"
    )
    named = admin_grants.where(F.col("resource_type") != "*").select(
        "api_key_id", F.col("resource_type").alias("collection_id"), "permission"
    )
    renamed = requests.withColumnRenamed("resource_type", "collection_id")
    return allowed_requests(renamed, star.unionByName(named)).withColumnRenamed("collection_id", "resource_type")


# --- metadata fields --------------------------------------------------------


def free_slots(fields: DataFrame) -> DataFrame:
    """The lowest free slot of every type in each collection that has fields; NULL when full.

    One row per collection gathers its slots (60 at most); a type without fields
    begins at 1.
    """
    taken = {
        kind: F.collect_set(F.when(F.col("type") == kind, F.col("slot"))).alias(kind) for kind in SLOT_COUNTS
    }
    used = fields.groupBy("collection_id").agg(*taken.values())
    free = [
        F.struct(
            F.lit(kind).alias("type"),
            F.array_min(F.array_except(F.sequence(F.lit(1), F.lit(size)), F.col(kind))).alias("slot"),
        )
        for kind, size in SLOT_COUNTS.items()
    ]
    return used.select("collection_id", F.explode(F.array(*free)).alias("f")).select("collection_id", "f.type", "f.slot")


def duplicate_names(requested: DataFrame) -> DataFrame:
    """Names that occur more than once in a collection's request, ignoring case."""
    return (
        requested.groupBy("collection_id", F.lower("name").alias("name"))
        .agg(F.count("*").alias("n"))
        .where("n > 1")
        .select("collection_id", "name")
    )


def already_registered(requested: DataFrame, fields: DataFrame) -> DataFrame:
    taken = fields.select("collection_id", F.lower("name").alias("_name")).distinct()
    asked = requested.withColumn("_name", F.lower("name"))
    return asked.join(taken, ["collection_id", "_name"], "left_semi").drop("_name")


def register_fields(
    fields: DataFrame, collection_id: str, wanted: Sequence[tuple[str, str]], now: datetime
) -> tuple[DataFrame, list[MetadataField]]:
    """Allocate the lowest free slot per field, all or nothing.

    A request has at most 60 fields and a collection at most 60 slots, so the
    allocation itself is a handful of numbers on the driver.
    """
    if not 1 <= len(wanted) <= MAX_FIELDS:
        raise ValueError(f"fields must have 1 to {MAX_FIELDS} entries")
    for name, kind in wanted:
        if not 1 <= len(name) <= MAX_FIELD_NAME:
            raise ValueError(f"name must have 1 to {MAX_FIELD_NAME} characters")
        if name in RESERVED_FIELDS:
            raise ValueError(f"{name!r} conflicts with a built-in field")
        if kind not in SLOT_COUNTS:
            raise ValueError(f"unknown metadata field type {kind!r}")
    lowered = [name.lower() for name, _ in wanted]
    if len(set(lowered)) < len(lowered):
        raise Conflict("duplicate field name in request")
    stored = fields.where(F.col("collection_id") == collection_id).select("name", "type", "slot").collect()
    taken = {(r.type, r.slot) for r in stored}
    if {r.name.lower() for r in stored} & set(lowered):
        raise Conflict("a field is already registered on this collection")
    added = []
    for name, kind in wanted:
        slot = next((n for n in range(1, SLOT_COUNTS[kind] + 1) if (kind, n) not in taken), None)
        if slot is None:
            raise Conflict(f"no available {kind} slots (max {SLOT_COUNTS[kind]} reached)")
        taken.add((kind, slot))
        added.append(MetadataField(name, kind, slot))
    values = [
        {"id": f"{collection_id}:{f.type}:{f.slot}", "collection_id": collection_id, "name": f.name,
         "type": f.type, "slot": f.slot, "created_at": now}
        for f in added
    ]
    return fields.unionByName(_rows(fields.sparkSession, "metadata_fields", values)), added


def delete_field(fields: DataFrame, collection_id: str, name: str) -> tuple[DataFrame, MetadataField]:
    """The remaining fields and the freed one, whose slot the caller then clears."""
    mine = (F.col("collection_id") == collection_id) & (F.col("name") == name)
    row = fields.where(mine).select("name", "type", "slot").first()
    if row is None:
        raise KeyError(f"field {name!r} is not registered on this collection")
    return fields.where(~mine), MetadataField(row["name"], row["type"], row["slot"])


def collection_fields(fields: DataFrame, collection_id: str) -> list[MetadataField]:
    rows = fields.where(F.col("collection_id") == collection_id).orderBy("type", "slot")
    return [MetadataField(r.name, r.type, r.slot) for r in rows.limit(sum(SLOT_COUNTS.values())).collect()]


# --- consistent metadata ----------------------------------------------------


def consistent_metadata(chunks: DataFrame, fields: Sequence[MetadataField], key: str = "document_id") -> DataFrame:
    """Per document, the fields whose value is present and equal on every chunk.

    Dates are compared and shown by day.  Only minima, maxima and counts are
    kept, so a document with very many chunks needs no more memory than another.
    """
    shown = {}
    for f in fields:
        c = F.col(f.column)
        if f.type == "date":
            c = F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd")
        shown[f.name] = c
    picks = []
    for name, c in shown.items():
        same = (F.count(c) == F.count("*")) & (F.min(c) == F.max(c))
        picks.append(F.when(same, F.min(c)).alias(name))
    return chunks.groupBy(key).agg(*picks)
