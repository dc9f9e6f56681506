"""Catalog, access and maintenance operators over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.metadata import MetadataField
from lodestone.plans import catalog as plan
from lodestone.plans.guards import admitted
from lodestone.sources.adapters import order_slots, table
from lodestone.sources.retention import kept_files
from queries.common import Query, rounded


def _pick(index: Column, *values: str) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _text(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def documents(spark, sf) -> DataFrame:
    """Each order as a document row; a customer's orders share one URI."""
    orders = table(spark, sf, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "ingesting").otherwise("failed")
    created = F.col("o_orderdate").cast("timestamp")
    return orders.select(
        F.col("o_orderkey").cast("string").alias("id"),
        _text("c", F.col("o_custkey") % 150).alias("collection_id"),
        _text("u", F.col("o_custkey")).alias("file_uri"),
        status.alias("status"),
        F.col("o_orderpriority").alias("name"),
        created.alias("created_at"),
        F.timestamp_seconds(F.unix_timestamp(created) + F.col("o_orderkey") % 10 * 86400).alias("updated_at"),
    )


DOCS_SQL = """docs AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, 'c' || (o_custkey % 150) AS collection_id, 'u' || o_custkey AS file_uri,
         CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'ingesting' ELSE 'failed' END AS status,
         o_orderpriority AS name, o_orderdate AS created_at,
         o_orderdate + to_days(CAST(o_orderkey % 10 AS INTEGER)) AS updated_at FROM orders)"""


def _admission(spark, sf) -> DataFrame:
    """Requests to ingest: the pages' addresses, and uploads named and filled in eight ways."""
    kind = F.col("page_id") % 8
    path = F.regexp_extract("url", "^https?://(.*)$", 1)
    name = lambda ending: F.concat(F.lit("upload://"), path, F.lit(ending))
    html = F.col("html").cast("binary")
    requests = table(spark, sf, "pages").select(
        "page_id",
        F.when(kind == 1, F.concat(F.lit("file:///"), path)).when(kind == 2, F.concat(F.lit("FTP://"), path))
        .when(kind == 3, name(".html")).when(kind == 4, name(".exe")).when(kind == 5, name(".md")).when(kind == 7, F.lit("  "))
        .otherwise(F.col("url")).alias("file_uri"),
        F.when(kind == 5, "image/png").otherwise("text/html; charset=utf-8").alias("mime_type"),
        F.when(kind.isin(3, 4, 5), html).alias("content"),
        F.when(kind == 6, F.concat(F.lit('{"n": '), F.when(F.col("page_id") % 16 == 6, "1").otherwise("oops"), F.lit("}"))).alias("metadata"),
    )
    return admitted(requests, max_mb=1).select("page_id", F.col("refused").isNull().alias("accepted"), F.col("refused").alias("reason"))


ADMISSION_SQL = """
SELECT page_id, reason IS NULL AS accepted, reason FROM (
  SELECT page_id, CASE page_id % 8
    WHEN 1 THEN 'the address has no scheme that is fetched' WHEN 2 THEN 'the address has no scheme that is fetched'
    WHEN 3 THEN CASE WHEN strlen(html) > 1048576 THEN 'the file is larger than an upload may be' END
    WHEN 4 THEN CASE WHEN strlen(html) > 1048576 THEN 'the file is larger than an upload may be' ELSE 'no reader for the extension .exe' END
    WHEN 5 THEN CASE WHEN strlen(html) > 1048576 THEN 'the file is larger than an upload may be' ELSE 'no reader for the type image/png' END
    WHEN 6 THEN CASE WHEN NOT json_valid('{"n": ' || CASE WHEN page_id % 16 = 6 THEN '1' ELSE 'oops' END || '}')
                     THEN 'the metadata is no JSON object' END
    WHEN 7 THEN 'the address is empty' END AS reason
  FROM pages)"""


def _overview(spark, sf) -> DataFrame:
    collections = table(spark, sf, "supplier").select(_text("c", F.col("s_suppkey")).alias("id"), F.col("s_name").alias("name"))
    return plan.collection_overview(collections, documents(spark, sf))


def _due(spark, sf) -> DataFrame:
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_orderstatus") == "O").alias("refresh_enabled"),
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey") % 900 * 86400).alias("refresh_interval_seconds"),
        F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp")).alias("last_auto_refresh_at"),
    )
    return plan.due_for_refresh(rows, F.lit("1998-06-01 00:00:00").cast("timestamp")).select("o_orderkey")


def _jobs_to_run(spark, sf) -> DataFrame:
    jobs = table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        _text("c", F.col("l_suppkey") % 150).alias("collection_id"),
        _text("u", F.col("l_suppkey")).alias("file_uri"),
        _pick(F.col("l_orderkey") % 3, "ingest", "refresh", "auto_refresh").alias("intent"),
        (F.col("l_linenumber") == 1).alias("force"),
    )
    return plan.skip_completed(jobs, documents(spark, sf)).select("l_orderkey", "l_linenumber")


def _requests(spark, sf) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.col("l_suppkey").cast("string").alias("api_key_id"),
        _text("c", F.col("l_partkey") % 20).alias("collection_id"),
        _pick(F.col("l_linenumber") % 3, "read", "write", "both").alias("required"),
    )


def _grants(spark, sf) -> DataFrame:
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").cast("string").alias("api_key_id"),
        F.when(F.col("s_nationkey") % 4 != 0, _text("c", F.col("s_nationkey") % 20)).alias("collection_id"),
        _pick(F.col("s_suppkey") % 3, "read", "write", "both").alias("permission"),
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("api_key_id"),
        _text("c", F.col("c_nationkey") % 20).alias("collection_id"),
        _pick(F.col("c_custkey") % 3, "both", "read", "write").alias("permission"),
    )
    return suppliers.unionByName(customers)


GRANTS_SQL = """grants AS (
  SELECT CAST(s_suppkey AS VARCHAR) AS api_key_id,
         CASE WHEN s_nationkey % 4 <> 0 THEN 'c' || (s_nationkey % 20) END AS collection_id,
         CASE s_suppkey % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'both' END AS permission FROM supplier
  UNION ALL
  SELECT CAST(c_custkey AS VARCHAR), 'c' || (c_nationkey % 20),
         CASE c_custkey % 3 WHEN 0 THEN 'both' WHEN 1 THEN 'read' ELSE 'write' END FROM customer)"""


def _admin(spark, sf) -> DataFrame:
    requests = table(spark, sf, "orders").select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("api_key_id"),
        _pick(F.col("o_orderkey") % 3, "keys", "prompts", "collections").alias("resource_type"),
        _pick(F.col("o_orderkey") % 2, "read", "write").alias("required"),
    )
    grants = table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("api_key_id"),
        _pick(F.col("c_nationkey") % 4, "keys", "prompts", "collections", "*").alias("resource_type"),
        _pick(F.col("c_custkey") % 3, "both", "read", "write").alias("permission"),
    )
    return plan.allowed_admin(requests, grants).select("o_orderkey")


def _fields(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select(
        _text("c", F.col("o_custkey")).alias("collection_id"),
        _pick(F.col("o_orderkey") % 5, "str", "num", "bool", "date", "arr").alias("type"),
        (F.col("o_orderkey") % 7 % 3 + 1).cast("int").alias("slot"),
        F.col("o_orderpriority").alias("name"),
    ).distinct()


FIELDS_SQL = """fields AS (
  SELECT DISTINCT 'c' || o_custkey AS collection_id,
         CASE o_orderkey % 5 WHEN 0 THEN 'str' WHEN 1 THEN 'num' WHEN 2 THEN 'bool' WHEN 3 THEN 'date' ELSE 'arr' END AS type,
         CAST(o_orderkey % 7 % 3 + 1 AS INTEGER) AS slot, o_orderpriority AS name FROM orders)"""


def _asked_names(spark, sf) -> DataFrame:
    mixed = F.when(F.col("l_linenumber") % 2 == 0, F.upper("l_returnflag")).otherwise(F.lower("l_returnflag"))
    return table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("collection_id"), mixed.alias("name"))


def _registered(spark, sf) -> DataFrame:
    taken = table(spark, sf, "lineitem").where(F.col("l_linestatus") == "F").select(
        F.col("l_suppkey").alias("collection_id"), F.col("l_returnflag").alias("name")
    )
    return plan.already_registered(_asked_names(spark, sf), taken).groupBy("collection_id", F.lower("name").alias("name")).agg(
        F.count("*").alias("n")
    )


ORDER_FIELDS = (
    MetadataField("priority", "str", 1),
    MetadataField("total", "num", 1),
    MetadataField("open", "bool", 1),
    MetadataField("ordered", "date", 1),
)


def _consistent(spark, sf) -> DataFrame:
    """Every customer's orders as chunks of one document."""
    return rounded(plan.consistent_metadata(order_slots(spark, sf), ORDER_FIELDS), 6, "total")


def _upsert(spark, sf) -> DataFrame:
    stored = table(spark, sf, "customer").select("c_custkey", F.col("c_mktsegment").alias("content"), F.lit(0).cast("bigint").alias("version"))
    new = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.when(F.col("c_custkey") % 2 == 0, F.lit("BUILDING")).otherwise(F.min("o_orderpriority")).alias("content"),
        F.lit(1).cast("bigint").alias("version"),
    )
    return plan.upsert(stored, new, ["c_custkey"], ["content"])


def _patch(spark, sf) -> DataFrame:
    rows = table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return plan.apply_patch(rows, F.col("c_mktsegment") == "BUILDING", {"c_name": "renamed", "c_nationkey": None}, ["c_mktsegment"])


def _retention(spark, sf) -> DataFrame:
    listing = table(spark, sf, "documents").select(
        F.col("doc_id").alias("path"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 2592000).alias("modified"),
        F.col("n_chars").alias("bytes"),
    )
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return kept_files(listing, now, 20, 1_000_000).select("path", F.col("newer_bytes").cast("bigint").alias("newer_bytes"))


QUERIES = {
    "ingest_admission": Query(_admission, ADMISSION_SQL),
    "list_documents": Query(
        lambda spark, sf: plan.list_documents(documents(spark, sf), "created_at", "asc", 20, 40, status="complete").select("id"),
        f"WITH {DOCS_SQL} SELECT id FROM docs WHERE status = 'complete' ORDER BY created_at, id LIMIT 20 OFFSET 40",
    ),
    "list_documents_default": Query(
        lambda spark, sf: plan.list_documents(documents(spark, sf), "no_such_column", None, "0", "x").select("id"),
        f"WITH {DOCS_SQL} SELECT id FROM docs ORDER BY updated_at DESC, id LIMIT 50",
    ),
    "count_documents": Query(
        lambda spark, sf: documents(spark, sf).groupBy("collection_id", "status").agg(F.count("*").alias("n")),
        f"WITH {DOCS_SQL} SELECT collection_id, status, CAST(count(*) AS BIGINT) AS n FROM docs GROUP BY 1, 2",
    ),
    "latest_document": Query(
        lambda spark, sf: plan.latest_by_uri(documents(spark, sf)).select("collection_id", "file_uri", "id", "status"),
        f"""WITH {DOCS_SQL} SELECT collection_id, file_uri, id, status FROM docs
            QUALIFY row_number() OVER (PARTITION BY collection_id, file_uri ORDER BY created_at DESC, id DESC) = 1""",
    ),
    "collection_overview": Query(
        _overview,
        f"""WITH {DOCS_SQL} SELECT 'c' || s_suppkey AS id, s_name AS name, CAST(count(docs.id) AS BIGINT) AS document_count
            FROM supplier LEFT JOIN docs ON docs.collection_id = 'c' || s_suppkey GROUP BY 1, 2""",
    ),
    "due_for_refresh": Query(
        _due,
        """SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey % 7 <> 0
           AND (o_orderkey % 11 = 0 OR epoch(TIMESTAMP '1998-06-01') - epoch(o_orderdate) >= o_custkey % 900 * 86400)""",
    ),
    "jobs_to_run": Query(
        _jobs_to_run,
        f"""WITH {DOCS_SQL}, latest AS (
              SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY collection_id, file_uri ORDER BY created_at DESC, id DESC) = 1)
            SELECT l_orderkey, l_linenumber FROM lineitem
            WHERE NOT (l_orderkey % 3 = 0 AND l_linenumber <> 1 AND EXISTS (
              SELECT 1 FROM latest WHERE status = 'complete' AND file_uri = 'u' || l_suppkey AND collection_id = 'c' || (l_suppkey % 150)))""",
    ),
    "collection_access": Query(
        lambda spark, sf: plan.allowed_requests(_requests(spark, sf), _grants(spark, sf)).select("l_orderkey", "l_linenumber"),
        f"""WITH {GRANTS_SQL} SELECT l_orderkey, l_linenumber FROM lineitem WHERE EXISTS (
              SELECT 1 FROM grants WHERE api_key_id = CAST(l_suppkey AS VARCHAR)
              AND (collection_id IS NULL OR collection_id = 'c' || (l_partkey % 20))
              AND (permission = 'both'
                   OR permission = CASE l_linenumber % 3 WHEN 0 THEN 'read' WHEN 1 THEN 'write' ELSE 'both' END))""",
    ),
    "admin_access": Query(
        _admin,
        """SELECT o_orderkey FROM orders WHERE EXISTS (
             SELECT 1 FROM customer WHERE c_custkey = o_custkey
             AND (c_nationkey % 4 = 3 OR c_nationkey % 4 = o_orderkey % 3)
             AND (c_custkey % 3 = 0 OR (c_custkey % 3 = 1 AND o_orderkey % 2 = 0) OR (c_custkey % 3 = 2 AND o_orderkey % 2 = 1)))""",
    ),
    "wildcard_keys": Query(
        lambda spark, sf: plan.wildcard_keys(_grants(spark, sf), "read"),
        f"WITH {GRANTS_SQL} SELECT DISTINCT api_key_id FROM grants WHERE collection_id IS NULL AND permission IN ('read', 'both')",
    ),
    "free_slots": Query(
        lambda spark, sf: plan.free_slots(_fields(spark, sf)),
        f"""WITH {FIELDS_SQL}, have AS (
                SELECT DISTINCT collection_id, t.type FROM fields, (VALUES ('str'), ('num'), ('bool'), ('date'), ('arr')) AS t(type)),
              slots AS (SELECT collection_id, type, unnest(range(1, CASE WHEN type = 'str' THEN 21 ELSE 11 END)) AS n FROM have)
            SELECT collection_id, type, CAST(min(n) AS INTEGER) AS slot FROM slots s
            WHERE NOT EXISTS (SELECT 1 FROM fields f WHERE f.collection_id = s.collection_id AND f.type = s.type AND f.slot = s.n)
            GROUP BY 1, 2""",
    ),
    "duplicate_field_names": Query(
        lambda spark, sf: plan.duplicate_names(_asked_names(spark, sf)),
        """SELECT l_orderkey AS collection_id, lower(l_returnflag) AS name FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1""",
    ),
    "registered_field_names": Query(
        _registered,
        """SELECT l_orderkey AS collection_id, lower(l_returnflag) AS name, CAST(count(*) AS BIGINT) AS n FROM lineitem l
           WHERE EXISTS (SELECT 1 FROM lineitem f WHERE f.l_linestatus = 'F' AND f.l_suppkey = l.l_orderkey
                         AND f.l_returnflag = l.l_returnflag) GROUP BY 1, 2""",
    ),
    "consistent_metadata": Query(
        _consistent,
        """WITH s AS (SELECT o_custkey AS document_id, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority,
                  o_totalprice AS total, o_orderstatus = 'O' AS open, strftime(o_orderdate, '%Y-%m-%d') AS ordered FROM orders)
           SELECT document_id,
             CASE WHEN count(priority) = count(*) AND count(DISTINCT priority) = 1 THEN min(priority) END AS priority,
             round(CASE WHEN count(DISTINCT total) = 1 THEN min(total) END, 6) AS total,
             CASE WHEN count(DISTINCT open) = 1 THEN bool_and(open) END AS open,
             CASE WHEN count(DISTINCT ordered) = 1 THEN min(ordered) END AS ordered
           FROM s GROUP BY document_id""",
    ),
    "upsert_changed": Query(
        _upsert,
        """WITH new AS (SELECT o_custkey AS k, CASE WHEN o_custkey % 2 = 0 THEN 'BUILDING' ELSE min(o_orderpriority) END AS content
                        FROM orders GROUP BY o_custkey)
           SELECT coalesce(c_custkey, k) AS c_custkey,
                  CASE WHEN k IS NULL OR c_mktsegment = content THEN c_mktsegment ELSE content END AS content,
                  CAST(CASE WHEN k IS NULL OR c_mktsegment = content THEN 0 ELSE 1 END AS BIGINT) AS version
           FROM customer FULL OUTER JOIN new ON c_custkey = k""",
    ),
    "patch_rows": Query(
        _patch,
        """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 'renamed' ELSE c_name END AS c_name,
                  CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment END AS c_mktsegment, c_nationkey FROM customer""",
    ),
    "retention": Query(
        _retention,
        """SELECT path, CAST(newer AS BIGINT) AS newer_bytes FROM (
             SELECT doc_id AS path, sum(n_chars) OVER (ORDER BY m DESC, doc_id DESC ROWS UNBOUNDED PRECEDING) AS newer
             FROM (SELECT *, 1704067200 + doc_id * 7919 % 2592000 AS m FROM documents)
             WHERE epoch(TIMESTAMP '2024-01-31') - m <= 20 * 86400)
           WHERE newer <= 1000000""",
    ),
}
