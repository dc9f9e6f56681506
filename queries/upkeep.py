"""Files with many units, chunk-store mutations, pages and evaluation upkeep over the given tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.embedding import HashEmbedder
from lodestone.operators.running import running_total
from lodestone.plans import analytics, catalog, evaluation
from lodestone.plans.ingest import Collection, ingest
from lodestone.schemas import CHUNKS
from lodestone.session import work_path
from lodestone.sources.adapters import ingestion_events, query_events, table
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.evalsets import read_beir
from queries.common import TELEMETRY_CTE, Query, rounded
from queries.documents import DOCX, UNIT_OUT, as_files, chunks, trim_sql, units, units_sql, windows_sql


def _joined(rows: DataFrame, key: str, order: str, text, separator: str) -> DataFrame:
    """One row per key: its texts in order, as one ``body``."""
    listed = rows.select(F.col(key).alias("key"), F.struct(F.col(order).alias("o"), text.alias("t")).alias("p"))
    listed = listed.groupBy("key").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return listed.select("key", F.array_join(F.transform("ps", lambda p: p["t"]), separator).alias("body"))


# --- files with many units -----------------------------------------------------


def talk_files(spark, sf) -> DataFrame:
    """A conversation as a text file, its turns set apart by empty lines."""
    return as_files(_joined(table(spark, sf, "conversations"), "conv_id", "turn", F.col("text"), "\n\n"), "key", "text/plain", F.col("body"), grouped=True)


def order_files(spark, sf) -> DataFrame:
    """A customer's orders as one CSV file."""
    row = F.concat(F.col("o_orderkey"), F.lit(', "'), F.col("o_orderpriority"), F.lit('"'))
    body = _joined(table(spark, sf, "orders"), "o_custkey", "o_orderkey", row, "\n")
    return as_files(body, "key", "text/csv", F.concat(F.lit("key,priority\n"), F.col("body"), F.lit("\n")), grouped=True)


def nested_orders(spark, sf) -> DataFrame:
    """A customer's orders as one JSON array, each order with the list of its lines."""
    line = F.struct(
        F.col("l_linenumber").alias("at"),
        F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.lit("").alias("note")).alias("it"),
    )
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("ls"))
    held = table(spark, sf, "orders").join(lines, "o_orderkey", "left")
    order = F.struct(
        F.col("o_orderkey").alias("key"),
        F.struct(F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "F").alias("final")).alias("is"),
        F.transform("ls", lambda x: x["it"]).alias("lines"),
        F.col("o_totalprice").alias("total"),
    )
    listed = held.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("k"), order.alias("o")))).alias("os"))
    return as_files(listed, "o_custkey", "application/json", F.to_json(F.transform("os", lambda x: x["o"])), grouped=True)


_SHOWN = "regexp_replace(CAST(CAST({} AS DECIMAL(18, 2)) AS VARCHAR), '\\.?0+$', '')"
NESTED_SQL = f"""WITH lines AS (
    SELECT l_orderkey, string_agg(
      'lines.' || i || '.part: ' || l_partkey || chr(10) || 'lines.' || i || '.price: ' || {_SHOWN.format('l_extendedprice')}
      || chr(10) || 'lines.' || i || '.qty: ' || {_SHOWN.format('l_quantity')} || chr(10), '' ORDER BY i) AS t
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS i FROM lineitem) GROUP BY 1)
  SELECT CAST(o_custkey AS VARCHAR) AS document_id,
         CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT) AS unit_index,
         'is.final: ' || CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END || chr(10) || 'is.status: ' || o_orderstatus || chr(10)
         || 'key: ' || o_orderkey || chr(10) || coalesce(t, '') || 'total: ' || {_SHOWN.format('o_totalprice')} AS text
  FROM orders LEFT JOIN lines ON l_orderkey = o_orderkey"""


def order_records(spark, sf) -> DataFrame:
    """A customer's orders as the records of one XML file."""
    record = F.concat(F.lit("<order><key>"), F.col("o_orderkey"), F.lit("</key><is><status>"), F.col("o_orderstatus"), F.lit("</status></is></order>"))
    body = _joined(table(spark, sf, "orders"), "o_custkey", "o_orderkey", record, "")
    return as_files(body, "key", "application/xml", F.concat(F.lit("<list>"), F.col("body"), F.lit("</list>")), grouped=True)


TALKS = "(SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS body FROM conversations GROUP BY conv_id)"
NTH_ORDER = "CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS BIGINT)"

# Windows of 300 every 250 over the units of a file, joined by line breaks.  Where a window ends exactly
# with a unit, nothing is carried over and the next unit starts a run of its own.
UNIT_WINDOWS_SQL = f"""WITH RECURSIVE {units_sql(TALKS, 'conv_id', 'body')},
  fold(document_id, unit_index, held, run, next_run) AS (
    SELECT DISTINCT document_id, CAST(-1 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT) FROM units
    UNION ALL
    SELECT document_id, unit_index,
           CASE WHEN total >= 300 AND (total - 300) % 250 = 0 THEN 0 WHEN total < 300 THEN total ELSE (total - 300) % 250 + 50 END,
           next_run, next_run + CASE WHEN total >= 300 AND (total - 300) % 250 = 0 THEN 1 ELSE 0 END
    FROM (SELECT u.document_id, u.unit_index, f.next_run,
                 length(u.text) + CASE WHEN f.held > 0 THEN f.held + 1 ELSE 0 END AS total
          FROM fold f JOIN units u ON u.document_id = f.document_id AND u.unit_index = f.unit_index + 1)),
  whole AS (
    SELECT document_id, run, string_agg(text, chr(10) ORDER BY unit_index) AS text
    FROM units JOIN fold USING (document_id, unit_index) GROUP BY ALL),
  windows AS (
    SELECT document_id, run, j, {trim_sql('substring(text, CAST(j * 250 + 1 AS BIGINT), 300)')} AS chunk_text
    FROM (SELECT *, unnest(range(CAST(greatest(ceil((length(text) - 300) / 250.0), 0) AS BIGINT) + 1)) AS j FROM whole))
  SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY run, j) - 1 AS BIGINT) AS chunk_index, chunk_text
  FROM windows WHERE chunk_text <> ''"""


def section_files(spark, sf) -> DataFrame:
    """A conversation as a Markdown file with a section for each turn."""
    turn = F.concat(F.lit("## "), "role", F.lit("\n"), "text")
    body = _joined(table(spark, sf, "conversations"), "conv_id", "turn", turn, "\n\n")
    return as_files(body, "key", "text/markdown", F.concat(F.lit("# Talk "), F.col("key"), F.lit("\n\n"), F.col("body")), grouped=True)


def _sections(spark, sf) -> DataFrame:
    rows = units(section_files(spark, sf))
    return rows.select("document_id", "unit_index", "text", F.col("metadata")["heading"].alias("heading"))


SECTIONS_SQL = f"""SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY turn) - 1 AS BIGINT) AS unit_index, text, heading
  FROM (SELECT CAST(conv_id AS VARCHAR) AS document_id, turn, {trim_sql('text')} AS text,
               '# Talk ' || conv_id || chr(10) || '## ' || role AS heading FROM conversations) WHERE text <> ''"""

# Rows of a customer's orders packed below the head line, up to 60 characters.
ROW_GROUPS_SQL = """WITH RECURSIVE lists AS (
    SELECT o_custkey, list(o_orderkey || chr(9) || o_orderpriority ORDER BY o_orderkey) AS texts, count(*) AS n FROM orders GROUP BY 1),
  sized AS (
    SELECT *, list_transform(range(n + 1), lambda i: coalesce(list_sum(list_transform(texts[1:i], lambda t: length(t) + 1)), 0)) AS ends
    FROM lists),
  groups(o_custkey, texts, ends, n, s, c) AS (
    SELECT o_custkey, texts, ends, n, s, coalesce(list_filter(range(s + 1, n), lambda t: 13 + ends[t + 2] - ends[s + 1] > 60)[1], n)
    FROM (SELECT *, CAST(0 AS BIGINT) AS s FROM sized)
    UNION ALL
    SELECT o_custkey, texts, ends, n, s, coalesce(list_filter(range(s + 1, n), lambda t: 13 + ends[t + 2] - ends[s + 1] > 60)[1], n)
    FROM (SELECT o_custkey, texts, ends, n, c AS s FROM groups WHERE c < n))
  SELECT CAST(o_custkey AS VARCHAR) AS document_id, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY s) - 1 AS BIGINT) AS chunk_index,
         'key' || chr(9) || 'priority' || chr(10) || array_to_string(texts[s + 1:c], chr(10)) AS chunk_text FROM groups"""


# --- chunk store ---------------------------------------------------------------


def _mutated_store(spark, sf) -> DataFrame:
    """Every document as a chunk; then deletes by document and by chunk, a patch, a cleared slot."""
    given = {
        "id": F.concat(F.lit("c"), F.col("doc_id")),
        "document_id": F.col("doc_id").cast("string"),
        "chunk_hash": F.sha2("text", 256),
        "chunk_index": F.lit(0),
        "vector": F.array(F.lit(1.0)),
        "created_at": F.lit(0),
        "updated_at": F.lit(0),
        "mime_type": F.lit("text/plain"),
        "file_uri": F.col("source"),
        "source_name": F.col("source"),
        "chunk_text": F.col("text"),
        "metadata_str_1": F.col("lang"),
        "metadata_num_1": F.col("n_chars"),
        "metadata_num_2": F.col("doc_id"),
    }
    docs = table(spark, sf, "documents")
    rows = docs.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS.fields])
    store = ChunkStore(spark, work_path(spark, "upkeep"), "docs", buckets=8)
    store.append(rows.where("metadata_num_2 % 2 = 0"))
    store.append(rows.where("metadata_num_2 % 2 = 1"))
    store.delete_documents(rows.where("metadata_num_2 % 10 = 3").select("document_id"))
    store.delete_chunks(rows.where("metadata_num_2 % 10 = 4").select("document_id", "id"))
    store.update_document("5", {"metadata_str_1": F.lit("patched"), "metadata_num_1": None})
    store.null_slot("metadata_num_2")
    kept = store.read().select("id", "document_id", "chunk_text", "metadata_str_1", "metadata_num_1", "metadata_num_2")
    return kept


def _chunk_page(spark, sf) -> DataFrame:
    """The second page of the chunks of the order with the most lines."""
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("l"), F.col("l_orderkey"), F.lit("-"), F.col("l_linenumber")).alias("id"),
        F.col("l_orderkey").alias("document_id"),
        F.col("l_linenumber").cast("bigint").alias("chunk_index"),
    )
    most = lines.groupBy("document_id").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "document_id").first()
    return catalog.list_chunks(lines, most.document_id, limit=3, offset=2).select("id", "document_id", "chunk_index")


def _event_statuses(spark, sf) -> DataFrame:
    """Events of ingesting every document, each tenth of them as a word file that cannot be opened."""
    broken = F.col("doc_id") % 10 == 0
    source = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat(F.lit("upload://"), F.col("doc_id")).alias("file_uri"),
        F.when(broken, DOCX).otherwise("text/plain").alias("mime_type"),
        F.col("text").cast("binary").alias("content"),
    )
    store = ChunkStore(spark, work_path(spark, "statuses"), "docs", buckets=8)
    report = ingest(source, store, Collection("docs", "docs", ChunkConfig("sliding_window", 500, 50)), HashEmbedder(64))
    counted = report.events.groupBy("status", F.col("error").isNotNull().alias("has_error"))
    return counted.agg(F.count("*").alias("n"), F.count_if(F.col("chunk_count") > 0).alias("with_chunks"))


@dataclass(frozen=True)
class ChoosyEmbedder(HashEmbedder):
    """Refuses a call with a text that holds an at sign, as a provider's filter would."""

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        if any("@" in t for t in texts):
            raise ValueError("the input was refused")
        return super().embed(texts)


@dataclass(frozen=True)
class CountingEmbedder(HashEmbedder):
    """Bills a token for every 100 characters of a call."""

    def embed(self, texts: list[str]) -> tuple[list[list[float]], int]:
        vectors, _ = super().embed(texts)
        return vectors, sum(len(t) // 100 for t in texts)


def _ingest_totals(spark, sf) -> DataFrame:
    """What the documents of an ingest add up to, beside what was observed while its chunks were written."""
    store = ChunkStore(spark, work_path(spark, "totals"), "docs", buckets=8)
    source = as_files(table(spark, sf, "documents"), "doc_id", "text/plain", F.col("text")).withColumn("file_uri", F.lit("upload://a"))
    report = ingest(source, store, Collection("docs", "docs", ChunkConfig("sliding_window", 500, 50)), CountingEmbedder(64))
    seen = report.totals
    told = report.documents.agg(F.sum("chunk_count").alias("chunks"), F.sum("embed_tokens").alias("tokens"), F.sum("wait_ms").alias("w"), F.sum("embed_ms").alias("e"))
    equal = (F.col("chunks") == seen["chunks"]) & (F.col("tokens") == seen["tokens"]) & (F.col("w") == seen["wait_ms"]) & (F.col("e") == seen["embed_ms"])
    return told.select("chunks", "tokens", equal.alias("as_observed"))


def _refused_texts(spark, sf) -> DataFrame:
    """All documents, then all of them changed and sent to an embedder that refuses some texts."""
    store = ChunkStore(spark, work_path(spark, "refused"), "docs", buckets=8)
    target = Collection("docs", "docs", ChunkConfig("sliding_window", 500, 50))
    docs = table(spark, sf, "documents")
    ingest(as_files(docs, "doc_id", "text/plain", F.col("text")).withColumn("file_uri", F.lit("upload://a")), store, target, HashEmbedder(64))
    changed = as_files(docs, "doc_id", "text/plain", F.concat(F.lit("* "), "text")).withColumn("file_uri", F.lit("upload://a"))
    report = ingest(changed, store, target, ChoosyEmbedder(64), intent="refresh")
    kept = store.read().groupBy("document_id").agg(F.count("*").alias("stored_chunks"))
    told = report.documents.select("document_id", "status", F.col("error").isNotNull().alias("has_error"))
    return told.join(kept, "document_id", "left").na.fill(0, ["stored_chunks"])


REFUSED_SQL = (
    "WITH " + windows_sql("stored", "text") + ",\n" + windows_sql("fresh", "'* ' || text")
    + """,
  refused AS (SELECT DISTINCT document_id FROM fresh ANTI JOIN stored USING (document_id, chunk_hash) WHERE contains(chunk_text, '@')),
  old AS (SELECT document_id, count(*) AS n FROM stored GROUP BY 1), new AS (SELECT document_id, count(*) AS n FROM fresh GROUP BY 1)
  SELECT d.id AS document_id, CASE WHEN r.document_id IS NULL THEN 'complete' ELSE 'failed' END AS status,
         r.document_id IS NOT NULL AS has_error,
         CAST(coalesce(CASE WHEN r.document_id IS NULL THEN new.n ELSE old.n END, 0) AS BIGINT) AS stored_chunks
  FROM (SELECT CAST(doc_id AS VARCHAR) AS id FROM documents) d LEFT JOIN refused r ON r.document_id = d.id
  LEFT JOIN old ON old.document_id = d.id LEFT JOIN new ON new.document_id = d.id"""
)


# --- evaluation ----------------------------------------------------------------


def _beir(spark, sf) -> DataFrame:
    """Documents, benchmark questions and judgements written in the BEIR layout and read again."""
    path = work_path(spark, "beir")
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    docs.select(F.col("doc_id").cast("string").alias("_id"), F.col("source").alias("title"), "text").write.json(f"{path}/corpus.jsonl")
    items.select(F.col("item_id").cast("string").alias("_id"), "text").write.json(f"{path}/queries.jsonl")
    # Every question has judgements, however many there are: its rank decides which documents.
    ranked = running_total(items.select("item_id", F.lit(1).alias("one")), "one", [F.floor(F.col("item_id") / 1000)], [F.col("item_id")], "upto")
    ranked = ranked.select("item_id", (F.col("upto") - 1).alias("rank"))
    placed = docs.withColumn("rank", F.col("doc_id") % items.count()).join(ranked, "rank")
    judged = placed.select(
        F.col("item_id").cast("string").alias("query-id"), F.col("doc_id").cast("string").alias("corpus-id"), (F.col("doc_id") % 3).alias("score")
    )
    judged.write.option("sep", "\t").option("header", True).csv(f"{path}/qrels/test.tsv")
    corpus, queries, judged = read_beir(spark, path)
    joined = judged.join(queries, "query_id").join(corpus, "doc_id")
    return joined.select("query_id", "doc_id", F.col("relevance").cast("bigint").alias("relevance"), "query_text", F.md5("content").alias("content"))


def _usage(spark, sf) -> DataFrame:
    return query_events(spark, sf).where("endpoint = 'rag'").select(
        F.col("llm_input_tokens").alias("input_tokens"), F.col("llm_output_tokens").alias("output_tokens")
    )


def _merged_baseline(spark, sf) -> DataFrame:
    """Stored values of every segment, those of segments that were run again replaced."""
    rows = table(spark, sf, "customer").select(
        F.col("c_mktsegment").alias("track"), F.concat(F.lit("nation"), F.col("c_nationkey")).alias("metric"), "c_acctbal", "c_custkey"
    )
    value = lambda df, fn: df.groupBy("track", "metric").agg(F.round(fn("c_acctbal"), 2).cast("double").alias("value"))
    again = value(rows.where(F.col("track").isin("BUILDING", "MACHINERY")), F.max)
    return evaluation.merge_baseline(value(rows, F.min), again)


QUERIES = {
    "parse_text_units": Query(
        lambda spark, sf: units(talk_files(spark, sf)).drop("metadata"),
        "WITH " + units_sql(TALKS, "conv_id", "body") + UNIT_OUT + " FROM units",
    ),
    "parse_csv_rows": Query(
        lambda spark, sf: units(order_files(spark, sf)).drop("metadata"),
        f"""SELECT CAST(o_custkey AS VARCHAR) AS document_id, {NTH_ORDER} AS unit_index,
                   o_orderkey || chr(9) || o_orderpriority AS text FROM orders""",
    ),
    "parse_markdown_sections": Query(_sections, SECTIONS_SQL),
    "chunk_row_groups": Query(
        lambda spark, sf: chunks(order_files(spark, sf), ChunkConfig("auto", 60, 0)).select("document_id", "chunk_index", "chunk_text"),
        ROW_GROUPS_SQL,
    ),
    "parse_json_nested": Query(lambda spark, sf: units(nested_orders(spark, sf)).drop("metadata"), NESTED_SQL),
    "ingest_refused_texts": Query(_refused_texts, REFUSED_SQL),
    "ingest_totals": Query(
        _ingest_totals,
        "WITH " + windows_sql("c", "text")
        + " SELECT count(*) AS chunks, CAST(sum(length(chunk_text) // 100) AS BIGINT) AS tokens, TRUE AS as_observed FROM c",
    ),
    "parse_xml_records": Query(
        lambda spark, sf: units(order_records(spark, sf)).drop("metadata"),
        f"""SELECT CAST(o_custkey AS VARCHAR) AS document_id, {NTH_ORDER} AS unit_index,
                   'key: ' || o_orderkey || chr(10) || 'is.status: ' || o_orderstatus AS text FROM orders""",
    ),
    "chunk_sliding_window_units": Query(
        lambda spark, sf: chunks(talk_files(spark, sf), ChunkConfig("sliding_window", 300, 50)).select("document_id", "chunk_index", "chunk_text"),
        UNIT_WINDOWS_SQL,
    ),
    "store_mutations": Query(
        _mutated_store,
        """SELECT 'c' || doc_id AS id, CAST(doc_id AS VARCHAR) AS document_id, text AS chunk_text,
                  CASE WHEN doc_id = 5 THEN 'patched' ELSE lang END AS metadata_str_1,
                  CASE WHEN doc_id <> 5 THEN CAST(n_chars AS DOUBLE) END AS metadata_num_1, CAST(NULL AS DOUBLE) AS metadata_num_2
           FROM documents WHERE doc_id % 10 NOT IN (3, 4)""",
    ),
    "ingest_event_statuses": Query(
        _event_statuses,
        """SELECT CASE WHEN doc_id % 10 = 0 THEN 'failed' ELSE 'complete' END AS status, doc_id % 10 = 0 AS has_error,
                  count(*) AS n, count(*) FILTER (WHERE doc_id % 10 <> 0 AND regexp_matches(text, '[^\\s]')) AS with_chunks
           FROM documents GROUP BY ALL""",
    ),
    "chunk_page": Query(
        _chunk_page,
        """WITH most AS (SELECT l_orderkey FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
           SELECT 'l' || l_orderkey || '-' || l_linenumber AS id, l_orderkey AS document_id, CAST(l_linenumber AS BIGINT) AS chunk_index
           FROM lineitem JOIN most USING (l_orderkey) ORDER BY l_linenumber LIMIT 3 OFFSET 2""",
    ),
    "beir_loader": Query(
        _beir,
        """SELECT CAST(item_id AS VARCHAR) AS query_id, CAST(doc_id AS VARCHAR) AS doc_id, doc_id % 3 AS relevance,
                  b.text AS query_text, md5(source || chr(10) || chr(10) || d.text) AS content
           FROM documents d
           JOIN (SELECT *, row_number() OVER (ORDER BY item_id) - 1 AS r, count(*) OVER () AS n FROM benchmark) b ON b.r = d.doc_id % b.n""",
    ),
    "judge_cost": Query(
        lambda spark, sf: rounded(evaluation.judge_cost(_usage(spark, sf), "gpt-4o-mini"), 8, "estimated_usd"),
        TELEMETRY_CTE
        + """SELECT round(sum(llm_input_tokens * 0.15e0 / 1e6 + llm_output_tokens * 0.6e0 / 1e6), 8) AS estimated_usd
             FROM query_events WHERE endpoint = 'rag'""",
    ),
    "merged_baseline": Query(
        _merged_baseline,
        """SELECT c_mktsegment AS track, 'nation' || c_nationkey AS metric,
                  round(CAST(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN max(c_acctbal) ELSE min(c_acctbal) END AS DOUBLE), 2) AS value
           FROM customer GROUP BY c_mktsegment, c_nationkey""",
    ),
    "cost_without_queries": Query(
        lambda spark, sf: rounded(
            analytics.cost_by_collection(ingestion_events(spark, sf), query_events(spark, sf).limit(0), None), 8, "ingestion_cost_usd", "llm_cost_usd"
        ),
        TELEMETRY_CTE
        + """SELECT collection_slug, round(ifnull(sum(embed_cost_usd), 0e0), 8) AS ingestion_cost_usd, 0e0 AS llm_cost_usd
             FROM ingestion_events GROUP BY collection_slug""",
    ),
}
