"""Streaming sinks, drained over the whole event and document tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.embedding import HashEmbedder
from lodestone.operators.keyword import query_terms, read_index, search_postings, write_index
from lodestone.plans import analytics as plan
from lodestone.plans.ingest import Collection, ingest
from lodestone.session import work_path
from lodestone.sources.adapters import corpus, files, ingestion_from, queries_from, table
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.telemetry import read_events
from lodestone.streaming.jobs import accepted
from lodestone.streaming.telemetry import as_messages, start_sink
from lodestone.streaming.timers import due_checks, use_timers
from queries.analytics import QUERIES as PANELS
from queries.common import Query, rounded
from queries.documents import windows_sql
from queries.retrieval import ALL_DOCS, ONE_QUERY, WORDS, _bm25_cte


def _streamed_volume(spark, sf) -> DataFrame:
    """Events read as a stream, sorted into tables by kind, then counted."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    messages = as_messages(ingestion_from(events), "ingestion_events").unionByName(
        as_messages(queries_from(events), "query_events")
    )
    root = work_path(spark, "telemetry")
    start_sink(messages, root, work_path(spark, "telemetry-checkpoint"), "streamed_volume", once=True).awaitTermination()
    return plan.volume_over_time(read_events(spark, root, "ingestion_events"), read_events(spark, root, "query_events"))


CONFIG = ChunkConfig("sliding_window", 500, 50)


def _ingested(spark, sf) -> DataFrame:
    """All documents ingested twice: the second pass reuses every vector."""
    store = ChunkStore(spark, work_path(spark, "chunks"), "corpus", buckets=8)
    target = Collection("corpus", "corpus", CONFIG)
    ingest(files(spark, sf), store, target, HashEmbedder(64))
    again = ingest(files(spark, sf), store, target, HashEmbedder(64), intent="refresh")
    return again.documents.select(
        "document_id",
        "status",
        F.col("chunk_count").cast("bigint").alias("chunk_count"),
        "reused_chunks",
        F.col("stale_chunks").cast("bigint").alias("stale_chunks"),
    )


def _indexed_search(spark, sf) -> DataFrame:
    """Keyword search that opens only the posting buckets of its terms."""
    path = work_path(spark, "postings")
    write_index(corpus(spark, sf), path)
    asked = spark.createDataFrame([(0, WORDS)], "query_id int, query_text string")
    hits = search_postings(read_index(spark, path, query_terms(spark, WORDS)), asked, 200)
    return rounded(hits.select("id", "keyword_bm25_score"), 6, "keyword_bm25_score")


def _once(rows: DataFrame, schema: str, spark, name: str) -> DataFrame:
    """What a stream wrote until its input was drained."""
    path = work_path(spark, name)
    writer = rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", work_path(spark, f"{name}-checkpoint"))
    writer.trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(schema).parquet(path)


SLICES = 6


def _streamed_jobs(spark, sf) -> DataFrame:
    """Every event as a job submission, six slices of time one after the other, each with a replay of the one before."""
    events = table(spark, sf, "events").select(F.concat(F.lit("j"), "event_id").alias("id"), F.col("ts").cast("timestamp").alias("created_at"))
    first, last = events.agg(F.min(F.unix_micros("created_at")), F.max(F.unix_micros("created_at"))).first()
    step = (last - first) // SLICES + 1
    part = F.floor((F.unix_micros("created_at") - first) / step)
    path = work_path(spark, "submissions")
    for i in range(SLICES):
        events.where(part.isin(i - 1, i)).repartition(2, F.xxhash64("id", F.lit(i))).write.mode("append").parquet(path)
    source = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 2).parquet(path)
    once = accepted(source, f"{3 * step // 1_000_000} seconds")
    done = _once(once, "id string, created_at timestamp", spark, "accepted")
    return done.select("id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


def _streamed_checks(spark, sf) -> DataFrame:
    """Seven collections that are named by every event, each with its own interval: when they are due, by the events' time."""
    schema = table(spark, sf, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    slot = F.col("user_id") % 7
    named = events.select(
        F.concat(F.lit("c"), slot).alias("collection_id"), ((slot + 1) * 43_200).alias("interval_s"), F.col("ts").cast("timestamp").alias("changed_at")
    )
    use_timers(spark)
    due = due_checks(named, event_time="1 hour", every_missed=True)
    done = _once(due, "collection_id string, due_at timestamp", spark, "due")
    return done.select("collection_id", F.unix_millis("due_at").alias("due_ms"))


CHECKS_SQL = """WITH named AS (
    SELECT 'c' || (user_id % 7) AS collection_id, (user_id % 7 + 1) * 43200000 AS every_ms, epoch_us(min(ts)) // 1000 AS first_ms FROM events GROUP BY ALL),
  upto AS (SELECT epoch_us(max(ts)) // 1000 - 3600000 AS now_ms FROM events)
  SELECT collection_id, first_ms + k * every_ms AS due_ms
  FROM (SELECT *, unnest(range(1, CAST((now_ms - first_ms) // every_ms AS BIGINT) + 1)) AS k FROM named, upto)"""


QUERIES = {
    "stream_jobs": Query(
        _streamed_jobs, "SELECT 'j' || event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM events"
    ),
    "stream_refresh_checks": Query(_streamed_checks, CHECKS_SQL),
    "stream_telemetry": Query(
        _streamed_volume, PANELS["volume_over_time"].sql.replace("WHERE occurred_at >= TIMESTAMP '2024-01-10 00:00:00'", "")
    ),
    "ingest_twice": Query(
        _ingested,
        "WITH " + windows_sql("c", "text")
        + """ SELECT document_id, 'complete' AS status, CAST(count(*) AS BIGINT) AS chunk_count,
              CAST(count(*) AS BIGINT) AS reused_chunks, CAST(0 AS BIGINT) AS stale_chunks FROM c GROUP BY document_id""",
    ),
    "keyword_search_indexed": Query(
        _indexed_search,
        f"""WITH {_bm25_cte(ALL_DOCS, ONE_QUERY)}
          SELECT id, round(score, 6) AS keyword_bm25_score FROM scored ORDER BY score DESC, id LIMIT 200""",
    ),
}
