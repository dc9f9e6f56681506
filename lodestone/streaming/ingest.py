"""Files that land in a folder are ingested batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.embedding import Embedder
from lodestone.plans.ingest import CALLS_PER_SECOND, Collection, failed_events, ingest
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.telemetry import append_events


def newest_per_uri(uploads: DataFrame) -> DataFrame:
    """One row per URI: a file dropped twice in a batch is ingested once, as it is now."""
    return uploads.groupBy("file_uri").agg(F.max_by(F.struct(*uploads.columns), "modified").alias("u")).select("u.*")


def document_id(collection: Collection, uri: str = "file_uri"):
    """The same URI is the same document on every run."""
    return F.sha2(F.concat_ws("|", F.lit(collection.id), F.col(uri)), 256)


def start_ingest(
    uploads: DataFrame,
    store: ChunkStore,
    collection: Collection,
    embedder: Embedder,
    checkpoint: str,
    telemetry_root: str | None = None,
    intent: str = "refresh",
    interval: str = "30 seconds",
    once: bool = False,
    calls_per_second: float | None = CALLS_PER_SECOND,
) -> StreamingQuery:
    """Ingest each micro-batch.

    A refused file (type, size) leaves a failed event with the reason.  A batch that is replayed after a failure finds its chunks by fingerprint and
    embeds nothing again; its event rows replace themselves by batch name.
    """

    def run(batch: DataFrame, batch_id: int) -> None:
        files = newest_per_uri(batch).withColumn("document_id", document_id(collection))
        taken = files.where(F.col("refused").isNull())
        taken = taken.drop("refused", "modified")
        report = ingest(taken, store, collection, embedder, intent=intent, calls_per_second=calls_per_second)
        if telemetry_root:
            refused = files.where(F.col("refused").isNotNull()).withColumn("error", F.col("refused"))
            events = report.events.unionByName(failed_events(refused, collection, embedder, intent))
            append_events(events, telemetry_root, "ingestion_events", f"{collection.slug}-{batch_id}")

    writer = uploads.writeStream.option("checkpointLocation", checkpoint).foreachBatch(run)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()
