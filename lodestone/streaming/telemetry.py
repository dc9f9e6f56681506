"""One stream of mixed usage events into one table per kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.schemas import TELEMETRY_TABLES
from lodestone.sources.telemetry import append_events, prepare_events

FLUSH_INTERVAL = "60 seconds"


def as_messages(events: DataFrame, kind: str) -> DataFrame:
    """Typed rows as ``(kind, payload)`` messages."""
    return events.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*events.columns)).alias("payload"))


def store_batch(messages: DataFrame, root: str, batch: str, redact: bool = False) -> None:
    """Write each kind of a batch to its table.  The batch name makes a retry harmless."""
    for table, schema in TELEMETRY_TABLES.items():
        rows = messages.where(F.col("kind") == table).select(F.from_json("payload", schema).alias("e")).select("e.*")
        append_events(prepare_events(rows, table, redact), root, table, batch)


def start_sink(
    messages: DataFrame, root: str, checkpoint: str, name: str = "telemetry", redact: bool = False, once: bool = False
) -> StreamingQuery:
    """Flush every minute; ``once`` drains what is there and stops.

    Nothing is dropped under load: the source's per-trigger limits slow the
    reader down instead.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        # The same rows feed three tables; keep them instead of re-reading the source.
        batch.persist()
        try:
            store_batch(batch, root, f"{name}-{batch_id}", redact)
        finally:
            batch.unpersist()

    writer = messages.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(flush)
    trigger = {"availableNow": True} if once else {"processingTime": FLUSH_INTERVAL}
    return writer.trigger(**trigger).start()
