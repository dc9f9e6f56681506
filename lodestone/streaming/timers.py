"""Refresh checks by timers: each collection has its own interval and its own next check."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DUE = "collection_id string, due_ms long"


def use_timers(spark: SparkSession) -> None:
    """State with timers lives in the state store that spills to disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_PROVIDER)


class RefreshTimers(StatefulProcessor):
    """State of a collection: its interval, its last check, and one timer for the next.

    ``every_missed`` gives every check that a pause of the stream left out, else one
    stands for all.
    """

    def __init__(self, every_missed: bool, event_time: bool) -> None:
        self.every_missed, self.event_time = every_missed, event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.checks = handle.getValueState("checks", "interval_ms long, last_ms long")

    def _now(self, values) -> int:
        return values.getCurrentWatermarkInMs() if self.event_time else values.getCurrentProcessingTimeInMs()

    def _plan(self, interval: int, last: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.checks.update((interval, last))
        if interval > 0:
            self.handle.registerTimer(last + interval)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """A registration or a new interval; an interval of 0 stops the checks."""
        seen = sorted((r.changed_ms, r.interval_ms) for r in rows)
        known = self.checks.get() if self.checks.exists() else None
        self._plan(seen[-1][1], known[1] if known else seen[0][0])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        interval, last = self.checks.get()
        now, due = self._now(timerValues), last + interval
        out = []
        while due <= now:
            if self.every_missed or due + interval > now:
                out.append(Row(collection_id=key[0], due_ms=due))
            last, due = due, due + interval
        self._plan(interval, last)
        return iter(out)

    def close(self) -> None:
        pass


def due_checks(registrations: DataFrame, event_time: str | None = None, every_missed: bool = False) -> DataFrame:
    """``collection_id, due_at`` from the stream ``registrations(collection_id, interval_s, changed_at)``.

    Timers follow the clock, or with ``event_time`` (how late rows may come) the
    stream's own time.
    """
    rows, mode = registrations, "ProcessingTime"
    if event_time:
        rows, mode = rows.withWatermark("changed_at", event_time), "EventTime"
    interval = (F.col("interval_s") * 1000).cast("long").alias("interval_ms")
    rows = rows.select("collection_id", interval, F.unix_millis("changed_at").alias("changed_ms"), "changed_at")
    processor = RefreshTimers(every_missed, event_time is not None)
    due = rows.groupBy("collection_id").transformWithState(processor, DUE, "Append", mode)
    return due.select("collection_id", F.timestamp_millis("due_ms").alias("due_at"))


def start_refresh(
    registrations: DataFrame, check: Callable[[DataFrame], None], checkpoint: str, interval: str = "60 seconds"
) -> StreamingQuery:
    """Hand every batch of due collections to ``check``."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            check(batch)

    writer = due_checks(registrations).writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(run).trigger(processingTime=interval).start()
