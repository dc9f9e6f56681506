"""A stream of job submissions in which every job runs once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.plans.jobs import Catalog

DELAY = "1 day"  # how late a replay of a submission may come


def accepted(submissions: DataFrame, delay: str = DELAY, job: str = "id", submitted: str = "created_at") -> DataFrame:
    """The first of all submissions of a job that come within ``delay`` of each other.

    Ids are remembered until the watermark has passed them by ``delay``, so the
    state is bounded by the submissions of that time, whatever is replayed.
    """
    return submissions.withWatermark(submitted, delay).dropDuplicatesWithinWatermark([job])


def start_submissions(
    submissions: DataFrame, catalog: Catalog, checkpoint: str, delay: str = DELAY, interval: str = "10 seconds", once: bool = False
) -> StreamingQuery:
    """Store accepted jobs; a batch that is replayed after a failure stores the same rows again, by id."""

    def store(batch: DataFrame, batch_id: int) -> None:
        catalog.submit(batch)

    writer = accepted(submissions, delay).writeStream.option("checkpointLocation", checkpoint).foreachBatch(store)
    trigger = {"availableNow": True} if once else {"processingTime": interval}
    return writer.trigger(**trigger).start()
