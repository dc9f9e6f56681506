"""Bounds on what a task holds at once."""

from __future__ import annotations

from pyspark.sql import SparkSession

BATCH_CONF = {
    # Whole texts travel in Arrow batches, held by the JVM and by the Python worker at the same time.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
}


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; an executor runs several Python workers beside its heap."""
    for key, value in BATCH_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
