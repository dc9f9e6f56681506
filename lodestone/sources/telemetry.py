"""Append-only Parquet fact tables of usage events.

Rows are stored below ``<root>/<table>/batch=<id>/event_date=YYYY-MM-DD``, so a
dashboard's look-back reaches the scan as partition pruning as well as a pushed
filter.
"""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.schemas import TELEMETRY_TABLES

MAX_ROWS_PER_FILE = 5_000_000


def read_events(spark: SparkSession, root: str, table: str, since: datetime | None = None) -> DataFrame:
    """All files of a table, matched to the schema by column name.

    Files written before a column existed read as NULL there.  A table nobody
    has written yet is an empty frame, not an error.
    """
    schema = TELEMETRY_TABLES[table]
    try:
        rows = spark.read.schema(schema).option("mergeSchema", True).parquet(f"{root}/{table}")
    except AnalysisException as err:
        if err.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
    if since is not None:
        if "event_date" in rows.columns:
            rows = rows.where(F.col("event_date") >= F.lit(since.date()))
        rows = rows.where(F.col("occurred_at") >= F.lit(since))
    return rows.select(*schema.fieldNames())


def stamp_events(events: DataFrame) -> DataFrame:
    """Give an id and a time to events that came without."""
    return events.withColumns(
        {
            "event_id": F.coalesce(F.nullif(F.col("event_id"), F.lit("")), F.uuid()),
            "occurred_at": F.coalesce(F.col("occurred_at"), F.current_timestamp()),
        }
    )


def prepare_events(events: DataFrame, table: str, redact: bool = False) -> DataFrame:
    """Redaction blanks query texts and drops traces; traces need their event's id."""
    if table == "query_traces":
        known = F.coalesce(F.col("event_id"), F.lit("")) != ""
        return events.where(F.lit(False) if redact else known).withColumn(
            "occurred_at", F.coalesce(F.col("occurred_at"), F.current_timestamp())
        )
    stamped = stamp_events(events)
    if table == "query_events" and redact:
        stamped = stamped.withColumn("query_text", F.lit(None).cast("string"))
    return stamped


def append_events(events: DataFrame, root: str, table: str, batch: str | None = None) -> None:
    """Append one batch; a busy day is split over several files by the rebalance.

    A named batch replaces itself, so a retried streaming batch is stored once.
    """
    fields = TELEMETRY_TABLES[table].fieldNames()
    (
        events.select(*fields, F.to_date("occurred_at").alias("event_date"))
        .hint("rebalance", "event_date")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", MAX_ROWS_PER_FILE)
        .partitionBy("event_date")
        .parquet(f"{root}/{table}/batch={batch or uuid.uuid4().hex}")
    )
