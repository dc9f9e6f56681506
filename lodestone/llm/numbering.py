"""Positions in a total order without sorting a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.tables import WorkTables

_LOW = (1 << 33) - 1  # the row number part of Spark's monotonic id


def numbered(df: DataFrame, group: Column, order: list[Column], tables: WorkTables, name: str) -> tuple[DataFrame, DataFrame]:
    """``(rows, sizes)``: the rows with a ``group`` and a ``pos`` (0 upwards inside it), and ``group, n``.

    Rows are split by ranges of (group, order), so a group that holds a third of all
    rows spreads over many tasks; only one count per task and group meets again.
    Nulls come first.  ``df`` should be a written table, since ranges are sampled from it.
    """
    keyed = df.withColumn("group", group)
    sort = [F.col("group").asc_nulls_first(), *order]
    ranged = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort)
    placed = ranged.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND(_LOW))
    placed = tables.write(placed, name)
    parts = placed.groupBy("_task", "group").agg(F.min("_row").alias("_first"), F.count("*").alias("_count"))
    before = Window.partitionBy("group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("_before", F.coalesce(F.sum("_count").over(before), F.lit(0)))
    starts = parts.select(F.col("_task").alias("_t"), F.col("group").alias("_g"), (F.col("_before") - F.col("_first")).alias("_shift"))
    rows = placed.join(starts, (F.col("_task") == F.col("_t")) & F.col("group").eqNullSafe(F.col("_g")))
    rows = rows.withColumn("pos", F.col("_row") + F.col("_shift")).drop("_task", "_row", "_t", "_g", "_shift")
    return rows, parts.groupBy("group").agg(F.sum("_count").alias("n"))
