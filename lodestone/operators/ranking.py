"""The first rows of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The ``k`` first rows of each group, numbered from 0.

    The bound is put on the row number itself: only then does Spark also limit
    each task's groups before the shuffle, so a group with a third of all rows
    sends ``k`` rows per task and not all of them.
    """
    window = Window.partitionBy(*keys).orderBy(*order)
    best = rows.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= k)
    return best.withColumn(rank, F.col("_n") - 1).drop("_n")
