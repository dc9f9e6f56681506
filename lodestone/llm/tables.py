"""Work tables of a multi-step operator: written once, dropped as soon as nothing reads them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.operators.skew import TASKS_A_CORE
from lodestone.session import work_path
from lodestone.sources import files


class WorkTables:
    """Tables of one run in the shared folder.

    A written table cuts lineage, so a lost executor never restarts earlier steps.
    ``drop`` takes tables away once their successors are written; what a lazy
    result still reads has to stay.
    """

    def __init__(self, spark: SparkSession, prefix: str) -> None:
        self.spark, self.prefix = spark, prefix
        self._written: list[tuple[DataFrame, str]] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, f"{self.prefix}-{name}")
        df.write.parquet(path)
        table = self.spark.read.schema(df.schema).parquet(path)
        self._written.append((table, path))
        return table

    def drop(self, *tables: DataFrame) -> None:
        self.drop_others(*[t for t, _ in self._written if not any(t is gone for gone in tables)])

    def drop_others(self, *kept: DataFrame) -> None:
        """Drop every table but these."""
        stays = [(t, path) for t, path in self._written if any(t is k for k in kept)]
        for _, path in self._written:
            if path not in {p for _, p in stays}:
                files.delete(self.spark, path)
        self._written = stays


def in_few_files(grouped: DataFrame) -> DataFrame:
    """Rows of a grouping for a work table of a few files a core, however many partitions the shuffle has.

    Opening and committing a file costs more than a small partition's rows.  Not for
    a join: the parts of a hot key, split over tasks, would meet in one task again.
    """
    return grouped.coalesce(grouped.sparkSession.sparkContext.defaultParallelism * TASKS_A_CORE)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that no column of ``df`` has, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
