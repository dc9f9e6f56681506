"""Running totals over a whole table, level by level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(rows: DataFrame, value: str, levels: list[Column], order: list[Column], name: str) -> DataFrame:
    """Total of ``value`` up to and including each row, ordered by the levels and then ``order``.

    A single global window would send every row to one task.  Here rows are
    summed per innermost bucket, those sums per next outer bucket, and so on;
    each window then runs within one outer bucket.  Only the outermost totals
    pass through an unpartitioned window, so the first level should be coarse.
    """
    keys = [f"_l{i}" for i in range(len(levels))]
    keyed = rows.withColumns(dict(zip(keys, levels)))
    sums = {len(keys): keyed.groupBy(*keys).agg(F.sum(value).alias("_v"))}
    for depth in range(len(keys) - 1, 0, -1):
        sums[depth] = sums[depth + 1].groupBy(*keys[:depth]).agg(F.sum("_v").alias("_v"))

    before = None
    for depth in range(1, len(keys) + 1):
        outer, key = keys[: depth - 1], keys[depth - 1]
        window = (Window.partitionBy(*outer) if outer else Window).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        offset = F.coalesce(F.sum("_v").over(window), F.lit(0))
        here = sums[depth].withColumn("_here", offset).drop("_v")
        if before is None:
            before = here.withColumnRenamed("_here", "_before")
        else:
            before = here.join(before, outer).select(*keys[:depth], (F.col("_before") + F.col("_here")).alias("_before"))

    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(before, keys)
        .withColumn(name, F.col("_before") + F.sum(value).over(inner))
        .drop("_before", *keys)
    )
