"""Rows whose id is in a set of ids, before anything wide is shuffled.

A small set is sent to the rows.  Of a larger one a bitmap of fixed size is sent:
rows outside it are certainly not in the set, and only the others are joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import free_name

BITS = 1 << 25  # of the bitmap: 524,288 words of 64 bits at most
FEW = 500_000  # ids sent whole, at most


def _word(id_: Column) -> Column:
    return F.floor(F.pmod(F.xxhash64(id_), F.lit(BITS)) / 64).cast("int")


def _bit(id_: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(id_), F.lit(64)).cast("int"))


def _bitmap(ids: DataFrame) -> DataFrame:
    """``word, bits`` of the ids' hashes; at most ``BITS / 64`` rows."""
    id_ = F.col("id")
    return ids.select(_word(id_).alias("word"), _bit(id_).alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))


def _flagged(rows: DataFrame, id_: Column, ids: DataFrame, flag: str) -> DataFrame:
    """The rows with a boolean: the bitmap has their id."""
    word, bits = free_name(rows, "bitmap_word"), free_name(rows, "bitmap_bits")
    bitmap = F.broadcast(_bitmap(ids).toDF(word, bits))
    joined = rows.join(bitmap, _word(id_) == F.col(word), "left")
    return joined.select(*rows.columns, F.coalesce(F.col(bits).bitwiseAND(_bit(id_)) != 0, F.lit(False)).alias(flag))


def outside_and_maybe(rows: DataFrame, id_: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that are certainly not in ``ids(id)``, and the others, by the bitmap."""
    flag = free_name(rows, "maybe")
    flagged = _flagged(rows, F.col(id_), ids, flag)
    return flagged.where(~F.col(flag)).drop(flag), flagged.where(F.col(flag)).drop(flag)


def with_ids(rows: DataFrame, id_: str, ids: DataFrame, few: int | None = None) -> DataFrame:
    """Rows that may be in the stored table ``ids(id)``: all that are, and no others while the set is small."""
    if ids.count() <= (FEW if few is None else few):
        name = free_name(rows, "member_id")
        return rows.join(F.broadcast(ids.toDF(name)), F.col(id_) == F.col(name), "left_semi")
    flag = free_name(rows, "maybe")
    return _flagged(rows, F.col(id_), ids, flag).where(F.col(flag)).drop(flag)


def without_ids(rows: DataFrame, id_: str, ids: DataFrame, few: int | None = None) -> DataFrame:
    """Rows that are not in the stored table ``ids(id)``; rows without an id are not."""
    name = free_name(rows, "member_id")
    named = ids.toDF(name)
    if ids.count() <= (FEW if few is None else few):
        return rows.join(F.broadcast(named), F.col(id_) == F.col(name), "left_anti")
    sure, maybe = outside_and_maybe(rows, id_, ids)
    return sure.unionByName(maybe.join(named, F.col(id_) == F.col(name), "left_anti"))
