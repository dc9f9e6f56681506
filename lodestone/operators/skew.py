"""Joining a large, possibly skewed side to a lookup side."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Largest lookup side that is sent whole to every executor.
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 * 1024 * 1024
TASKS_A_CORE = 4  # of rows that are dealt anew: the longest task is a small share of the work
KEY_ROWS = 1_000_000  # of nothing but short keys; the bytes are bounded as well
KEY_BITS, PIECE = 1 << 27, 1 << 15  # of a table of hashed keys, 16 MB at most, and of each of its rows


def fits_broadcast(lookup: DataFrame, limit: int = BROADCAST_ROWS) -> bool:
    """Whether the side is small in rows and in bytes; reads at most ``limit`` + 1 rows."""
    width = F.octet_length(F.to_json(F.struct("*")))
    seen = lookup.limit(limit + 1).select(width.alias("w")).agg(F.count("*").alias("n"), F.sum("w").alias("bytes")).first()
    return seen.n <= limit and (seen.bytes or 0) <= BROADCAST_BYTES


def without_keys(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, bool]:
    """``rows`` less those of ``keys``, and whether they stayed in the tasks that read them.

    Where the keys are many, those that stay may be few; only where both are many
    the rows are shuffled.  Keys hold no nulls; rows without a key stay.
    """
    on = keys.columns
    if fits_broadcast(keys, KEY_ROWS):
        return rows.join(F.broadcast(keys), on, "left_anti"), True
    staying = rows.select(*on).distinct().join(keys, on, "left_anti")
    if fits_broadcast(staying, KEY_ROWS):
        staying = F.broadcast(staying.toDF(*[f"_{c}" for c in on]))
        return rows.join(staying, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in on]), "left_semi"), True
    return rows.join(keys, on, "left_anti"), False


def _named(rows: DataFrame, keys: DataFrame) -> DataFrame | None:
    """``rows`` with ``_named``, whether ``keys`` has their key, told where they are read; None where that needs too much.

    Bits at the hashes of the keys say no for most other keys.  Those that meet a bit
    by chance are found from the keys alone.
    """
    on = keys.columns
    at = F.pmod(F.xxhash64(*on), F.lit(KEY_BITS))
    set_bits = keys.select(at.alias("_at")).groupBy(F.shiftright("_at", 15).alias("_piece"))
    set_bits = F.broadcast(set_bits.agg(F.bitmap_construct_agg(F.col("_at") % PIECE).alias("_bits")))

    def met(some: DataFrame) -> DataFrame:
        placed = some.withColumn("_at", at).withColumn("_piece", F.shiftright("_at", 15)).join(set_bits, "_piece", "left")
        byte = F.substring("_bits", (F.floor(F.col("_at") % PIECE / 8) + 1).cast("int"), F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (F.col("_at") % 8).cast("int"))
        whole = [F.col(c).isNotNull() for c in on]
        return placed.withColumn("_met", reduce(and_, whole, F.coalesce(bit == 1, F.lit(False)))).drop("_at", "_piece", "_bits")

    by_chance = met(rows.select(*on).distinct()).where("_met").drop("_met").join(keys, on, "left_anti")
    if not fits_broadcast(by_chance, KEY_ROWS):
        return None
    by_chance = F.broadcast(by_chance.withColumn("_chance", F.lit(True)))
    return met(rows).join(by_chance, on, "left").withColumn("_named", F.col("_met") & F.col("_chance").isNull()).drop("_met", "_chance")


def with_keys(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """``rows`` that have one of ``keys``, in the tasks that read them wherever that can be told there; no nulls in keys."""
    if fits_broadcast(keys, KEY_ROWS):
        return rows.join(F.broadcast(keys), keys.columns, "left_semi")
    named = _named(rows, keys)
    return rows.join(keys, keys.columns, "left_semi") if named is None else named.where("_named").drop("_named")


def less_keys(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, bool]:
    """:func:`without_keys`, which moves no rows either where both the keys and those that stay are many."""
    kept, in_place = without_keys(rows, keys)
    if in_place:
        return kept, True
    named = _named(rows, keys)
    return (kept, False) if named is None else (named.where("NOT _named").drop("_named"), True)


def sparse_left_join(large: DataFrame, lookup: DataFrame, on: list[str]) -> DataFrame:
    """A left join that moves only those rows of the large side that have a match."""
    keys = lookup.select(*on).dropna().distinct()
    rest, in_place = less_keys(large, keys)
    if not in_place:
        return large.join(lookup, on, "left")
    matched = with_keys(large, keys).join(lookup, on)
    added = {f.name: F.lit(None).cast(f.dataType) for f in lookup.schema.fields if f.name not in on}
    return matched.unionByName(rest.withColumns(added))


def lookup_join(
    large: DataFrame, lookup: DataFrame, on: list[str], how: str = "inner", small: bool | None = None, salts: int = 16
) -> DataFrame:
    """Join a large side to a lookup without letting a hot key land in one task.

    A lookup of checked size is broadcast.  A larger one is repeated ``salts``
    times while the large side spreads each key over the salts.  ``small`` skips
    the check when the caller has already bounded the lookup.
    """
    if fits_broadcast(lookup) if small is None else small:
        return large.join(F.broadcast(lookup), on, how)
    others = [c for c in large.columns if c not in on]
    # Rows of nothing but the key are told apart by where they are read.
    place = F.xxhash64(*others) if others else F.spark_partition_id()
    salt = F.pmod(place, F.lit(salts)).cast("int")
    spread = large.withColumn("_salt", salt)
    repeated = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return spread.join(repeated, [*on, "_salt"], how).drop("_salt")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Use every core for heavy per-row work on a table of few, large splits.

    A table with a split per core is returned as it is: nothing is shuffled.
    Splits are counted before row groups are known, so one large row group may
    hide behind several empty splits.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores * TASKS_A_CORE, *keys) if rows.rdd.getNumPartitions() < cores else rows
