"""User metadata (JSON text) routed into the typed slots of the chunk table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.binding import let
from lodestone.functions.dates import unix_seconds_of
from lodestone.functions.filters import FALSE_WORDS, TRUE_WORDS
from lodestone.schemas import SLOT_COLUMNS, SLOT_COUNTS, slot_column


@dataclass(frozen=True)
class MetadataField:
    name: str
    type: str
    slot: int

    @property
    def column(self) -> str:
        return slot_column(self.type, self.slot)


def field_map(fields: Sequence[MetadataField]) -> dict[str, tuple[str, int]]:
    return {f.name: (f.type, f.slot) for f in fields}


def is_json(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


def metadata_map(json_text: Column) -> Column:
    """Top-level members as ``map<string, variant>``; NULL when it is not an object."""
    return F.from_json(json_text, "map<string,variant>")


def plain_number(x: Column) -> Column:
    """A double without an exponent and without trailing zeros."""
    digits = F.regexp_replace(F.format_string("%.340f", x), r"\.?0+$", "")
    return F.when(F.abs(x) < 1e15, F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(digits)).otherwise(
        F.format_string("%.0f", x)
    )


def _seen(v: Column) -> Column:
    """A JSON value with its type and its scalar readings."""
    return F.struct(
        v.alias("value"),
        F.schema_of_variant(v).alias("shape"),
        F.try_variant_get(v, "$", "string").alias("text"),
        F.try_variant_get(v, "$", "double").alias("number"),
    )


def coerce(v: Column, kind: str) -> Column:
    """Ingest rules: cross-type conversions are allowed; a failure gives NULL."""
    return let(_seen(v), lambda s: _coerced(s, kind))


def _coerced(s: Column, kind: str) -> Column:
    shape, text, number = s["shape"], s["text"], s["number"]
    is_text, is_bool = shape == "STRING", shape == "BOOLEAN"
    is_number = shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    if kind == "str":
        return F.when(is_text | is_bool, text).when(is_number, plain_number(number))
    if kind == "num":
        return (
            F.when(is_number, number)
            .when(is_text, F.when(text.rlike(r"^\S+$"), text.try_cast("double")))
            .when(is_bool, F.when(text == "true", 1.0).otherwise(0.0))
        )
    if kind == "bool":
        word = F.lower(text)
        said = F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)
        return F.when(is_text | is_bool, said).when(is_number, number != 0)
    if kind == "date":
        whole = F.when(F.abs(number) < 9.2e18, number.cast("bigint"))
        return F.when(is_number, whole).when(is_text, unix_seconds_of(text))
    items = F.try_variant_get(s["value"], "$", "array<string>")
    all_strings = (shape == "ARRAY<STRING>") & ~F.exists(items, lambda x: x.isNull())
    return F.when(all_strings | (F.size(items) == 0), items)


def coerce_patch(v: Column, kind: str) -> Column:
    """Patch rules: types must already agree; arrays drop what is not a string."""
    if kind == "date":
        return coerce(v, kind)
    if kind == "arr":
        members = F.try_variant_get(v, "$", "array<variant>")
        strings = F.filter(members, lambda m: F.schema_of_variant(m) == "STRING")
        return F.transform(strings, lambda m: F.try_variant_get(m, "$", "string"))
    wanted = {"str": "^STRING$", "num": "^(BIGINT|DOUBLE|FLOAT|DECIMAL)", "bool": "^BOOLEAN$"}[kind]
    return F.when(F.schema_of_variant(v).rlike(wanted), coerce(v, kind))


def _typed(members: Column, fields: Sequence[MetadataField], rule) -> Column:
    return F.struct(*[rule(F.try_element_at(members, F.lit(f.name)), f.type).alias(f.column) for f in fields])


def with_slots(rows: DataFrame, json_column: str, fields: Sequence[MetadataField]) -> DataFrame:
    """Add every slot column of the chunk table, NULL where nothing valid was supplied.

    The JSON is read once per row into a struct of the declared fields.
    """
    for f in fields:
        if f.type not in SLOT_COUNTS:
            raise ValueError(f"unknown metadata field type {f.type!r}")
    empty = {c: F.lit(None).cast(kind) for c, kind in SLOT_COLUMNS.items()}
    if not fields:
        return rows.withColumns(empty)
    routed = let(metadata_map(F.col(json_column)), lambda m: _typed(m, fields, coerce))
    named = {f.column: F.col("_slots")[f.column] for f in fields}
    return rows.withColumn("_slots", routed).withColumns({**empty, **named}).drop("_slots")


def patch_slots(json_text: Column, fields: Sequence[MetadataField]) -> dict[str, Column]:
    """New slot values for a PATCH; absent or ill-typed members keep the old value."""
    members = metadata_map(json_text)
    return {
        f.column: F.coalesce(coerce_patch(F.try_element_at(members, F.lit(f.name)), f.type), F.col(f.column)) for f in fields
    }


def rejected_keys(json_column: str, fields: Sequence[MetadataField]) -> Column:
    """Names supplied but not stored (undeclared, or of the wrong type), for rows of ``with_slots``."""
    bad = F.map_keys(metadata_map(F.col(json_column)))
    stored = F.array(*[F.when(F.col(f.column).isNotNull(), F.lit(f.name)) for f in fields]).cast("array<string>")
    return F.array_sort(F.array_except(bad, stored))


def reconstruct(fields: Sequence[MetadataField]) -> Column:
    """Slots back to a JSON object keyed by field name; NULL when it would be empty."""
    shown = []
    for f in sorted(fields, key=lambda f: f.name):
        c = F.col(f.column)
        if f.type == "date":
            c = F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        shown.append(c.alias(f.name))
    if not shown:
        return F.lit(None).cast("string")
    text = F.to_json(F.struct(*shown), {"ignoreNullFields": "true"})
    return F.nullif(text, F.lit("{}"))
