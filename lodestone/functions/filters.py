"""Mongo-style filter documents compiled to ``Column`` predicates.

A filter never becomes SQL text, so a value cannot break out of its literal, and
Catalyst sees ordinary comparisons it can push to the Parquet scan.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field
from datetime import datetime, timezone
from decimal import Decimal
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.dates import parse_any_date, parse_relative_date
from lodestone.schemas import slot_column

BUILTIN_FIELDS = {
    "created_at": "timestamp",
    "updated_at": "timestamp",
    "mime_type": "str",
    "source_name": "str",
    "external_id": "str",
    "file_uri": "str",
}
TRUE_WORDS = {"true", "1", "yes"}
FALSE_WORDS = {"false", "0", "no"}
SPARK_TYPE = {"str": "string", "num": "double", "bool": "boolean", "date": "bigint", "timestamp": "bigint", "arr": "array<string>"}


class FilterError(ValueError):
    """The filter document is malformed or does not fit the declared fields."""


@dataclass
class FilterCompiler:
    """``fields`` maps a declared name to ``(type, slot)``; ``now`` fixes relative dates."""

    fields: dict[str, tuple[str, int]] = field(default_factory=dict)
    now: datetime | None = None

    def compile(self, raw: str | bytes | dict | None) -> Column | None:
        """The predicate, or None when there is nothing to filter on."""
        if raw is None or (isinstance(raw, (str, bytes)) and not raw):
            return None
        node = raw
        if isinstance(raw, (str, bytes)):
            try:
                node = json.loads(raw)
            except ValueError as err:
                raise FilterError(f"filter: invalid JSON: {err}") from err
        if node == {}:
            return None
        return self._node(node)

    def _node(self, node) -> Column:
        if not isinstance(node, dict):
            raise FilterError(f"filter: expected object, got {type(node).__name__}")
        if not node:
            return F.lit(True)
        return _all([self._entry(key, value) for key, value in node.items()])

    def _entry(self, key: str, value) -> Column:
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise FilterError(f"filter: {key} requires an array")
            if not value:
                raise FilterError(f"filter: empty {key} array")
            parts = [self._node(v) for v in value]
            return _all(parts) if key == "$and" else reduce(lambda a, b: a | b, parts)
        column, kind = self._resolve(key)
        ops = value if isinstance(value, dict) else {"$eq": value}
        if not ops:
            return F.lit(True)
        return _all([self._operator(column, kind, op, arg) for op, arg in ops.items()])

    def _resolve(self, name: str) -> tuple[Column, str]:
        if name in BUILTIN_FIELDS:
            return F.col(name), BUILTIN_FIELDS[name]
        if name not in self.fields:
            raise FilterError(f"filter: field {name!r} is not registered on this collection")
        kind, slot = self.fields[name]
        return F.col(slot_column(kind, slot)), kind

    def _operator(self, c: Column, kind: str, op: str, arg) -> Column:
        if op in COMPARISONS:
            return COMPARISONS[op](c, self._literal(arg, kind))
        if op in ("$in", "$nin"):
            if not isinstance(arg, list):
                raise FilterError(f"filter: {op} takes a list of values")
            if not arg:
                raise FilterError(f"filter: the list after {op} is empty")
            hit = c.isin(*[self._literal(v, kind) for v in arg])
            return hit if op == "$in" else ~hit
        if op == "$exists":
            if not isinstance(arg, bool):
                raise FilterError("filter: $exists takes true or false")
            return c.isNotNull() if arg else c.isNull()
        if op == "$like":
            self._only(op, kind, "str", "timestamp")
            return c.cast("string").like(_text(op, arg))
        if op == "$ilike":
            self._only(op, kind, "str")
            return c.ilike(_text(op, arg))
        if op == "$contains":
            self._only(op, kind, "arr")
            return _known(c, F.array_contains(c, F.lit(_text(op, arg))))
        if op in ("$containsAny", "$containsAll"):
            self._only(op, kind, "arr")
            if not isinstance(arg, list):
                raise FilterError(f"filter: {op} requires an array value")
            wanted = F.array(*[F.lit(_text(op, v)) for v in arg]).cast("array<string>")
            if op == "$containsAny":
                return _known(c, F.arrays_overlap(c, wanted))
            return _known(c, F.size(F.array_except(wanted, c)) == 0)
        raise FilterError(f"filter: unknown operator {op!r}")

    @staticmethod
    def _only(op: str, kind: str, *allowed: str) -> None:
        if kind not in allowed:
            raise FilterError(f"filter: {op} is only valid on {allowed[0]} fields")

    def _literal(self, value, kind: str) -> Column:
        return F.lit(self._coerce(value, kind)).cast(SPARK_TYPE[kind])

    def _coerce(self, value, kind: str):
        if value is None:
            return None
        if kind == "arr" or isinstance(value, (list, dict)):
            raise FilterError(f"filter: unsupported value {value!r} for a {kind} field")
        if isinstance(value, bool):
            if kind == "bool":
                return value
            if kind == "str":
                return "true" if value else "false"
            raise FilterError(f"filter: cannot compare a {kind} field with a boolean")
        if isinstance(value, (int, float)):
            if kind == "str":
                return shortest_number(float(value))
            if kind in ("date", "timestamp"):
                return int(value)
            if kind == "num":
                return float(value)
            raise FilterError(f"filter: cannot compare a {kind} field with a number")
        if kind in ("date", "timestamp"):
            return self._moment(value)
        if kind == "bool":
            word = value.lower()
            if word in TRUE_WORDS or word in FALSE_WORDS:
                return word in TRUE_WORDS
            raise FilterError(f"filter: cannot parse {value!r} as bool")
        if kind == "num":
            try:
                return float(value)
            except ValueError as err:
                raise FilterError(f"filter: cannot compare a num field with {value!r}") from err
        return value

    def _moment(self, text: str) -> int:
        seconds = parse_any_date(text)
        if seconds is None:
            seconds = parse_relative_date(text, self.now or datetime.now(timezone.utc))
        if seconds is None:
            raise FilterError(f"filter: cannot parse date/time {text!r}")
        return seconds


COMPARISONS = {
    "$eq": lambda c, v: c == v,
    "$ne": lambda c, v: c != v,
    "$gt": lambda c, v: c > v,
    "$gte": lambda c, v: c >= v,
    "$lt": lambda c, v: c < v,
    "$lte": lambda c, v: c <= v,
}


def compile_filter(raw, fields=None, now: datetime | None = None) -> Column | None:
    return FilterCompiler(fields or {}, now).compile(raw)


def shortest_number(x: float) -> str:
    """Shortest round-trip digits; exponent form when the decimal exponent is
    below -4 or at least 6, otherwise plain."""
    if math.isnan(x) or math.isinf(x):
        return "NaN" if math.isnan(x) else ("+Inf" if x > 0 else "-Inf")
    if x == 0:
        return "0"
    exact = Decimal(repr(x)).normalize()
    power = exact.adjusted()
    if -4 <= power < 6:
        return format(exact, "f")
    mantissa = format(exact.scaleb(-power), "f")
    return f"{mantissa}e{'-' if power < 0 else '+'}{abs(power):02d}"


def _all(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, parts)


def _text(op: str, value) -> str:
    if not isinstance(value, str):
        raise FilterError(f"filter: {op} requires a string value")
    return value


def _known(c: Column, hit: Column) -> Column:
    """NULL elements must not turn a miss into UNKNOWN; a NULL array stays NULL."""
    return F.when(c.isNotNull(), F.coalesce(hit, F.lit(False)))
