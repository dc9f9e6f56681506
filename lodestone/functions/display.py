"""Labels the dashboard shows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Short names of MIME types.
MIME_LABELS = {
    "application/pdf": "PDF",
    "text/html": "HTML",
    "text/plain": "Text",
    "text/markdown": "Markdown",
    "text/csv": "CSV",
    "application/json": "JSON",
    "text/xml": "XML",
    "application/xml": "XML",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "Word",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "Excel",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "PowerPoint",
}


def mime_label(mime: Column) -> Column:
    table = F.create_map(*[F.lit(x) for item in MIME_LABELS.items() for x in item])
    return F.coalesce(F.try_element_at(table, mime), F.substring_index(mime, "/", -1))


def friendly_uri(uri: Column) -> Column:
    return F.regexp_replace(uri, "^(upload|file)://", "")


def interval_text(seconds: Column) -> Column:
    def plural(n: Column, unit: str) -> Column:
        n = n.cast("bigint")
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n == 1, "").otherwise("s"))

    return (
        F.when(seconds % 86400 == 0, plural(seconds / 86400, "day"))
        .when(seconds % 3600 == 0, plural(seconds / 3600, "hour"))
        .otherwise(plural(F.floor(seconds / 60 + F.lit(0.5)), "minute"))
    )


def time_ago(then: Column, now: Column) -> Column:
    mins = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60)
    return (
        F.when(mins < 1, F.lit("just now"))
        .when(mins < 60, F.concat(mins.cast("string"), F.lit("m ago")))
        .when(mins < 1440, F.concat(F.floor(mins / 60).cast("string"), F.lit("h ago")))
        .when(mins < 10080, F.concat(F.floor(mins / 1440).cast("string"), F.lit("d ago")))
        .otherwise(F.date_format(then, "MMM d, yyyy"))
    )


def usd(amount: Column) -> Column:
    """Four decimals for fractions of a cent, two otherwise."""
    digits = F.when((amount < 0.01) & (amount > 0), F.format_string("%.4f", amount))
    return F.concat(F.lit("$"), digits.otherwise(F.format_string("%.2f", amount)))


def milliseconds(ms: Column) -> Column:
    return F.concat(F.format_number(F.floor(ms + F.lit(0.5)), 0), F.lit("ms"))


def percent(share: Column) -> Column:
    return F.concat(F.format_string("%.1f", share * F.lit(100.0)), F.lit("%"))
