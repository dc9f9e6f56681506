"""Files to units: rows of ``(kind, text, metadata)`` kept in an array per document.

Plain text and Markdown stay in Spark expressions.  Formats that need a real
reader pass through one Arrow function per batch; every row keeps its own error,
so a broken file fails alone.  No step shuffles.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import json_text, markup, records
from lodestone.functions.text import trim_unicode
from lodestone.schemas import UNITS

PARSED = T.StructType(
    [
        T.StructField("units", UNITS),
        T.StructField("title", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)
PAGE = T.StructType(
    [
        T.StructField("markdown", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


def unit(kind: str, text: Column, metadata: Column | None = None) -> Column:
    empty = F.create_map().cast("map<string,string>")
    return F.struct(
        F.lit(kind).alias("kind"),
        text.alias("text"),
        (empty if metadata is None else metadata).alias("metadata"),
    )


def normal_lines(text: Column) -> Column:
    """Drop the carriage return that ends a line."""
    return F.regexp_replace(text, r"\r(?=\n|\z)", "")


def text_units(text: Column) -> Column:
    """Paragraphs: an empty line separates, a line of blanks does not."""
    paragraphs = F.transform(F.split(normal_lines(text), r"\n\n+"), trim_unicode)
    return F.transform(F.filter(paragraphs, lambda p: p != ""), lambda p: unit("paragraph", p))


def text_title(text: Column) -> Column:
    return F.nullif(F.regexp_extract(normal_lines(text), r"([^\n]+)", 1), F.lit(""))


def _sections(text: Column) -> Column:
    """The text cut in front of each ATX heading line."""
    pieces = F.split(normal_lines(text), r"(?dm)^(?=#{1,6} )")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.length(F.regexp_extract(p, "^(#{1,6}) ", 1)).alias("level"),
            trim_unicode(F.regexp_extract(p, r"^#{1,6} ([^\n]*)", 1)).alias("title"),
            trim_unicode(F.regexp_replace(p, r"^#{1,6} [^\n]*", "")).alias("body"),
        ),
    )


def markdown_units(text: Column) -> Column:
    """Sections with the breadcrumb of headings above them; empty bodies are skipped."""
    heads = "array<struct<level:int,title:string>>"
    start = F.struct(
        F.array().cast(heads).alias("stack"),
        F.array().cast("array<struct<heading:string,body:string>>").alias("done"),
    )

    def step(acc: Column, s: Column) -> Column:
        here = F.struct(s["level"].alias("level"), s["title"].alias("title"))
        above = F.filter(acc["stack"], lambda h: h["level"] < s["level"])
        stack = F.when(s["level"] > 0, F.concat(above, F.array(here))).otherwise(acc["stack"])
        crumbs = F.transform(stack, lambda h: F.concat(F.repeat(F.lit("#"), h["level"]), F.lit(" "), h["title"]))
        section = F.struct(F.array_join(crumbs, "\n").alias("heading"), s["body"].alias("body"))
        done = F.when(s["body"] != "", F.concat(acc["done"], F.array(section))).otherwise(acc["done"])
        return F.struct(stack.alias("stack"), done.alias("done"))

    folded = F.aggregate(_sections(text), start, step, lambda acc: acc["done"])
    return F.transform(
        folded, lambda s: unit("section", s["body"], F.create_map(F.lit("heading"), s["heading"]))
    )


def markdown_title(text: Column) -> Column:
    named = F.filter(_sections(text), lambda s: (s["level"] == 1) & (s["title"] != ""))
    return F.try_element_at(named, F.lit(1))["title"]


# The readers are marked non-deterministic so that the optimizer neither repeats
# a call in a pushed-down filter nor moves it.
@F.arrow_udf(PARSED)
def _read_records(content: pa.Array, mime: pa.Array) -> pa.Array:
    out = []
    for body, kind in zip(content, mime):
        if not body.is_valid:
            out.append(None)
            continue
        try:
            units = records.READERS[kind.as_py()](body.as_py())
            title = records.document_title(kind.as_py(), units)
            rows = [{"kind": k, "text": t, "metadata": list(m.items())} for k, t, m in units]
            out.append({"units": rows, "title": title, "error": None})
        except Exception as err:
            out.append({"units": [], "title": None, "error": f"{type(err).__name__}: {err}"})
    return pa.array(out, to_arrow_type(PARSED))


@F.arrow_udf(PAGE)
def _read_page(page: pa.Array) -> pa.Array:
    out = []
    for body in page:
        if not body.is_valid:
            out.append(None)
            continue
        try:
            text = body.as_py()
            out.append({"markdown": markup.html_to_markdown(text), "title": markup.page_title(text), "error": None})
        except Exception as err:
            out.append({"markdown": None, "title": None, "error": f"{type(err).__name__}: {err}"})
    return pa.array(out, to_arrow_type(PAGE))


read_records = _read_records.asNondeterministic()
read_page = _read_page.asNondeterministic()


def parse_documents(docs: DataFrame, content: str = "content", mime: str = "mime_type") -> DataFrame:
    """Add ``units``, ``title`` and ``error`` to a frame of raw files.

    ``content`` is binary; text formats are read as UTF-8.  An unsupported MIME
    type is an error of that row.
    """
    kind = F.col(mime)
    structured = kind.isin(*records.READERS)
    is_html = kind == "text/html"
    is_json = kind == "application/json"
    is_markdown = kind == "text/markdown"
    is_text = kind.startswith("text/") & ~structured & ~is_html & ~is_markdown
    text = F.make_valid_utf8(F.col(content).cast("string"))

    read = docs.withColumns(
        {
            "_records": read_records(F.when(structured, F.col(content).cast("binary")), kind),
            "_page": read_page(F.when(is_html, text)),
            "_json": json_text.parsed_json(F.when(is_json, text)),
        }
    )
    page = F.col("_page.markdown")
    units = (
        F.when(is_text, text_units(text))
        .when(is_markdown, markdown_units(text))
        .when(is_html, F.when(page != "", markdown_units(page)))
        .when(structured, F.col("_records.units"))
        .when(is_json, F.transform(json_text.json_texts(text, F.col("_json")), lambda t: unit("row", t)))
    )
    title = (
        F.when(is_text, text_title(text))
        .when(is_markdown, markdown_title(text))
        .when(is_html, F.col("_page.title"))
        .when(structured, F.col("_records.title"))
    )
    known = is_text | is_markdown | is_html | is_json | structured
    unsupported = F.when(~F.coalesce(known, F.lit(False)), F.concat(F.lit("unsupported mime type "), F.coalesce(kind, F.lit("NULL"))))
    broken = F.when(is_json, json_text.json_error(text, F.col("_json")))
    error = F.coalesce(F.col("_records.error"), F.col("_page.error"), broken, unsupported)
    return read.select(
        *docs.columns,
        F.coalesce(units, F.array().cast(UNITS)).alias("units"),
        title.alias("title"),
        error.alias("error"),
    )


def explode_units(parsed: DataFrame, *keys: str) -> DataFrame:
    # The outer form: for the inner one Spark adds a size filter that computes the units twice.
    rows = parsed.select(*keys, F.posexplode_outer("units").alias("unit_index", "unit"))
    return rows.where(F.col("unit_index").isNotNull()).select(
        *keys, "unit_index", "unit.kind", "unit.text", "unit.metadata"
    )
