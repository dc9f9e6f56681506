"""Units to chunks.  Everything happens inside a document's row, so no shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.functions import chunkers
from lodestone.functions.binding import let
from lodestone.functions.text import breadcrumb, embedded_text, fingerprint, trim_unicode
from lodestone.schemas import CHUNK

STRATEGIES = ("auto", "unit", "paragraph", "sliding_window", "section", "row_group")

# The strategy "auto" stands for, by MIME type; other text/* is paragraph.
AUTO_STRATEGY = {
    "text/markdown": "section",
    "text/html": "section",
    "text/csv": "row_group",
    "application/json": "row_group",
    "application/xml": "row_group",
    "text/xml": "row_group",
    "application/pdf": "unit",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "paragraph",
    "application/vnd.openxmlformats-officedocument.presentationml.presentation": "unit",
    "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet": "row_group",
}
CHUNK_TEXTS = T.ArrayType(
    T.StructType([T.StructField("chunk_text", T.StringType()), T.StructField("chunk_header", T.StringType())])
)


@dataclass(frozen=True)
class ChunkConfig:
    strategy: str = "auto"
    size: int = 2000
    overlap: int = 200

    def __post_init__(self) -> None:
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown chunk strategy {self.strategy!r}")
        if self.strategy == "sliding_window" and self.overlap >= self.size:
            raise ValueError(f"overlap ({self.overlap}) must be less than chunk size ({self.size})")

    def override(self, strategy: str | None = None, size: int | None = None, overlap: int | None = None) -> ChunkConfig:
        """A collection's own settings over the server default, field by field."""
        return ChunkConfig(
            self.strategy if strategy is None else strategy,
            self.size if size is None else size,
            self.overlap if overlap is None else overlap,
        )


def resolved_strategy(config: ChunkConfig, mime: Column) -> Column:
    """NULL where "auto" does not know the MIME type."""
    if config.strategy != "auto":
        return F.lit(config.strategy)
    table = F.create_map(*[F.lit(x) for item in AUTO_STRATEGY.items() for x in item])
    return F.coalesce(F.try_element_at(table, mime), F.when(mime.startswith("text/"), "paragraph"))


def sliding_windows(units: Column, size: int, overlap: int) -> Column:
    """Fixed windows over the units joined by newlines, as an array of texts.

    Window ``j`` starts at ``j * step``.  When the text read so far ends exactly
    with a window, nothing is carried and the next unit starts afresh; the fold
    over unit lengths finds those cuts without touching the texts.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError(f"overlap ({overlap}) must be less than chunk size ({size})")
    texts = F.filter(F.transform(units, lambda u: trim_unicode(u["text"])), lambda t: t != "")
    windows = let(texts, lambda t: F.flatten(F.transform(_runs(t, size, overlap), lambda r: _windows(r, size, step))))
    return F.filter(F.transform(windows, trim_unicode), lambda w: w != "")


def _runs(texts: Column, size: int, overlap: int) -> Column:
    """The texts joined by newlines, cut where a window ended exactly with a text."""
    step = size - overlap
    start = F.struct(F.lit(0).alias("held"), F.lit(0).alias("seen"), F.array(F.lit(0)).alias("cuts"))

    def advance(acc: Column, length: Column) -> Column:
        total = F.when(acc["held"] > 0, acc["held"] + 1 + length).otherwise(length)
        beyond = total - size
        cut = (beyond >= 0) & (beyond % step == 0)
        held = F.when(cut, 0).when(beyond < 0, total).otherwise(beyond % step + F.lit(overlap))
        seen = acc["seen"] + 1
        return F.struct(
            held.cast("int").alias("held"),
            seen.alias("seen"),
            F.when(cut, F.concat(acc["cuts"], F.array(seen))).otherwise(acc["cuts"]).alias("cuts"),
        )

    cuts = F.aggregate(F.transform(texts, F.length), start, advance, lambda acc: acc["cuts"])
    edges = F.array_distinct(F.concat(cuts, F.array(F.size(texts))))
    return let(edges, lambda e: _between(texts, e))


def _between(texts: Column, edges: Column) -> Column:
    # Pair each edge with the next one; the last edge has no partner and drops out.
    following = F.slice(edges, 2, F.size(edges))
    pairs = F.zip_with(edges, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    spans = F.filter(pairs, lambda p: p["b"].isNotNull())
    return F.transform(spans, lambda p: F.array_join(F.slice(texts, p["a"] + 1, p["b"] - p["a"]), "\n"))


def _windows(text: Column, size: int, step: int) -> Column:
    """Cut once into pieces of ``step`` characters, then join neighbours: linear in the text."""
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % step), F.lit(0))
    span = -(-size // step)
    extra = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / step).cast("int")
    return let(
        pieces,
        lambda p: F.transform(
            F.sequence(F.lit(1), extra + 1), lambda j: F.substring(F.array_join(F.slice(p, j, span), ""), 1, size)
        ),
    )


def _stateful_chunks(config: ChunkConfig):
    size, overlap = config.size, config.overlap

    @F.arrow_udf(CHUNK_TEXTS)
    def chunk(texts: pa.Array, heads: pa.Array, sheets: pa.Array, strategy: pa.Array) -> pa.Array:
        told = np.array(["" if s is None else s for s in strategy.to_pylist()], object)
        told[~texts.is_valid().to_numpy(zero_copy_only=False)] = ""
        parts: list = [None] * len(told)
        for how, cut in (("row_group", _rows), ("paragraph", _paragraphs), ("per unit", _units)):
            mine = np.flatnonzero(np.isin(told, ["section", "unit"]) if how == "per unit" else told == how)
            if len(mine):
                chosen = pa.array(mine)
                pieces = cut(texts.take(chosen), heads.take(chosen), sheets.take(chosen), size, overlap)
                for i, own in zip(mine.tolist(), pieces):
                    parts[i] = own
        return pa.array(parts, to_arrow_type(CHUNK_TEXTS))

    # Keeps the optimizer from repeating the call in a pushed-down filter.
    return chunk.asNondeterministic()


def _flat(column: pa.ListArray) -> tuple[list, np.ndarray]:
    """The values of all lists, and where each list begins."""
    sizes = pc.list_value_length(column).fill_null(0).to_numpy()
    return column.flatten().to_pylist(), np.concatenate([[0], np.cumsum(sizes)])


def _dealt(texts: list[str], heads: list[str | None] | None, counts: np.ndarray) -> Iterator[list[dict]]:
    at = 0
    for n in counts.tolist():
        yield [{"chunk_text": texts[i], "chunk_header": heads[i] if heads else None} for i in range(at, at + n)]
        at += n


def _rows(texts, heads, sheets, size: int, overlap: int) -> Iterator[list[dict]]:
    (lines, first), (names, _), (tops, _) = _flat(texts), _flat(sheets), _flat(heads)
    pieces, counts = chunkers.row_chunks(lines, [s or "" for s in names], [h or "" for h in tops], first, size)
    return _dealt(pieces, None, counts)


def _without_empty(values: list[str], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the texts that are not empty, and where each list of them begins."""
    kept = np.array([bool(v) for v in values], bool)
    return np.flatnonzero(kept), np.concatenate([[0], np.cumsum(kept)])[first]


def _paragraphs(texts, heads, sheets, size: int, overlap: int) -> Iterator[list[dict]]:
    values, first = _flat(texts)
    kept, first = _without_empty(values, first)
    pieces, counts = chunkers.paragraph_chunks([values[i] for i in kept], first, size, overlap)
    return _dealt(pieces, None, counts)


def _units(texts, heads, sheets, size: int, overlap: int) -> Iterator[list[dict]]:
    (values, first), (crumbs, _) = _flat(texts), _flat(heads)
    kept, first = _without_empty(values, first)
    pieces, counts = chunkers.split_texts([values[i] for i in kept], size, overlap)
    tops = [crumbs[i] for i, n in zip(kept.tolist(), counts.tolist()) for _ in range(n)]
    running = np.concatenate([[0], np.cumsum(counts)])
    return _dealt(pieces, tops, np.diff(running[first]))


def _with_crumbs(units: Column) -> Column:
    """Put the display breadcrumb next to each heading so both paths share it."""

    def mark(u: Column) -> Column:
        heading = F.try_element_at(u["metadata"], F.lit("heading"))
        tags = F.when(
            F.coalesce(heading, F.lit("")) != "",
            F.map_concat(u["metadata"], F.create_map(F.lit("crumb"), breadcrumb(heading))),
        ).otherwise(u["metadata"])
        return F.struct(u["kind"].alias("kind"), u["text"].alias("text"), tags.alias("metadata"))

    return F.transform(units, mark)


def _whole_units(units: Column) -> Column:
    kept = F.filter(units, lambda u: trim_unicode(u["text"]) != "")
    return F.transform(
        kept,
        lambda u: F.struct(
            trim_unicode(u["text"]).alias("chunk_text"),
            F.try_element_at(u["metadata"], F.lit("crumb")).alias("chunk_header"),
        ),
    )


def chunk_documents(parsed: DataFrame, config: ChunkConfig, mime: str = "mime_type") -> DataFrame:
    """Replace ``units`` by ``chunks``: an array of (index, text, header).

    Sliding windows, and units that already fit, stay in the JVM; only documents
    that need a stateful rule go through the Arrow helper.
    """
    strategy = F.col("_strategy")
    size, overlap = config.size, config.overlap
    # A NULL array stands for "not this row" and skips the work of the branch.
    long_unit = F.exists("units", lambda u: F.length(trim_unicode(u["text"])) > size)
    per_unit = strategy.isin("section", "unit")
    needs_state = strategy.isin("paragraph", "row_group") | (per_unit & long_unit)

    staged = parsed.withColumn("_strategy", resolved_strategy(config, F.col(mime)))
    staged = staged.withColumn(
        "units", F.when(strategy == "section", _with_crumbs(F.col("units"))).otherwise(F.col("units"))
    )
    if config.strategy == "sliding_window":
        texts = sliding_windows(F.col("units"), size, overlap)
        pairs = F.transform(
            texts, lambda t: F.struct(t.alias("chunk_text"), F.lit(None).cast("string").alias("chunk_header"))
        )
    else:
        tag = lambda name: F.transform("units", lambda u: F.try_element_at(u["metadata"], F.lit(name)))
        texts = F.transform("units", lambda u: trim_unicode(F.coalesce(u["text"], F.lit(""))))
        heads = F.when(strategy == "row_group", tag("headers")).otherwise(tag("crumb"))
        columns = [F.when(needs_state, c) for c in (texts, heads, tag("sheet"))]
        staged = staged.withColumn("_state", _stateful_chunks(config)(*columns, strategy))
        pairs = F.when(needs_state, F.col("_state")).when(per_unit, _whole_units(F.col("units")))
    chunks = F.transform(
        pairs,
        lambda c, i: F.struct(
            i.cast("int").alias("chunk_index"),
            c["chunk_text"].alias("chunk_text"),
            c["chunk_header"].alias("chunk_header"),
        ),
    )
    error = F.coalesce(
        F.col("error"),
        F.when(strategy.isNull(), F.concat(F.lit("no chunk strategy for mime type "), F.col(mime))),
    )
    kept = [c for c in parsed.columns if c not in ("units", "error")]
    return staged.select(*kept, F.coalesce(chunks, F.array().cast(T.ArrayType(CHUNK))).alias("chunks"), error.alias("error"))


def explode_chunks(chunked: DataFrame, config: ChunkConfig, *keys: str) -> DataFrame:
    """One row per chunk with its fingerprint."""
    # The outer form: for the inner one Spark adds a size filter that computes the chunks twice.
    rows = chunked.select(*keys, F.explode_outer("chunks").alias("c")).where(F.col("c").isNotNull()).select(*keys, "c.*")
    return rows.withColumn("chunk_hash", chunk_fingerprint(config))


def chunk_fingerprint(config: ChunkConfig) -> Column:
    text = embedded_text(F.col("chunk_header"), F.col("chunk_text"))
    return fingerprint(text, config.strategy, config.size, config.overlap)
