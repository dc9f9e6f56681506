"""Readers, chunk strategies, fingerprints, embeddings and incremental ingest."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.text import fingerprint
from lodestone.operators.chunking import ChunkConfig, chunk_documents, explode_chunks
from lodestone.operators.embedding import HashEmbedder, embed_column
from lodestone.operators.parsing import explode_units, parse_documents
from lodestone.operators.skew import spread
from lodestone.operators.reuse import reuse_counts, stale_chunks, to_embed
from lodestone.sources.adapters import files, table, web_pages
from queries.common import Query

OFFICE = "application/vnd.openxmlformats-officedocument."
DOCX, PPTX, XLSX = (OFFICE + s for s in ("wordprocessingml.document", "presentationml.presentation", "spreadsheetml.sheet"))


def as_files(rows: DataFrame, key: str, mime: str, content: Column, grouped: bool = False) -> DataFrame:
    """``grouped`` rows come out of a shuffle and are dealt already; to count their splits would run it."""
    return (rows if grouped else spread(rows, key)).select(
        F.col(key).cast("string").alias("document_id"), F.lit(mime).alias("mime_type"), content.cast("binary").alias("content")
    )


def units(source: DataFrame) -> DataFrame:
    return explode_units(parse_documents(source), "document_id").select(
        "document_id", F.col("unit_index").cast("bigint").alias("unit_index"), "text", "metadata"
    )


def chunks(source: DataFrame, config: ChunkConfig) -> DataFrame:
    return explode_chunks(chunk_documents(parse_documents(source), config), config, "document_id").select(
        "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk_text", "chunk_header", "chunk_hash"
    )


# --- inputs in each format, written from the given tables -------------------


def csv_files(spark, sf) -> DataFrame:
    line = F.concat(F.lit("key,priority\n"), F.col("o_orderkey"), F.lit(', "'), F.col("o_orderpriority"), F.lit('"\n'))
    return as_files(table(spark, sf, "orders"), "o_orderkey", "text/csv", line)


def json_files(spark, sf) -> DataFrame:
    return as_files(table(spark, sf, "events"), "event_id", "application/json", F.col("props"))


def xml_files(spark, sf) -> DataFrame:
    body = F.concat(
        F.lit("<list><customer><name>"), F.col("c_name"), F.lit("</name><at><segment>"), F.col("c_mktsegment"),
        F.lit("</segment></at></customer></list>"),
    )
    return as_files(table(spark, sf, "customer"), "c_custkey", "application/xml", body)


def markdown_files(spark, sf) -> DataFrame:
    body = F.concat(F.lit("# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"), F.col("text"))
    return as_files(table(spark, sf, "documents"), "doc_id", "text/markdown", body)


def pdf_markup_files(spark, sf) -> DataFrame:
    """Each line of a document as a paragraph of ``pdftohtml`` output."""
    safe = F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    body = F.regexp_replace(safe, "\n", "<br/>\n&#160;<br/>\n")
    return as_files(table(spark, sf, "documents"), "doc_id", "application/pdf", body)


def _zip(members: dict[str, str]) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return buffer.getvalue()


@F.arrow_udf(T.BinaryType())
def docx_bytes(text: pa.Array) -> pa.Array:
    def build(t: str) -> bytes:
        ps = "".join(f"<w:p><w:r><w:t>{escape(line)}</w:t></w:r></w:p>" for line in t.split("\n"))
        return _zip({"word/document.xml": f'<w:document xmlns:w="w"><w:body>{ps}</w:body></w:document>'})

    return pa.array([build(t.as_py()) for t in text], pa.binary())


@F.arrow_udf(T.BinaryType())
def pptx_bytes(text: pa.Array) -> pa.Array:
    def build(t: str) -> bytes:
        slide = '<p:sld xmlns:p="p" xmlns:a="a"><a:p><a:t>{}</a:t></a:p></p:sld>'
        return _zip({f"ppt/slides/slide{i:04d}.xml": slide.format(escape(x)) for i, x in enumerate(t.split("\n"), 1)})

    return pa.array([build(t.as_py()) for t in text], pa.binary())


@F.arrow_udf(T.BinaryType())
def xlsx_bytes(name: pa.Array, segment: pa.Array) -> pa.Array:
    def build(n: str, s: str) -> bytes:
        shared = "<sst><si><t>name</t></si><si><t>segment</t></si></sst>"
        sheet = (
            "<w><row><c t='s'><v>0</v></c><c t='s'><v>1</v></c></row>"
            f"<row><c t='inlineStr'><is><t>{escape(n)}</t></is></c><c t='str'><v>{escape(s)}</v></c></row></w>"
        )
        return _zip({"xl/sharedStrings.xml": shared, "xl/worksheets/sheet1.xml": sheet})

    return pa.array([build(n.as_py(), s.as_py()) for n, s in zip(name, segment)], pa.binary())


def turns(spark, sf) -> DataFrame:
    return table(spark, sf, "conversations").withColumn("key", F.concat_ws("-", "conv_id", "turn"))


def docx_files(spark, sf) -> DataFrame:
    return as_files(turns(spark, sf), "key", DOCX, docx_bytes("text"))


def pptx_files(spark, sf) -> DataFrame:
    return as_files(turns(spark, sf), "key", PPTX, pptx_bytes("text"))


def xlsx_files(spark, sf) -> DataFrame:
    return as_files(table(spark, sf, "customer"), "c_custkey", XLSX, xlsx_bytes("c_name", "c_mktsegment"))


# --- queries ----------------------------------------------------------------

WINDOWS = ChunkConfig("sliding_window", 500, 50)


def _tagged(source: DataFrame, *tags: str) -> DataFrame:
    rows = units(source)
    return rows.select("document_id", "unit_index", "text", *[F.col("metadata")[t].alias(t) for t in tags])


def _html_units(spark, sf) -> DataFrame:
    rows = units(web_pages(spark, sf))
    return rows.select("document_id", "unit_index", F.col("metadata")["heading"].alias("heading"), "text")


def _fingerprints(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", fingerprint(F.col("text"), "auto", 2000, 200).alias("chunk_hash"))


def _hash_embedding(spark, sf) -> DataFrame:
    docs = table(spark, sf, "benchmark").select("item_id", embed_column(F.col("text"), HashEmbedder(64)).alias("e"))
    cells = docs.select("item_id", F.posexplode("e.vector").alias("dim", "weight")).where("weight > 0")
    return cells.select("item_id", F.col("dim").cast("bigint").alias("dim"), F.col("weight").cast("bigint").alias("weight"))


def _versions(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Stored chunks of all documents, and a re-parse after the German ones grew."""
    before = files(spark, sf)
    grown = F.when(F.col("lang") == "de", F.concat("text", F.lit(" Nachtrag"))).otherwise(F.col("text"))
    docs = table(spark, sf, "documents").withColumn("text", grown)
    after = as_files(docs, "doc_id", "text/plain", F.col("text"))
    return chunks(before, WINDOWS), chunks(after, WINDOWS)


def _reuse(spark, sf) -> DataFrame:
    stored, fresh = _versions(spark, sf)
    return reuse_counts(fresh, stored)


def _to_embed(spark, sf) -> DataFrame:
    stored, fresh = _versions(spark, sf)
    return to_embed(fresh, stored).select("document_id", "chunk_index", "chunk_hash")


def _stale(spark, sf) -> DataFrame:
    stored, fresh = _versions(spark, sf)
    return stale_chunks(stored, fresh).select("document_id", "chunk_index", "chunk_hash")


WS = r"[\t\n\v\f\r \x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim_sql(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def units_sql(table_name: str, key: str, text: str, separator: str = "\\n\\n+") -> str:
    return f"""units AS (
      SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS unit_index, text FROM (
        SELECT CAST({key} AS VARCHAR) AS document_id, unnest(range(len(parts))) AS i, {trim_sql('unnest(parts)')} AS text
        FROM (SELECT *, regexp_split_to_array({text}, '{separator}') AS parts FROM {table_name}))
      WHERE text <> '')"""


UNIT_OUT = " SELECT document_id, CAST(unit_index AS BIGINT) AS unit_index, text"


def windows_sql(name: str, text: str) -> str:
    """Windows of 500 every 450 over each whole text."""
    return f"""{name} AS (
      SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY j) - 1 AS chunk_index, chunk_text,
             sha256('1|sliding_window|500|50|' || chunk_text) AS chunk_hash
      FROM (SELECT document_id, j, {trim_sql('substring(text, CAST(j * 450 + 1 AS BIGINT), 500)')} AS chunk_text
            FROM (SELECT document_id, text, unnest(range(CAST(greatest(ceil((length(text) - 500) / 450.0), 0) AS BIGINT) + 1)) AS j
                  FROM (SELECT CAST(doc_id AS VARCHAR) AS document_id, {trim_sql(text)} AS text FROM documents)))
      WHERE chunk_text <> '')"""


BLANKS = r"[ \n\t]"


def split_sql(source: str, size: int, overlap: int) -> str:
    """``pieces`` of ``source(document_id, unit_index, text)``: each text followed window by window.

    A window ends behind its last blank, if it has one; the next starts
    ``overlap`` earlier, past blanks, and always moves on.
    """
    last_blank = f"length(regexp_extract(substring(text, s + 1, {size}), '^(?s:.*){BLANKS}'))"
    stop = f"CASE WHEN s + {size} >= length(text) THEN length(text) ELSE s + coalesce(nullif({last_blank}, 0), {size}) END"
    back = f"greatest(e - {overlap}, 0)"
    resume = f"greatest({back} + length(regexp_extract(substring(text, {back} + 1), '^{BLANKS}*')), s + 1)"
    return f"""spans(document_id, unit_index, text, s, e) AS (
      SELECT document_id, unit_index, text, s, {stop} FROM (SELECT *, CAST(0 AS BIGINT) AS s FROM {source})
      UNION ALL
      SELECT document_id, unit_index, text, s, {stop} FROM (
        SELECT document_id, unit_index, text, {resume} AS s FROM spans WHERE e < length(text))
      WHERE s < length(text)),
    pieces AS (
      SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY unit_index, s) - 1 AS chunk_index, chunk_text
      FROM (SELECT *, {trim_sql('substring(text, s + 1, e - s)')} AS chunk_text FROM spans) WHERE chunk_text <> '')"""


def packed_sql(size: int, overlap: int) -> str:
    """``packs``: whole paragraphs up to ``size``, the tail that covers ``overlap`` carried on."""
    cut = f"coalesce(list_filter(range(lo, n), lambda t: ends[t + 2] - ends[s + 1] > {size})[1], n)"
    carry = f"coalesce(list_max(list_filter(range(s, c), lambda x: ends[c + 1] - ends[x + 1] >= {overlap})), s)"
    return f"""paragraphs AS (
      SELECT document_id, list(text ORDER BY unit_index) AS texts, CAST(count(*) AS BIGINT) AS n FROM units GROUP BY 1),
    sized AS (
      SELECT *, list_transform(range(n + 1),
                               lambda i: coalesce(list_sum(list_transform(texts[1:i], lambda t: length(t) + 1)), 0)) AS ends
      FROM paragraphs),
    turns(document_id, texts, ends, n, s, c) AS (
      SELECT document_id, texts, ends, n, s, {cut} FROM (SELECT *, CAST(0 AS BIGINT) AS s, CAST(1 AS BIGINT) AS lo FROM sized)
      UNION ALL
      SELECT document_id, texts, ends, n, s, {cut} FROM (
        SELECT document_id, texts, ends, n, {carry} AS s, c + 1 AS lo FROM turns WHERE c < n)),
    packs AS (SELECT document_id, c AS unit_index, array_to_string(texts[s + 1:c], chr(10)) AS text FROM turns)"""


def chunks_out(config: str, header: str = "CAST(NULL AS VARCHAR)", source: str = "pieces") -> str:
    return f""" SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_text, {header} AS chunk_header,
      sha256('1|{config}|' || concat_ws(chr(10), {header}, chunk_text)) AS chunk_hash FROM {source}"""


VERSIONS_SQL = "WITH " + windows_sql("stored", "text") + ",\n" + windows_sql(
    "fresh", "CASE WHEN lang = 'de' THEN text || ' Nachtrag' ELSE text END"
)

# FNV-1a over the UTF-8 bytes of each distinct lower-cased word.
EMBED_SQL = """WITH words AS (
    SELECT item_id, unnest(list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w <> '')) AS word FROM benchmark),
  hashed AS (
    SELECT word, list_reduce(
      list_prepend(CAST(2166136261 AS BIGINT),
        list_transform(range(1, CAST(length(hex(encode(word))) AS BIGINT), 2),
                       lambda i: CAST('0x' || substring(hex(encode(word)), i, 2) AS BIGINT))),
      lambda h, b: (xor(h, b) * 16777619) % 4294967296) AS h
    FROM (SELECT DISTINCT word FROM words))
SELECT item_id, CAST(h % 64 AS BIGINT) AS dim, CAST(count(*) AS BIGINT) AS weight
FROM words JOIN hashed USING (word) GROUP BY 1, 2"""

QUERIES = {
    "parse_text": Query(
        lambda spark, sf: units(files(spark, sf)).drop("metadata"),
        "WITH " + units_sql("documents", "doc_id", "text") + UNIT_OUT + " FROM units",
    ),
    "parse_markdown": Query(
        lambda spark, sf: _tagged(markdown_files(spark, sf), "heading"),
        "WITH " + units_sql("documents", "doc_id", "text", r"\x00")
        + " SELECT document_id, CAST(unit_index AS BIGINT) AS unit_index, units.text AS text, '# ' || source || chr(10) || '## ' || lang AS heading"
        " FROM units JOIN documents ON CAST(doc_id AS VARCHAR) = document_id",
    ),
    "parse_html": Query(_html_units),
    "parse_csv": Query(
        lambda spark, sf: _tagged(csv_files(spark, sf), "headers", "sheet"),
        """SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(0 AS BIGINT) AS unit_index,
                  o_orderkey || chr(9) || o_orderpriority AS text, 'key' || chr(9) || 'priority' AS headers, 'csv' AS sheet
           FROM orders""",
    ),
    "parse_json": Query(
        lambda spark, sf: units(json_files(spark, sf)).drop("metadata"),
        """SELECT CAST(event_id AS VARCHAR) AS document_id, CAST(0 AS BIGINT) AS unit_index,
                  'k: ' || json_extract_string(props, '$.k') AS text FROM events""",
    ),
    "parse_xml": Query(
        lambda spark, sf: _tagged(xml_files(spark, sf), "element"),
        """SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(0 AS BIGINT) AS unit_index,
                  'name: ' || c_name || chr(10) || 'at.segment: ' || c_mktsegment AS text, 'customer' AS element FROM customer""",
    ),
    "parse_pdf_markup": Query(
        lambda spark, sf: units(pdf_markup_files(spark, sf)).drop("metadata"),
        "WITH " + units_sql("documents", "doc_id", "text", r"\n") + UNIT_OUT + " FROM units",
    ),
    "parse_docx": Query(
        lambda spark, sf: units(docx_files(spark, sf)).drop("metadata"),
        "WITH " + units_sql("conversations", "conv_id || '-' || turn", "text", r"\n") + UNIT_OUT + " FROM units",
    ),
    "parse_pptx": Query(
        lambda spark, sf: _tagged(pptx_files(spark, sf), "slide"),
        "WITH u AS (SELECT conv_id || '-' || turn AS document_id, unnest(range(len(parts))) AS i,"
        f" {trim_sql('unnest(parts)')} AS text FROM (SELECT *, string_split(text, chr(10)) AS parts FROM conversations))"
        " SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY i) - 1 AS BIGINT) AS unit_index,"
        " text, CAST(i + 1 AS VARCHAR) AS slide FROM u WHERE text <> ''",
    ),
    "parse_xlsx": Query(
        lambda spark, sf: _tagged(xlsx_files(spark, sf), "headers", "sheet"),
        """SELECT CAST(c_custkey AS VARCHAR) AS document_id, CAST(0 AS BIGINT) AS unit_index,
                  c_name || chr(9) || c_mktsegment AS text, 'name' || chr(9) || 'segment' AS headers, 'sheet1' AS sheet
           FROM customer""",
    ),
    "chunk_sliding_window": Query(
        lambda spark, sf: chunks(files(spark, sf), WINDOWS).select("document_id", "chunk_index", "chunk_text", "chunk_hash"),
        "WITH " + windows_sql("c", "text")
        + " SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_text, chunk_hash FROM c",
    ),
    "chunk_paragraph": Query(
        lambda spark, sf: chunks(pdf_markup_files(spark, sf), ChunkConfig("paragraph", 500, 50)),
        "WITH RECURSIVE " + ", ".join(
            [units_sql("documents", "doc_id", "text", r"\n"), packed_sql(500, 50), split_sql("packs", 500, 50)]
        ) + chunks_out("paragraph|500|50"),
    ),
    "chunk_section": Query(
        lambda spark, sf: chunks(markdown_files(spark, sf), ChunkConfig("auto", 500, 50)),
        "WITH RECURSIVE " + units_sql("documents", "doc_id", "text", r"\x00") + ", " + split_sql("units", 500, 50)
        + chunks_out("auto|500|50", "(source || ' > ' || lang)",
                     "pieces JOIN (SELECT CAST(doc_id AS VARCHAR) AS document_id, source, lang FROM documents) USING (document_id)"),
    ),
    "chunk_unit": Query(
        lambda spark, sf: chunks(pdf_markup_files(spark, sf), ChunkConfig("auto", 300, 40)),
        "WITH RECURSIVE " + units_sql("documents", "doc_id", "text", r"\n") + ", " + split_sql("units", 300, 40)
        + chunks_out("auto|300|40"),
    ),
    "chunk_html": Query(lambda spark, sf: chunks(web_pages(spark, sf), ChunkConfig())),
    "chunk_row_group": Query(
        lambda spark, sf: chunks(csv_files(spark, sf), ChunkConfig("auto", 500, 50)).drop("chunk_header"),
        """SELECT *, sha256('1|auto|500|50|' || chunk_text) AS chunk_hash FROM (
             SELECT CAST(o_orderkey AS VARCHAR) AS document_id, CAST(0 AS BIGINT) AS chunk_index,
                    'key' || chr(9) || 'priority' || chr(10) || o_orderkey || chr(9) || o_orderpriority AS chunk_text FROM orders)""",
    ),
    "fingerprint": Query(
        _fingerprints, "SELECT doc_id, sha256('1|auto|2000|200|' || text) AS chunk_hash FROM documents"
    ),
    "hash_embedding": Query(_hash_embedding, EMBED_SQL),
    "chunk_reuse": Query(
        _reuse,
        VERSIONS_SQL
        + """, m AS (SELECT f.document_id, count(*) AS chunk_count, count(s.chunk_hash) AS reused_chunks FROM fresh f
             LEFT JOIN (SELECT DISTINCT document_id, chunk_hash FROM stored) s USING (document_id, chunk_hash) GROUP BY 1)
           SELECT m.document_id, CAST(chunk_count AS BIGINT) AS chunk_count, CAST(reused_chunks AS BIGINT) AS reused_chunks,
                  CAST(greatest(coalesce(p, 0) - reused_chunks, 0) AS BIGINT) AS stale_chunks
           FROM m LEFT JOIN (SELECT document_id, count(*) AS p FROM stored GROUP BY 1) b USING (document_id)""",
    ),
    "chunks_to_embed": Query(
        _to_embed,
        VERSIONS_SQL
        + """ SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_hash FROM fresh
           ANTI JOIN stored USING (document_id, chunk_hash)""",
    ),
    "stale_chunks": Query(
        _stale,
        VERSIONS_SQL
        + """ SELECT document_id, CAST(chunk_index AS BIGINT) AS chunk_index, chunk_hash FROM stored
           ANTI JOIN fresh USING (document_id, chunk_hash)""",
    ),
}
