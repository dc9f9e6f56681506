"""The registered queries of the training-data operators, each with its check SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat, decontam, language, neardup, pieces, quality, repeats, structure_queries, toxicity, urls, warc
from lodestone.llm.limits import bound_batches
from queries.common import Query


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf, "documents"))
    return judged.drop("host").withColumn("host_rate", F.round("host_rate", 6))


QUALITY_SQL = r"""
WITH split AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
tri AS (
  SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS t
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM split)),
twice AS (SELECT doc_id, k FROM tri QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
covered AS (SELECT doc_id, count(DISTINCT k + d) AS n FROM twice, (VALUES (0), (1), (2)) AS s(d) GROUP BY doc_id),
lines AS (
  SELECT doc_id, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM split)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dups AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY doc_id),
base AS (
  SELECT s.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(d.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM split s LEFT JOIN dups d USING (doc_id) LEFT JOIN covered c USING (doc_id)),
judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base),
hosts AS (
  SELECT source, count(*) AS n, sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS f
  FROM judged WHERE source IS NOT NULL GROUP BY source),
moments AS (SELECT avg(f / n) AS m, avg((f / n) * (f / n)) - avg(f / n) * avg(f / n) AS v FROM hosts),
prior AS (
  SELECT m, CASE WHEN v * 1e6 > m * (1 - m) THEN least(greatest(m * (1 - m) / v - 1, 1), 1e6) ELSE 1e6 END AS strength
  FROM moments),
rates AS (SELECT source, (f + m * strength) / (n + strength) AS rate FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       round(rate, 6) AS host_rate, NOT base_failed AND coalesce(rate <= 0.5, TRUE) AS kept
FROM judged LEFT JOIN rates USING (source)"""



def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf, "documents"), neardup.NearDupConfig(shingle=3, percent=85))


def suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.removed_spans(_table(spark, sf, "documents"))


def _number(text):
    """A number from a text that every engine computes alike."""
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("int")


def url_filters(spark: SparkSession, sf: str) -> DataFrame:
    """Every page against lists made from the pages' own sites: entries come, go and return over a year."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 7919 % 366).cast("int"))
    captures = _table(spark, sf, "pages").select("page_id", "url", day.alias("fetched_at"))
    host = urls.host_of(F.col("url"))
    site = F.regexp_replace(host, r"^(www|blog|m)\.", "")
    directory = F.concat(host, F.lit("/"), F.get(urls.segments_of(F.col("url")), F.lit(0)))
    sites = captures.select(site.alias("entry"), F.lit("site").alias("kind")).distinct()
    directories = captures.select(directory.alias("entry"), F.lit("directory").alias("kind")).distinct()
    named = sites.unionByName(directories).where("entry IS NOT NULL").withColumn("n", _number(F.col("entry").cast("binary")))
    after = lambda days: F.date_add(F.lit("2024-01-01").cast("date"), (F.col("n") % 200 + days).cast("int"))
    category = F.element_at(F.array(*map(F.lit, ("spam", "malware", "adult", "gambling"))), (F.col("n") % 4 + 1).cast("int"))
    site_rows = named.where("kind = 'site' AND n % 3 = 0")
    events = (
        site_rows.select("entry", after(0).alias("day"), F.lit("block").alias("action"), category.alias("category"))
        .unionByName(site_rows.where("n % 2 = 0").select("entry", after(60).alias("day"), F.lit("remove").alias("action"), category.alias("category")))
        .unionByName(site_rows.where("n % 5 < 2").select("entry", after(120).alias("day"), F.lit("block").alias("action"), category.alias("category")))
        .unionByName(
            named.where("kind = 'directory' AND n % 4 = 0").select("entry", after(30).alias("day"), F.lit("allow").alias("action"), F.lit("reviewed").alias("category"))
        )
    )
    judged = urls.judge(captures, events)
    dated = {c: F.col(c).cast("string") for c in ("fetched_at", "valid_from", "valid_to")}
    return judged.withColumns(dated).drop("url")


URL_SQL = r"""
WITH captures AS (
  SELECT page_id, CAST(DATE '2024-01-01' + CAST(page_id * 7919 % 366 AS INT) AS DATE) AS fetched_at,
         nullif(lower(regexp_extract(url, '^\w+://([^/?#:]*)', 1)), '') AS host,
         list_filter(string_split(regexp_extract(url, '^\w+://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '') AS seg FROM pages),
named AS (
  SELECT DISTINCT regexp_replace(host, '^(www|blog|m)\.', '') AS entry, 'site' AS kind FROM captures WHERE host IS NOT NULL
  UNION ALL
  SELECT DISTINCT host || '/' || seg[1], 'directory' FROM captures WHERE host IS NOT NULL AND len(seg) > 0),
numbered AS (SELECT *, CAST('0x' || substr(md5(entry), 1, 6) AS INT) AS n FROM named),
events AS (
  SELECT entry, kind, DATE '2024-01-01' + (n % 200 + d) AS day, action,
         CASE WHEN kind = 'site' THEN ['spam', 'malware', 'adult', 'gambling'][n % 4 + 1] ELSE 'reviewed' END AS category
  FROM numbered, (VALUES ('site', 0, 'block'), ('site', 60, 'remove'), ('site', 120, 'block'), ('directory', 30, 'allow')) AS e(k, d, action)
  WHERE kind = k AND CASE d WHEN 0 THEN n % 3 = 0 WHEN 60 THEN n % 3 = 0 AND n % 2 = 0
                            WHEN 120 THEN n % 3 = 0 AND n % 5 < 2 ELSE n % 4 = 0 END),
spans AS (
  SELECT *, lead(day) OVER (PARTITION BY entry ORDER BY day) AS until FROM events),
covering AS (
  SELECT page_id, entry, action, category, day, until,
         CASE kind WHEN 'directory' THEN 1000 ELSE len(string_split(entry, '.')) END AS rank
  FROM captures c JOIN spans s
    ON (s.kind = 'site' AND (c.host = s.entry OR ends_with(c.host, '.' || s.entry))
        OR s.kind = 'directory' AND s.entry = c.host || '/' || seg[1])
   AND s.day <= c.fetched_at AND (s.until IS NULL OR c.fetched_at < s.until) AND s.action <> 'remove'),
best AS (SELECT * FROM covering QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY rank DESC) = 1)
SELECT page_id, CAST(fetched_at AS VARCHAR) AS fetched_at, host,
       CASE WHEN host IS NULL THEN 'invalid' WHEN action = 'block' THEN 'blocked' WHEN action = 'allow' THEN 'allowed'
            ELSE 'unlisted' END AS verdict,
       entry, category, CAST(CAST(day AS DATE) AS VARCHAR) AS valid_from, CAST(CAST(until AS DATE) AS VARCHAR) AS valid_to
FROM captures LEFT JOIN best USING (page_id)"""


def benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"))
    return found.withColumn("item_ids", F.concat_ws(",", F.transform("item_ids", lambda i: i.cast("string"))))


# The rule without seeds: every shift of every item along every document.
DECONTAMINATION_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS dw FROM documents),
items AS (
  SELECT min(item_id) AS item, iw, len(iw) AS n, least(len(iw), 20) AS width FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS iw FROM benchmark)
  WHERE len(iw) >= 6 GROUP BY iw),
shifted AS (SELECT *, unnest(range(width - n, len(dw) - width + 1)) AS shift FROM docs, items),
aligned AS (
  SELECT *, greatest(0, -shift) AS a, least(n, len(dw) - shift) AS b,
         list_transform(range(greatest(0, -shift), least(n, len(dw) - shift)),
                        lambda k: CASE WHEN dw[k + shift + 1] = iw[k + 1] THEN 1 ELSE 0 END) AS same FROM shifted),
likely AS (
  SELECT doc_id, item, n, width, same, unnest(range(0, b - a - width + 1)) AS s FROM aligned
  WHERE list_sum(same) >= CASE WHEN n < 10 THEN width ELSE 0.8 * width END),
scored AS (SELECT doc_id, item, n, width, list_sum(same[s + 1:s + width]) AS matched FROM likely)
SELECT doc_id, TRUE AS contaminated, count(DISTINCT item) AS n_items,
       array_to_string(list_sort(list_distinct(list(item))), ',') AS item_ids, CAST(max(matched) AS BIGINT) AS matched_words
FROM scored WHERE matched >= CASE WHEN n < 10 THEN width ELSE 0.8 * width END GROUP BY doc_id"""

def chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS probe(conv_id, turn, role, text)"
    )
    return chat.conversation_digests(chat.format_conversations(turns.unionByName(probe)))


CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) AS p),
sized AS (
  SELECT *, length('<s>[INST]' || role || '[/INST]' || text || '</s>')
            + len(regexp_extract_all(role || chr(10) || text, '[<\[]\\*(?:/?s>|/?INST\])')) AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id"""

def warc_archives(spark: SparkSession, sf: str) -> DataFrame:
    target = warc.archive_folder(spark)
    manifest = warc.write_archives(_table(spark, sf, "pages"), target)
    return warc.read_archives(manifest, target).drop("url")


# Base32 from the digest's bits: 32 groups of five.
WARC_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
firsts AS (
  SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex, min(page_id) OVER (PARTITION BY html) AS first FROM payloads),
bits AS (
  SELECT *, array_to_string(list_transform(range(1, 41), lambda i:
            ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111']
            [strpos('0123456789abcdef', hex[i])]), '') AS b
  FROM firsts)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda g:
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST(16 * CAST(b[5 * g + 1] AS INT) + 8 * CAST(b[5 * g + 2] AS INT)
           + 4 * CAST(b[5 * g + 3] AS INT) + 2 * CAST(b[5 * g + 4] AS INT) + CAST(b[5 * g + 5] AS INT) AS INT)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM bits"""

def language_identification(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return language.predict(docs, language.train(docs))


def toxicity_scores(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf, "labels")))


PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def sentencepiece_codec(spark: SparkSession, sf: str, model: str = PIECE_MODEL) -> DataFrame:
    """Ids of every whole text, and whether decoding them gives the text back."""
    vocabulary = pieces.load_vocabulary(model)
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    encoded = pieces.encode(docs, vocabulary, checked="round_trip")
    return encoded.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", "round_trip")


def _bounded(run):
    """The query with small Arrow batches."""

    def call(spark: SparkSession, sf: str) -> DataFrame:
        bound_batches(spark)
        return run(spark, sf)

    call.__doc__ = run.__doc__
    return call


QUERIES: dict[str, Query] = {
    "op1_url_filters": Query(url_filters, URL_SQL),
    "op2_benchmark_decontamination": Query(benchmark_decontamination, DECONTAMINATION_SQL),
    "op3_language_identification": Query(language_identification),
    "op4_chat_formatting": Query(chat_formatting, CHAT_SQL),
    "op5_suffix_array_dedup": Query(suffix_array_dedup),
    "op6_warc_archives": Query(warc_archives, WARC_SQL),
    "op7_sentencepiece_codec": Query(sentencepiece_codec),
    "op8_quality_rules": Query(quality_rules, QUALITY_SQL),
    "op9_toxicity_scores": Query(toxicity_scores),
    "op10_near_duplicates": Query(near_duplicates),
    **structure_queries.QUERIES,
}

QUERIES = {name: Query(_bounded(query.run), query.sql) for name, query in QUERIES.items()}
