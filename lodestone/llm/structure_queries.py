"""The registered queries of the prefix trie, the dataset manifest and the language model, with their check SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import merkle, ngrams, trie
from queries.common import Query

# CRC-32 by table: entry i is i after eight steps of the polynomial.
CRC_TABLE_SQL = """crc_table AS (
  SELECT list(v ORDER BY i) AS crc_t FROM (
    SELECT i, list_reduce(list_prepend(i, range(8)), lambda a, b: xor(a >> 1, (a & 1) * 3988292384)) AS v FROM range(256) AS r(i)))"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text, next to ``crc_table``."""
    return f"""xor(list_reduce(list_prepend(4294967295,
      list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(({text})[i]) AS BIGINT))),
      lambda a, b: xor(a >> 8, crc_t[(xor(a, b) & 255) + 1])), 4294967295)"""


def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    made = merkle.versions(docs, merkle.marked_for_tampering(F.col("doc_id")), merkle.lower_cased(F.col("text")))
    return made.drop("copies")


_LEAF_SQL = "sha256(" + " || ".join(
    f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"
_LOWER_SQL = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _levels_sql(name: str, start: str) -> str:
    """Levels of runs of 16 over ``start (tree, pos, d)``, and what stands beside every node."""
    side = "coalesce(string_agg(d, '') OVER (PARTITION BY tree, level, pos // 16 ORDER BY pos ROWS BETWEEN {}), '')"
    return f"""{name} AS (
  SELECT tree, 0 AS level, pos, d, count(*) OVER (PARTITION BY tree) AS n FROM {start}
  UNION ALL
  SELECT tree, level + 1, pos // 16, sha256(string_agg(d, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 16),
{name}_sides AS (
  SELECT tree, level, pos, {side.format('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS l,
         {side.format('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS r FROM {name} WHERE n > 1)"""


def _fold_sql(name: str, levels: str, start: str) -> str:
    """Every row of ``start (rid, tree, pos, cur, proof)`` on its way to the top of its tree."""
    return f"""{name}_way AS (
  SELECT rid, tree, 0 AS level, pos, cur, proof FROM {start}
  UNION ALL
  SELECT rid, tree, level + 1, pos // 16, sha256(l || cur || r), proof || l || r
  FROM {name}_way JOIN {levels}_sides USING (tree, level, pos)),
{name} AS (SELECT w.*, t.d AS top FROM {name}_way w JOIN (SELECT tree, level, d FROM {levels} WHERE n = 1) t USING (tree, level))"""


MERKLE_SQL = f"""
WITH RECURSIVE {CRC_TABLE_SQL},
leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, source, {_LEAF_SQL.format(text='text')} AS d,
         CASE WHEN {crc32_sql('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {_LEAF_SQL.format(text=_LOWER_SQL)} END AS tampered
  FROM documents, crc_table),
trees AS (SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS tree FROM (SELECT DISTINCT source FROM leaves)),
nodes AS (
  SELECT l.*, t.tree, row_number() OVER (PARTITION BY t.tree ORDER BY doc_id NULLS FIRST, d) - 1 AS pos
  FROM leaves l JOIN trees t ON l.source IS NOT DISTINCT FROM t.source),
{_levels_sql('lower_levels', 'nodes')},
subroots AS (SELECT 0 AS tree, tree AS pos, d FROM lower_levels WHERE n = 1),
{_levels_sql('upper_levels', 'subroots')},
starts AS (SELECT rid, tree, pos, coalesce(tampered, d) AS cur, '' AS proof FROM nodes),
{_fold_sql('lower_fold', 'lower_levels', 'starts')},
turned AS (SELECT rid, 0 AS tree, tree AS pos, cur, proof FROM lower_fold),
{_fold_sql('upper_fold', 'upper_levels', 'turned')}
SELECT n.doc_id, n.d AS leaf, lf.top AS subroot, uf.top AS root, sha256(uf.proof) AS proof_sha256,
       uf.cur AS folded_root, uf.cur = uf.top AS verified
FROM nodes n JOIN lower_fold lf USING (rid) JOIN upper_fold uf USING (rid)"""


def prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    return trie.prefix_trie(turns, trie.prefix_of_first_in_five)


# Subtrees by the prefixes of each node's smallest member.
TRIE_SQL = f"""
WITH {CRC_TABLE_SQL},
turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS said,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
counted AS (SELECT conv_id, conv_id - conv_id % 5 AS head, count(*) AS n FROM turns GROUP BY conv_id),
convs AS (SELECT *, {crc32_sql('CAST(conv_id AS VARCHAR)')} % 9 AS h FROM counted, crc_table),
rebuilt AS (
  SELECT c.conv_id, t.i AS depth, role, said FROM convs c JOIN turns t ON t.conv_id = c.head AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(f.n, 0)) + t.i - c.h, role, said
  FROM convs c LEFT JOIN convs f ON f.conv_id = c.head JOIN turns t ON t.conv_id = c.conv_id AND t.i > c.h),
listed AS (
  SELECT c.conv_id, coalesce(list(sha256(strlen(role) || ':' || role || said) ORDER BY depth) FILTER (WHERE depth > 0), []) AS keys,
         coalesce(list(strlen(said) ORDER BY depth) FILTER (WHERE depth > 0), []) AS sizes
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (
  SELECT conv_id, d, keys[1:d] AS pre, keys[1:d - 1] AS above, CASE WHEN d > 0 THEN sizes[d] ELSE 0 END AS size, d = len(keys) AS ends
  FROM (SELECT *, unnest(range(0, len(keys) + 1)) AS d FROM listed)),
nodes AS (
  SELECT d, pre, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(size) AS size,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM prefixes GROUP BY d, pre),
children AS (SELECT d - 1 AS d, above AS pre, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
own AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children, (n_convs - 1) * size AS saved
  FROM nodes n LEFT JOIN children c ON n.d = c.d AND n.pre = c.pre),
sums AS (
  SELECT a.d, a.pre, count(*) FILTER (WHERE o.n_children = 0) AS n_leaves, CAST(sum(o.saved) AS BIGINT) AS saved_tokens
  FROM own o JOIN prefixes a ON a.conv_id = o.conv_id AND a.d <= o.d GROUP BY a.d, a.pre)
SELECT o.conv_id, CAST(o.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, o.n_convs, o.n_children, n_leaves, saved_tokens, o.ends_sha256
FROM own o JOIN sums s ON o.d = s.d AND o.pre = s.pre LEFT JOIN nodes p ON o.d > 0 AND p.d = o.d - 1 AND p.pre = o.above"""


def language_model(spark: SparkSession, sf: str) -> DataFrame:
    unseen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    scores = ngrams.language_model_scores(spark.read.parquet(f"{sf}/documents.parquet"), unseen)
    return scores.withColumnRenamed("unseen", "held_out")


QUERIES: dict[str, Query] = {
    "op11_prefix_trie": Query(prefix_trie, TRIE_SQL),
    "op12_merkle_manifest": Query(merkle_manifest, MERKLE_SQL),
    "op13_language_model": Query(language_model),
}
