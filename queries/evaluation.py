"""Retrieval quality over labelled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_group
from lodestone.plans import evaluation as plan
from lodestone.sources.adapters import table
from queries.common import Query, rounded

DEPTH = 100


def ranked(spark, sf) -> DataFrame:
    """Per source, its documents by length: 100 deep, as a search would return them."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id", "n_chars")
    return top_per_group(docs, ["query_id"], [F.col("n_chars").desc(), F.col("doc_id")], DEPTH).drop("n_chars")


def judged(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents").select(F.col("source").alias("query_id"), "doc_id")
    return docs.join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("relevance")), "doc_id")


def _per_query(spark, sf) -> DataFrame:
    r, j = ranked(spark, sf), judged(spark, sf)
    return plan.ndcg(r, j, 10).join(plan.recall(r, j, DEPTH), "query_id")


def _aggregate(spark, sf) -> DataFrame:
    means = plan.aggregate(_per_query(spark, sf), "ndcg", "recall")
    return rounded(means, 6, "value")


def _delta(spark, sf) -> DataFrame:
    """The aggregate at depth 10 against the one at depth 5."""
    r, j = ranked(spark, sf), judged(spark, sf)
    now = plan.aggregate(plan.ndcg(r, j, 10), "ndcg")
    before = plan.aggregate(plan.ndcg(r, j, 5), "ndcg")
    return rounded(plan.against_baseline(now, before), 6, "value", "baseline", "delta")


def _deduplicated(spark, sf) -> DataFrame:
    items = table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("query_id"),
        F.col("l_partkey").alias("doc_id"),
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("rank"),
    )
    return plan.first_per_document(items).withColumn("rank", F.col("rank").cast("bigint"))


CTE = f"""WITH ranked AS (
  SELECT source AS query_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank
  FROM documents QUALIFY rank < {DEPTH}),
judged AS (SELECT source AS query_id, doc_id, quality AS relevance FROM documents JOIN labels USING (doc_id)),
"""


def ndcg_sql(name: str, k: int) -> str:
    return f"""{name} AS (
  SELECT i.query_id, CASE WHEN idcg > 0 THEN coalesce(dcg, 0) / idcg ELSE 0e0 END AS ndcg FROM (
    SELECT query_id, sum(relevance / log2(r + 2)) AS idcg FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY relevance DESC) - 1 AS r FROM judged QUALIFY r < {k})
    GROUP BY query_id) i
  LEFT JOIN (SELECT r.query_id, sum(coalesce(relevance, 0) / log2(rank + 2)) AS dcg
             FROM ranked r LEFT JOIN judged j ON j.query_id = r.query_id AND j.doc_id = r.doc_id
             WHERE rank < {k} GROUP BY r.query_id) d USING (query_id))"""


RECALL = """recalls AS (
  SELECT j.query_id, CASE WHEN count(*) FILTER (WHERE relevance > 0) > 0 THEN
           count(*) FILTER (WHERE relevance > 0 AND r.doc_id IS NOT NULL) / count(*) FILTER (WHERE relevance > 0) END AS recall
  FROM judged j LEFT JOIN ranked r ON r.query_id = j.query_id AND r.doc_id = j.doc_id GROUP BY j.query_id)"""

QUERIES = {
    "ndcg_recall": Query(
        lambda spark, sf: rounded(_per_query(spark, sf), 6, "ndcg", "recall"),
        CTE + ndcg_sql("gains", 10) + ", " + RECALL
        + " SELECT query_id, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall FROM gains JOIN recalls USING (query_id)",
    ),
    "metric_means": Query(
        _aggregate,
        CTE + ndcg_sql("gains", 10) + ", " + RECALL
        + """ SELECT 'ndcg' AS metric, round(avg(ndcg), 6) AS value FROM gains
              UNION ALL SELECT 'recall', round(avg(recall), 6) FROM recalls""",
    ),
    "metric_delta": Query(
        _delta,
        CTE + ndcg_sql("g10", 10) + ", " + ndcg_sql("g5", 5)
        + """ SELECT 'ndcg' AS metric, round(a, 6) AS value, round(b, 6) AS baseline, round(a - b, 6) AS delta
              FROM (SELECT avg(ndcg) AS a FROM g10), (SELECT avg(ndcg) AS b FROM g5)""",
    ),
    "rank_deduplication": Query(
        _deduplicated,
        """SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY best, doc_id) - 1 AS BIGINT) AS rank FROM (
             SELECT l_suppkey AS query_id, l_partkey AS doc_id, min(l_orderkey * 10 + l_linenumber) AS best
             FROM lineitem GROUP BY 1, 2)""",
    ),
}
