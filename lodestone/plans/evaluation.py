"""Retrieval quality: ranked lists against graded judgements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.operators.ranking import top_per_group

# USD per token of the judge model, (input, output).
JUDGE_RATES = {"gpt-4o-mini": (0.15 / 1_000_000, 0.60 / 1_000_000)}


def first_per_document(ranked: DataFrame, query: str = "query_id", doc: str = "doc_id", rank: str = "rank") -> DataFrame:
    """Keep a document's best position and renumber from 0.

    The best position is a combinable minimum, so only distinct documents are
    sorted; a list is as long as a request's ``top_k``.
    """
    best = ranked.groupBy(query, doc).agg(F.min(rank).alias("_best"))
    order = Window.partitionBy(query).orderBy("_best", doc)
    return best.withColumn(rank, F.row_number().over(order) - 1).drop("_best")


def _discounted(relevance: Column, rank: Column) -> Column:
    return relevance / F.log2(rank + F.lit(2.0))


def ndcg(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """nDCG@k per judged query.

    ``ranked(query_id, doc_id, rank)`` and ``judged(query_id, doc_id,
    relevance)``.  A query without a relevant document, or without results,
    scores 0.
    """
    gains = (
        ranked.where(F.col("rank") < k)
        .join(judged, ["query_id", "doc_id"], "left")
        .groupBy("query_id")
        .agg(F.sum(_discounted(F.coalesce("relevance", F.lit(0)), F.col("rank"))).alias("dcg"))
    )
    ideal = (
        top_per_group(judged, ["query_id"], [F.col("relevance").desc(), F.col("doc_id")], k, "_r")
        .groupBy("query_id")
        .agg(F.sum(_discounted(F.col("relevance"), F.col("_r"))).alias("idcg"))
    )
    share = F.when(F.col("idcg") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("idcg")).otherwise(F.lit(0.0))
    return ideal.join(gains, "query_id", "left").select("query_id", share.alias("ndcg"))


def recall(ranked: DataFrame, judged: DataFrame, k: int) -> DataFrame:
    """Recall@k per judged query; NULL where nothing is relevant."""
    found = ranked.where(F.col("rank") < k).select("query_id", "doc_id").distinct().withColumn("_hit", F.lit(1))
    relevant = judged.join(found, ["query_id", "doc_id"], "left")
    wanted = F.count_if(F.col("relevance") > 0)
    hits = F.count_if((F.col("relevance") > 0) & F.col("_hit").isNotNull())
    return relevant.groupBy("query_id").agg(F.when(wanted > 0, hits / wanted).alias("recall"))


def aggregate(per_query: DataFrame, *metrics: str) -> DataFrame:
    """``(metric, value)``: means over the queries that have a value."""
    means = per_query.agg(*[F.avg(F.nanvl(F.col(m), F.lit(None).cast("double"))).alias(m) for m in metrics])
    return means.unpivot([], list(metrics), "metric", "value")


def against_baseline(aggregates: DataFrame, baseline: DataFrame) -> DataFrame:
    """Add the stored value and the difference; NULL where there is no baseline."""
    before = baseline.select("metric", F.col("value").alias("baseline"))
    return aggregates.join(before, "metric", "left").withColumn("delta", F.col("value") - F.col("baseline"))


def merge_baseline(baseline: DataFrame, tracks: DataFrame) -> DataFrame:
    """Replace the ``(track, metric, value)`` rows of the tracks that were run."""
    return baseline.join(tracks.select("track").distinct(), "track", "left_anti").unionByName(tracks)


def sample(
    corpus: DataFrame, queries: DataFrame, judged: DataFrame, seed: int, n_queries: int, corpus_size: int
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``n_queries`` judged queries, all their documents, filled up to ``corpus_size``.

    The order is a hash of id and seed: the same on every run and every cluster.
    """

    def shuffled(rows: DataFrame, key: str) -> DataFrame:
        return rows.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)

    eligible = queries.join(judged.select("query_id").distinct(), "query_id", "left_semi")
    chosen = shuffled(eligible, "query_id").limit(n_queries)
    kept = judged.join(chosen.select("query_id"), "query_id", "left_semi")
    needed = corpus.join(kept.select("doc_id").distinct(), "doc_id", "left_semi")
    missing = max(corpus_size - needed.count(), 0) if corpus_size else 0
    if missing:
        others = corpus.join(kept.select("doc_id").distinct(), "doc_id", "left_anti")
        needed = needed.unionByName(shuffled(others, "doc_id").limit(missing))
    return needed, chosen, kept


def judge_cost(usage: DataFrame, judge_model: str) -> DataFrame:
    """Total cost of ``(input_tokens, output_tokens)`` rows; NULL for an unpriced judge."""
    rates = JUDGE_RATES.get(judge_model)
    if rates is None:
        return usage.agg(F.lit(None).cast("double").alias("estimated_usd"))
    spent = F.col("input_tokens") * F.lit(rates[0]) + F.col("output_tokens") * F.lit(rates[1])
    return usage.agg(F.sum(spent).alias("estimated_usd"))


def save_run(results: DataFrame, path: str, run: str) -> None:
    """Append the ``(track, metric, value)`` rows of one evaluation run as JSON."""
    results.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").json(path)
