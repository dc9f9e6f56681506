"""BM25 over chunk texts, from the texts or from a stored inverted index."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.text import term_counts, tokens
from lodestone.operators.ranking import top_per_group
from lodestone.operators.skew import fits_broadcast, lookup_join
from lodestone.session import work_path

K1, B = 1.2, 0.75
# Scores are sums in no fixed order; at this precision exact copies tie on every run.
SCORE_DIGITS = 9


def idf(n: Column, df: Column) -> Column:
    return F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5)))


def bm25(tf: Column, length: Column, n: Column, df: Column, average: Column) -> Column:
    """One term's contribution to one document's score."""
    tf = tf.cast("double")
    norm = tf + F.lit(K1) * (F.lit(1.0 - B) + F.lit(B) * length / average)
    return idf(n.cast("double"), df.cast("double")) * tf * F.lit(K1 + 1) / norm


def query_terms(spark: SparkSession, query: str) -> list[str]:
    """Distinct terms of one query text, by the same tokenizer as the chunks."""
    row = spark.range(1).select(F.array_sort(F.array_distinct(tokens(F.lit(query)))).alias("t")).first()
    return list(row.t)


def keyword_search(
    chunks: DataFrame, query: str, limit: int, where: Column | None = None, id_col: str = "id", text_col: str = "chunk_text"
) -> DataFrame:
    """The best ``limit`` chunks for one query text, ties by id.

    Term counts are taken inside each row, so the only things that move are one
    row of corpus statistics per task and ``limit`` results per task.  The
    statistics cover the whole collection, whatever ``where`` keeps.
    """
    terms = query_terms(chunks.sparkSession, query)
    if not terms:
        return chunks.where(F.lit(False)).withColumn("keyword_bm25_score", F.lit(0.0))

    def counted(rows: DataFrame, *columns: str) -> DataFrame:
        rows = rows.withColumn("_tokens", tokens(F.col(text_col)))
        size = F.size("_tokens")
        tfs = [(size - F.size(F.array_remove("_tokens", term))).alias(f"_tf{i}") for i, term in enumerate(terms)]
        return rows.select(*columns, size.alias("_len"), *tfs)

    dfs = [F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))]
    # An ungrouped aggregate is one row: a scalar subquery, not a join.
    stats = counted(chunks).agg(F.count("*").alias("n"), F.avg("_len").alias("average"), *dfs)
    stats = stats.select(F.struct("*")).scalar()
    parts = [
        F.when(
            F.col(f"_tf{i}") > 0,
            bm25(F.col(f"_tf{i}"), F.col("_len"), stats["n"], stats[f"_df{i}"], stats["average"]),
        ).otherwise(F.lit(0.0))
        for i in range(len(terms))
    ]
    score = F.round(reduce(lambda a, b: a + b, parts), SCORE_DIGITS)
    matched = reduce(lambda a, b: a | b, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])
    hits = counted(chunks if where is None else chunks.where(where), *chunks.columns)
    best = hits.select(*chunks.columns, score.alias("keyword_bm25_score"), matched.alias("_matched"))
    best = best.orderBy(F.col("_matched").desc(), F.col("keyword_bm25_score").desc(), id_col).limit(limit)
    # A term of nearly every chunk scores 0 after rounding and still matches.  Filtering
    # behind the limit keeps Spark from pushing the condition down and tokenizing
    # every text once more.
    return best.where("_matched").drop("_matched")


@dataclass
class PostingLists:
    """``postings(term, id, tf, length)`` and the one-row ``corpus(n, average)``."""

    postings: DataFrame
    corpus: DataFrame


def build_postings(chunks: DataFrame, id_col: str = "id", text_col: str = "chunk_text") -> PostingLists:
    """Term counts per chunk; a row is a chunk, and ids are unique.

    The tokens of a chunk are counted in its row, so nothing is shuffled and no task
    keeps more than a chunk's terms.
    """
    words = chunks.select(F.col(id_col).alias("id"), tokens(F.col(text_col)).alias("tokens"))
    corpus = words.withColumn("length", F.size("tokens")).agg(F.count("*").alias("n"), F.avg("length").alias("average"))
    counted = words.select("id", F.size("tokens").alias("length"), term_counts(F.col("tokens")).alias("terms"))
    # The outer form: for the inner one Spark adds a size filter that counts twice.
    listed = counted.select("id", "length", F.explode_outer("terms").alias("t")).where(F.col("t").isNotNull())
    return PostingLists(listed.select("id", "t.term", "length", "t.tf"), corpus)


TERM_BUCKETS = 256
TASK_PARTS = 4_000_000  # (query, chunk, term) parts of scores that a task adds up, about


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(TERM_BUCKETS)).cast("int")


def write_index(chunks: DataFrame, path: str, id_col: str = "id", text_col: str = "chunk_text") -> None:
    """Store the postings by term bucket: a search opens only its terms' folders.

    The rebalance splits a bucket that a frequent term inflates.
    """
    lists = build_postings(chunks, id_col, text_col)
    (
        lists.postings.withColumn("bucket", _bucket(F.col("term")))
        .hint("rebalance", "bucket", "term")
        .sortWithinPartitions("bucket", "term")
        .write.mode("overwrite")
        .option("compression", "zstd")
        .partitionBy("bucket")
        .parquet(f"{path}/postings")
    )
    lists.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def read_index(spark: SparkSession, path: str, terms: list[str] | None = None) -> PostingLists:
    postings = spark.read.parquet(f"{path}/postings")
    if terms is not None:
        wanted = spark.createDataFrame([(t,) for t in terms], "term string").select(_bucket(F.col("term")))
        buckets = [r[0] for r in wanted.distinct().collect()]
        postings = postings.where(F.col("bucket").isin(buckets) & F.col("term").isin(terms))
    return PostingLists(postings.drop("bucket"), spark.read.parquet(f"{path}/corpus"))


def search_postings(lists: PostingLists, queries: DataFrame, limit: int, allowed: DataFrame | None = None) -> DataFrame:
    """The best ``limit`` chunks for each ``(query_id, query_text)``.

    ``allowed`` restricts the hits to its ``id`` column without changing the
    corpus statistics.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query_text")))).alias("term"))
    small = fits_broadcast(asked)
    vocabulary = asked.select("term").distinct()
    # Document frequencies and hits both need the asked terms' postings: a table
    # keeps the texts (or the index) from being read for each of them.
    path = work_path(queries.sparkSession, "asked-postings")
    lookup_join(lists.postings, vocabulary, ["term"], "left_semi", small).write.parquet(path)
    postings = queries.sparkSession.read.parquet(path)
    frequency = postings.groupBy("term").agg(F.count("*").alias("df"))
    # At most one row per asked term, so the same size check covers it.
    weighted = asked.join(frequency, "term")
    hits = postings if allowed is None else postings.join(allowed.select("id"), "id", "left_semi")
    # A chunk's score is added up in one task, and a task has a bounded number of parts to add, however large the corpus.
    if small:
        parts = weighted.agg(F.sum("df").alias("parts")).first().parts or 0
        hits = hits.repartition(max(queries.sparkSession.sparkContext.defaultParallelism, -(-parts // TASK_PARTS)), "id")
    corpus = lists.corpus.select(F.struct("n", "average")).scalar()
    matched = lookup_join(hits, weighted, ["term"], "inner", small)
    part = bm25(F.col("tf"), F.col("length"), corpus["n"], F.col("df"), corpus["average"])
    scored = matched.groupBy("query_id", "id").agg(F.round(F.sum(part), SCORE_DIGITS).alias("keyword_bm25_score"))
    return top_per_group(scored, ["query_id"], [F.col("keyword_bm25_score").desc(), F.col("id")], limit)
