"""Vector search, keyword search, fusion and answers over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.filters import compile_filter
from lodestone.functions.vectors import l2_normalize, similarity_from_distance, squared_norm
from lodestone.operators.completion import EchoModel
from lodestone.operators.fusion import HybridSettings
from lodestone.operators.keyword import build_postings, keyword_search, search_postings
from lodestone.operators.knn import knn, knn_batch
from lodestone.operators.skew import sparse_left_join
from lodestone.plans.catalog import SYSTEM_PROMPTS
from lodestone.plans.rag import answer
from lodestone.plans.retrieval import SearchRequest, at_least, attach_chunks, result_stats, search, search_batch, search_stored
from lodestone.schemas import CHUNKS
from lodestone.session import work_path
from lodestone.sources.adapters import corpus, table, vectors
from lodestone.sources.chunk_store import ChunkStore
from queries.common import Query, rounded, tokens_sql

QUERY_ID, DIM = 7, 64
WORDS = "the erthe nation und"


def _query_vector(spark, sf) -> list[float]:
    return list(vectors(spark, sf).where(F.col("id") == QUERY_ID).first().vector)


def _knn(spark, sf) -> DataFrame:
    hits = knn(vectors(spark, sf), _query_vector(spark, sf), 10)
    return rounded(hits.select("id", "vector_distance", "vector_similarity"), 6, "vector_distance", "vector_similarity")


def _knn_filtered(spark, sf) -> DataFrame:
    chunks = vectors(spark, sf).withColumnRenamed("label", "metadata_num_1")
    where = compile_filter({"label": {"$in": [1, 3]}}, {"label": ("num", 1)})
    hits = knn(chunks, _query_vector(spark, sf), 10, where)
    return rounded(hits.select("id", "vector_distance"), 6, "vector_distance")


def _label_queries(spark, sf) -> DataFrame:
    """One query per label: its vector with the lowest id."""
    first = vectors(spark, sf).groupBy("label").agg(F.min_by("vector", "id").alias("query_vector"))
    return first.select(F.col("label").alias("query_id"), "query_vector")


def _knn_batch(spark, sf) -> DataFrame:
    hits = knn_batch(vectors(spark, sf), _label_queries(spark, sf), 5, DIM)
    return rounded(hits.select("query_id", "id", F.col("rank").cast("bigint"), "vector_distance"), 6, "vector_distance")


def _similarity(spark, sf) -> DataFrame:
    """The normalised vectors by value: their length, and a sum that weighs each element by its place."""
    unit = l2_normalize(F.col("vector"))
    scaled = l2_normalize(F.transform("vector", lambda x: (x * F.lit(3.0)).cast("float")))
    placed = lambda v: F.aggregate(F.transform(v, lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    shown = vectors(spark, sf).select(
        "id", F.sqrt(squared_norm(unit)).alias("norm"), placed(unit).alias("weighted"), placed(scaled).alias("scaled_weighted")
    )
    return rounded(shown, 3, "norm", "weighted", "scaled_weighted")


def _keyword(spark, sf) -> DataFrame:
    hits = keyword_search(corpus(spark, sf), WORDS, 200)
    return rounded(hits.select("id", "keyword_bm25_score"), 6, "keyword_bm25_score")


def _keyword_filtered(spark, sf) -> DataFrame:
    hits = keyword_search(corpus(spark, sf), WORDS, 50, F.col("source") == "src3")
    return rounded(hits.select("id", "keyword_bm25_score"), 6, "keyword_bm25_score")


def _benchmark_queries(spark, sf) -> DataFrame:
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))


def _keyword_batch(spark, sf) -> DataFrame:
    hits = search_postings(build_postings(corpus(spark, sf)), _benchmark_queries(spark, sf), 10)
    return rounded(hits.select("query_id", "id", "keyword_bm25_score"), 6, "keyword_bm25_score")


def _texts(spark, sf) -> DataFrame:
    """Every document as a chunk without its vector."""
    return corpus(spark, sf).select("id", "chunk_text", F.lit(None).cast("string").alias("chunk_header"), F.col("source").alias("source_name"))


def _chunks(spark, sf) -> DataFrame:
    """Every document, with the vector of the same id where there is one."""
    rows = _texts(spark, sf).join(vectors(spark, sf), "id", "left")
    return rows.select("id", "vector", "chunk_text", "chunk_header", "source_name", F.col("label").cast("double").alias("metadata_num_1"))


def _scores(hits: DataFrame) -> DataFrame:
    shown = hits.select(
        "id",
        F.col("rank").cast("bigint").alias("rank"),
        "vector_distance",
        "keyword_bm25_score",
        "rrf_score",
        "rrf_score_normalized",
    )
    shown = rounded(shown, 5, "vector_distance", "keyword_bm25_score", "rrf_score")
    return rounded(shown, 2, "rrf_score_normalized")


def _hybrid(spark, sf) -> DataFrame:
    return _scores(search(_chunks(spark, sf), WORDS, _query_vector(spark, sf), SearchRequest(top_k=20)))


def _hybrid_weights(spark, sf) -> DataFrame:
    request = SearchRequest(top_k=20, settings=HybridSettings(0.6, 0.4, 10.0, 50))
    return _scores(search(_chunks(spark, sf), WORDS, _query_vector(spark, sf), request))


def _vector_only(spark, sf) -> DataFrame:
    request = SearchRequest(top_k=20, vector_search_only=True)
    hits = search(_chunks(spark, sf), WORDS, _query_vector(spark, sf), request)
    return rounded(hits.select("id", F.col("rank").cast("bigint").alias("rank"), "vector_similarity"), 6, "vector_similarity")


def _min_similarity(spark, sf) -> DataFrame:
    hits = search(_chunks(spark, sf), WORDS, _query_vector(spark, sf), SearchRequest(top_k=20))
    return at_least(hits, 20.0).select("id", F.round("vector_similarity", 5).alias("vector_similarity"))


def _batch_queries(spark, sf) -> DataFrame:
    """Benchmark texts, each with the vector of the same number."""
    return _benchmark_queries(spark, sf).join(
        vectors(spark, sf).select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector")), "query_id"
    )


def _hybrid_batch_hits(spark, sf) -> DataFrame:
    # Texts stay out of the join with the vectors: its shuffle would carry them for each pass.
    postings = build_postings(_texts(spark, sf))
    return search_batch(_chunks(spark, sf), _batch_queries(spark, sf), DIM, SearchRequest(top_k=5), postings)


def _hybrid_batch(spark, sf) -> DataFrame:
    hits = _hybrid_batch_hits(spark, sf)
    return rounded(hits.select("query_id", F.col("rank").cast("bigint").alias("rank"), "id", "rrf_score"), 5, "rrf_score")


def _shown_results(spark, sf) -> DataFrame:
    shown = ("source_name", "chunk_header", "chunk_text")
    return attach_chunks(_hybrid_batch_hits(spark, sf), _texts(spark, sf), _batch_queries(spark, sf), *shown)


def _result_stats(spark, sf) -> DataFrame:
    stats = result_stats(_shown_results(spark, sf))
    return stats.select(
        "query_id",
        F.size("results").cast("bigint").alias("result_count"),
        F.array_join(F.transform("results", lambda r: r["source_name"]), ",").alias("sources"),
    )


def _stored_documents(spark, sf) -> ChunkStore:
    """All documents as chunks of an indexed store, in three changes: a third first with other texts, which then give way.

    Some rows that no document has come and go in between.
    """
    docs = sparse_left_join(table(spark, sf, "documents"), vectors(spark, sf).select(F.col("id").alias("doc_id"), "vector"), ["doc_id"])
    padded = F.lpad(F.col("doc_id").cast("string"), 12, "0")
    given = {
        "id": padded,
        "document_id": padded,
        "chunk_text": F.col("text"),
        "source_name": F.col("source"),
        "vector": F.col("vector"),
        "chunk_index": F.lit(0),
    }
    rows = docs.select("doc_id", *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in CHUNKS.fields])
    plain = lambda some: some.select(*CHUNKS.fieldNames())
    stale = rows.where("doc_id % 3 = 0").withColumn("chunk_text", F.concat(F.lit("the erthe stale "), "chunk_text"))
    gone = rows.where("doc_id % 5 = 0").withColumns({c: F.concat(F.lit("gone"), c) for c in ("id", "document_id")})
    store = ChunkStore(spark, work_path(spark, "stored"), "documents", buckets=8)
    store.create(text_index=True)
    store.append(plain(rows.where("doc_id % 3 <> 0").unionByName(stale).unionByName(gone)))
    store.replace_documents(stale.select("document_id"), plain(rows.where("doc_id % 3 = 0")))
    store.delete_documents(gone.select("document_id"))
    return store


def _keyword_stored(spark, sf) -> DataFrame:
    store = _stored_documents(spark, sf)
    hits = store.words.search(store.index_state(), _benchmark_queries(spark, sf), 10)
    return rounded(hits.select("query_id", F.col("id").cast("bigint").alias("id"), "keyword_bm25_score"), 6, "keyword_bm25_score")


def _hybrid_stored(spark, sf) -> DataFrame:
    hits = search_stored(_stored_documents(spark, sf), WORDS, _query_vector(spark, sf), SearchRequest(top_k=20))
    return _scores(hits.withColumn("id", F.col("id").cast("bigint")))


def _rag(spark, sf) -> DataFrame:
    template = SYSTEM_PROMPTS["concise_rag"][2]
    done = answer(_benchmark_queries(spark, sf), _shown_results(spark, sf), template, EchoModel())
    return done.select("query_id", "formatted_prompt", "answer", "llm_model")


DIST = "sqrt(list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: pow(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE), 2))))"
KNN_SQL = f"""SELECT v.vec_id AS id, {DIST} AS d FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = {QUERY_ID}) q"""


def _bm25_cte(docs: str, terms: str) -> str:
    """Score every row of ``docs(id, text)`` against ``terms(query_id, term)``."""
    return f"""docs AS ({docs}),
  toks AS (SELECT id, {tokens_sql('text')} AS t FROM docs),
  stats AS (SELECT count(*) AS n, avg(len(t)) AS average FROM toks),
  words AS (SELECT id, len(t) AS length, unnest(t) AS term FROM toks),
  terms AS ({terms}),
  tf AS (SELECT id, length, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  scored AS (
    SELECT query_id, id, round(sum(ln(1e0 + (n - df + 0.5e0) / (df + 0.5e0)) * tf * 2.2e0
                             / (tf + 1.2e0 * (0.25e0 + 0.75e0 * length / average))), 9) AS score
    FROM tf JOIN df USING (term) JOIN terms USING (term), stats GROUP BY query_id, id)"""


ONE_QUERY = f"SELECT DISTINCT 0 AS query_id, unnest({tokens_sql(repr(WORDS))}) AS term"
BENCH_TERMS = f"SELECT DISTINCT item_id AS query_id, unnest({tokens_sql('text')}) AS term FROM benchmark"
ALL_DOCS = "SELECT doc_id AS id, text, source FROM documents"


def _hybrid_sql(top_k: int, text_weight: float, semantic_weight: float, k: float, limit: int) -> str:
    """Ranks from 0, single-precision contributions, normalised to the best score."""
    return f"""WITH {_bm25_cte(ALL_DOCS, ONE_QUERY)},
  near AS (SELECT id, d, row_number() OVER (ORDER BY d, id) - 1 AS r FROM ({KNN_SQL}) JOIN docs USING (id)
           QUALIFY r < {top_k}),
  found AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS r FROM scored QUALIFY r < {limit}),
  fused AS (
    SELECT id, d, score,
           coalesce(CAST({semantic_weight} AS FLOAT) / (CAST({k} AS FLOAT) + CAST(near.r AS FLOAT)), CAST(0 AS FLOAT))
         + coalesce(CAST({text_weight} AS FLOAT) / (CAST({k} AS FLOAT) + CAST(found.r AS FLOAT)), CAST(0 AS FLOAT)) AS rrf
    FROM near FULL OUTER JOIN found USING (id)),
  best AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, id) - 1 AS rank FROM fused QUALIFY rank < {top_k})"""


HYBRID_OUT = """
SELECT id, CAST(rank AS BIGINT) AS rank, round(d, 5) AS vector_distance, round(score, 5) AS keyword_bm25_score,
       round(CAST(rrf AS DOUBLE), 5) AS rrf_score,
       round(CAST(rrf / max(rrf) OVER () * 100 AS DOUBLE), 2) AS rrf_score_normalized FROM best"""

BATCH_CTE = f"""WITH {_bm25_cte(ALL_DOCS, BENCH_TERMS)},
  near AS (
    SELECT q.vec_id AS query_id, v.vec_id AS id,
           row_number() OVER (PARTITION BY q.vec_id ORDER BY {DIST}, v.vec_id) - 1 AS r
    FROM (SELECT * FROM embeddings WHERE vec_id IN (SELECT doc_id FROM documents)) v,
         (SELECT * FROM embeddings WHERE vec_id IN (SELECT item_id FROM benchmark)) q
    QUALIFY r < 5),
  found AS (
    SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) - 1 AS r
    FROM scored WHERE query_id IN (SELECT vec_id FROM embeddings) QUALIFY r < 200),
  fused AS (
    SELECT query_id, id,
           coalesce(CAST(0.7 AS FLOAT) / (CAST(60 AS FLOAT) + CAST(near.r AS FLOAT)), CAST(0 AS FLOAT))
         + coalesce(CAST(0.3 AS FLOAT) / (CAST(60 AS FLOAT) + CAST(found.r AS FLOAT)), CAST(0 AS FLOAT)) AS rrf
    FROM near FULL OUTER JOIN found USING (query_id, id)),
  best AS (
    SELECT query_id, id, rrf, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) - 1 AS rank
    FROM fused QUALIFY rank < 5)"""

CONTEXT_SQL = r"""
SELECT b.item_id AS query_id,
       replace(replace('{template}', '{{{{context}}}}', coalesce(c.context, '')), '{{{{question}}}}', b.text) AS formatted_prompt,
       'fake answer for: ' || left('{template}', 40) AS answer,
       'mock-llm' AS llm_model
FROM benchmark b LEFT JOIN (
  SELECT query_id, string_agg('[Source ' || (rank + 1) || ': ' || source || ']' || chr(10) || text,
                              chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM best JOIN docs USING (id) GROUP BY query_id) c ON c.query_id = b.item_id"""


QUERIES = {
    "knn": Query(
        _knn,
        f"""SELECT id, round(d, 6) AS vector_distance, round(greatest(1 - d * d / 2, 0) * 100, 6) AS vector_similarity
          FROM ({KNN_SQL}) ORDER BY d, id LIMIT 10""",
    ),
    "knn_filtered": Query(
        _knn_filtered,
        f"""SELECT id, round(d, 6) AS vector_distance FROM ({KNN_SQL} WHERE v.label IN (1, 3)) ORDER BY d, id LIMIT 10""",
    ),
    "knn_batch": Query(
        _knn_batch,
        f"""SELECT query_id, id, CAST(r AS BIGINT) AS rank, round(d, 6) AS vector_distance FROM (
            SELECT q.label AS query_id, v.vec_id AS id, {DIST} AS d,
                   row_number() OVER (PARTITION BY q.label ORDER BY {DIST}, v.vec_id) - 1 AS r
            FROM embeddings v, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) q)
          WHERE r < 5""",
    ),
    "vector_normalize": Query(
        _similarity,
        """WITH sums AS (
            SELECT vec_id AS id, sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))) AS length,
                   list_sum(list_transform(embedding, lambda x, i: CAST(x AS DOUBLE) * i)) AS placed FROM embeddings)
          SELECT id, round(length / length, 3) AS norm, round(placed / length, 3) AS weighted,
                 round(placed / length, 3) AS scaled_weighted FROM sums""",
    ),
    "keyword_search": Query(
        _keyword,
        f"""WITH {_bm25_cte(ALL_DOCS, ONE_QUERY)}
          SELECT id, round(score, 6) AS keyword_bm25_score FROM scored ORDER BY score DESC, id LIMIT 200""",
    ),
    "keyword_search_filtered": Query(
        _keyword_filtered,
        f"""WITH {_bm25_cte(ALL_DOCS, ONE_QUERY)}
          SELECT id, round(score, 6) AS keyword_bm25_score FROM scored JOIN docs USING (id)
          WHERE source = 'src3' ORDER BY score DESC, id LIMIT 50""",
    ),
    "keyword_search_batch": Query(
        _keyword_batch,
        f"""WITH {_bm25_cte(ALL_DOCS, BENCH_TERMS)}
          SELECT query_id, id, round(score, 6) AS keyword_bm25_score FROM scored
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    ),
    "keyword_search_stored": Query(
        _keyword_stored,
        f"""WITH {_bm25_cte(ALL_DOCS, BENCH_TERMS)}
          SELECT query_id, id, round(score, 6) AS keyword_bm25_score FROM scored
          QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 10""",
    ),
    "hybrid_search_stored": Query(_hybrid_stored, _hybrid_sql(20, 0.3, 0.7, 60, 200) + HYBRID_OUT),
    "hybrid_search": Query(_hybrid, _hybrid_sql(20, 0.3, 0.7, 60, 200) + HYBRID_OUT),
    "hybrid_search_weights": Query(_hybrid_weights, _hybrid_sql(20, 0.6, 0.4, 10, 50) + HYBRID_OUT),
    "vector_search_only": Query(
        _vector_only,
        f"""SELECT id, CAST(r AS BIGINT) AS rank, round(greatest(1 - d * d / 2, 0) * 100, 6) AS vector_similarity FROM (
            SELECT id, d, row_number() OVER (ORDER BY d, id) - 1 AS r
            FROM ({KNN_SQL}) WHERE id IN (SELECT doc_id FROM documents)) WHERE r < 20""",
    ),
    "min_similarity": Query(
        _min_similarity,
        _hybrid_sql(20, 0.3, 0.7, 60, 200)
        + """ SELECT id, round(greatest(1 - d * d / 2, 0) * 100, 5) AS vector_similarity FROM best
          WHERE greatest(1 - d * d / 2, 0) * 100 >= 20 AND d IS NOT NULL""",
    ),
    "hybrid_search_batch": Query(
        _hybrid_batch,
        BATCH_CTE + " SELECT query_id, CAST(rank AS BIGINT) AS rank, id, round(CAST(rrf AS DOUBLE), 5) AS rrf_score FROM best",
    ),
    "result_stats": Query(
        _result_stats,
        BATCH_CTE
        + """ SELECT query_id, CAST(count(*) AS BIGINT) AS result_count, string_agg(source, ',' ORDER BY rank) AS sources
          FROM best JOIN docs USING (id) GROUP BY query_id""",
    ),
    "rag_answer": Query(
        _rag, BATCH_CTE + CONTEXT_SQL.format(template=SYSTEM_PROMPTS["concise_rag"][2].replace("'", "''"))
    ),
}
