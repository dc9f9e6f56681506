"""Search requests: filter, vector pass, keyword pass, fusion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.filters import compile_filter
from lodestone.functions.metadata import MetadataField, field_map, reconstruct
from lodestone.operators.fusion import HybridSettings, fuse, ranked
from lodestone.operators.keyword import PostingLists, build_postings, keyword_search, search_postings
from lodestone.operators.knn import knn, knn_batch
from lodestone.operators.skew import BROADCAST_ROWS, fits_broadcast, lookup_join
from lodestone.session import work_path
from lodestone.sources.chunk_store import ChunkStore

QUERY_TOP_K, RAG_TOP_K, MAX_TOP_K = 5, 2, 100


@dataclass(frozen=True)
class SearchRequest:
    top_k: int = QUERY_TOP_K
    filters: str | dict | None = None
    fields: tuple[MetadataField, ...] = ()
    vector_search_only: bool = False
    settings: HybridSettings = field(default_factory=HybridSettings)
    now: datetime | None = None

    def __post_init__(self) -> None:
        if not 1 <= self.top_k <= MAX_TOP_K:
            raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")

    def predicate(self):
        return compile_filter(self.filters, field_map(self.fields), self.now)


def search(chunks: DataFrame, text: str, vector: Sequence[float], request: SearchRequest) -> DataFrame:
    """Ranked chunks for one query.

    The displayed columns ride along with both passes: they are read in the one
    scan each pass needs anyway, and only limited rows are shuffled.
    """
    shown = tuple(c for c in chunks.columns if c not in ("id", "vector"))
    where = request.predicate()
    near = ranked(knn(chunks, vector, request.top_k, where), [F.col("vector_distance"), F.col("id")])
    if request.vector_search_only:
        return near.select("query_id", "rank", "id", *shown, "vector_distance", "vector_similarity").orderBy("rank")
    texts = chunks.select("id", *shown)
    found = ranked(
        keyword_search(texts, text, request.settings.full_text_limit, where),
        [F.col("keyword_bm25_score").desc(), F.col("id")],
    )
    return fuse(near, found, request.settings, request.top_k, shown).orderBy("rank")


def search_stored(store: ChunkStore, text: str, vector: Sequence[float], request: SearchRequest) -> DataFrame:
    """:func:`search` over a stored collection, through its keyword index.

    The vector pass reads ids, vectors and what the filter names; the keyword pass
    reads posting blocks.  Texts are read for the results alone, from the buckets of
    their documents.
    """
    at = store.manifest()
    state = store.index_state(at)
    if state is None:
        return search(store.read(at=at), text, vector, request)
    chunks, where = store.read(at=at), request.predicate()
    near = knn(chunks, vector, request.top_k, where).select("id", "document_id", "vector_distance", "vector_similarity")
    near = ranked(near, [F.col("vector_distance"), F.col("id")])
    if request.vector_search_only:
        hits = near
    else:
        asked = store.spark.createDataFrame([(0, text)], "query_id int, query_text string")
        allowed = None if where is None else chunks.where(where).select("id")
        found = store.words.search(state, asked, request.settings.full_text_limit, allowed)
        hits = fuse(near, found, request.settings, request.top_k, ("document_id",))
    # At most top_k rows: stored, so that neither pass runs twice.
    path = work_path(store.spark, "search-hits")
    hits.write.parquet(path)
    hits = store.spark.read.parquet(path)
    scores = [c for c in hits.columns if c not in ("query_id", "rank", "id", "document_id")]
    shown = [c for c in store.schema.fieldNames() if c not in ("id", "vector")]
    rows = store.read(store.touched(hits), at).select("id", *shown)
    out = rows.join(F.broadcast(hits.drop("document_id")), "id")
    return out.select("query_id", "rank", "id", *shown, *scores).orderBy("rank")


def search_batch(
    chunks: DataFrame, queries: DataFrame, dim: int, request: SearchRequest, index: PostingLists | None = None
) -> DataFrame:
    """Ranked chunk ids for every row of ``queries(query_id, query_text, query_vector)``."""
    where = request.predicate()
    kept = chunks if where is None else chunks.where(where)
    near = knn_batch(kept, queries, request.top_k, dim)
    if request.vector_search_only:
        return near
    found = search_postings(
        index or build_postings(chunks), queries, request.settings.full_text_limit, None if where is None else kept
    )
    return fuse(near, found, request.settings, request.top_k)


def attach_chunks(results: DataFrame, chunks: DataFrame, queries: DataFrame, *columns: str) -> DataFrame:
    """Texts and metadata for batch results.

    Each query has at most 100 results, so counting the queries bounds them
    without running the search a second time.
    """
    small = fits_broadcast(queries, BROADCAST_ROWS // MAX_TOP_K)
    return lookup_join(chunks.select("id", *columns), results, ["id"], small=small)


def at_least(results: DataFrame, min_similarity: float | None, keyword_passes: bool = False) -> DataFrame:
    """Drop weak results after ranking, so fewer than ``top_k`` may remain.

    A keyword-only hit has no similarity and fails; ``keyword_passes`` treats it
    as a perfect match instead.
    """
    if min_similarity is None or min_similarity <= 0:
        return results
    similarity = F.coalesce("vector_similarity", F.lit(100.0 if keyword_passes else None).cast("double"))
    return results.where(similarity >= min_similarity)


def result_items(results: DataFrame, fields: Sequence[MetadataField] = ()) -> DataFrame:
    """The public shape of a result row."""
    scores = [c for c in ("keyword_bm25_score", "rrf_score_normalized", "rrf_score") if c in results.columns]
    return results.select(
        "query_id",
        "rank",
        F.col("source_name").alias("source"),
        "file_uri",
        "mime_type",
        "chunk_index",
        "chunk_header",
        "chunk_text",
        "extra_json",
        "vector_distance",
        "vector_similarity",
        *scores,
        reconstruct(fields).alias("metadata"),
    )


def result_stats(results: DataFrame) -> DataFrame:
    """Per query, the ranked list of scores that usage events keep."""

    def score(c: str):
        return (F.coalesce(F.col(c), F.lit(0.0)) if c in results.columns else F.lit(0.0)).cast("double")

    entry = F.struct(
        "rank",
        F.struct(
            F.col("source_name").alias("source_name"),
            score("vector_similarity").alias("similarity"),
            score("keyword_bm25_score").alias("bm25_score"),
            score("rrf_score").alias("rrf_score"),
        ).alias("stat"),
    )
    # A query has at most top_k results, so the list is bounded.
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return listed.select("query_id", F.transform("_list", lambda e: e["stat"]).alias("results"))


def trace_chunks(results: DataFrame) -> DataFrame:
    """Per query, the ranked chunks a trace keeps for drill-down."""

    def score(c: str):
        return (F.coalesce(F.col(c), F.lit(0.0)) if c in results.columns else F.lit(0.0)).cast("double")

    entry = F.struct(
        "rank",
        F.struct(
            "source_name",
            "chunk_header",
            F.coalesce("chunk_text", F.lit("")).alias("chunk_text"),
            score("vector_similarity").alias("similarity"),
            score("keyword_bm25_score").alias("bm25_score"),
        ).alias("chunk"),
    )
    listed = results.groupBy("query_id").agg(F.array_sort(F.collect_list(entry)).alias("_list"))
    return listed.select("query_id", F.transform("_list", lambda e: e["chunk"]).alias("chunks"))
