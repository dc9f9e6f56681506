"""The stored keyword index against searches over the texts, and what its plans read."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators.fusion import HybridSettings
from lodestone.operators.keyword import build_postings, keyword_search, search_postings
from lodestone.plans.retrieval import SearchRequest, search, search_stored
from lodestone.schemas import CHUNKS
from lodestone.session import work_path
from lodestone.sources import text_index
from lodestone.sources.chunk_store import ChunkStore

WORDS = [f"w{i}" for i in range(40)] + ["the"] * 40


def chunk_rows(spark, texts):
    """``texts`` of (id, document_id, text) as chunk rows."""
    rows = spark.createDataFrame(texts, "id string, document_id string, chunk_text string")
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(0 if f.name == "chunk_index" else None)).cast(f.dataType).alias(f.name) for f in CHUNKS.fields])


def prose(rng, most=60):
    return " ".join(rng.choice(WORDS) for _ in range(rng.randrange(most)))


@pytest.fixture
def store(spark, monkeypatch):
    monkeypatch.setattr(text_index, "BLOCK", 8)
    monkeypatch.setattr(text_index, "FIRST_BLOCKS", 2)
    monkeypatch.setattr(text_index, "BUCKET_ROWS", 200)
    made = ChunkStore(spark, work_path(spark, "indexed"), "c", buckets=4)
    made.create(text_index=True)
    return made


QUESTIONS = [(1, "w1 w2 the"), (2, "W3, w3 w4!"), (3, "nothing of it"), (4, ""), (5, "the")]


def agrees(spark, store, limit=7):
    """Both ways give the same chunks and scores for every question, filtered or not."""
    asked = spark.createDataFrame(QUESTIONS, "query_id int, query_text string")
    chunks = store.read()
    for where in (None, F.col("document_id") < "d2"):
        allowed = None if where is None else chunks.where(where).select("id")
        wanted = search_postings(build_postings(chunks), asked, limit, allowed).collect()
        found = store.words.search(store.index_state(), asked, limit, allowed).collect()
        key = lambda r: (r.query_id, r.rank, r.id, round(r.keyword_bm25_score, 7))
        assert sorted(map(key, found)) == sorted(map(key, wanted)) and found
    state = store.index_state()
    totals = chunks.selectExpr("count(*)", "sum(size(filter(split(lower(chunk_text), '[^a-z0-9]+'), x -> x != '')))").first()
    assert (state.chunks, state.tokens) == tuple(totals)


def test_index_follows_every_change(spark, store):
    rng = random.Random(3)
    texts = [(f"c{i}", f"d{i % 20:02d}", prose(rng)) for i in range(120)]
    store.append(chunk_rows(spark, texts))
    agrees(spark, store)
    named = spark.createDataFrame([("d03",), ("d07",), ("d99",)], "document_id string")
    store.replace_documents(named, chunk_rows(spark, [(f"n{i}", f"d{[3, 7][i % 2]:02d}", prose(rng)) for i in range(9)] + [("e", "d99", "")]))
    store.append(chunk_rows(spark, [(f"a{i}", "d07", prose(rng, 400)) for i in range(3)]))
    agrees(spark, store)
    store.delete_documents(spark.createDataFrame([("d11",), ("d03",)], "document_id string"))
    store.delete_chunks(spark.createDataFrame([("d07", "n1"), ("d05", "c5")], "document_id string, id string"))
    store.update_document("d05", {"source_name": F.lit("renamed")})
    agrees(spark, store)
    merged = store.words.merged(store.index_state())
    assert len(store.index_state().deltas) == 5 and len(merged.deltas) == 1
    asked = spark.createDataFrame(QUESTIONS, "query_id int, query_text string")
    key = lambda r: (r.query_id, r.rank, r.id)
    assert sorted(map(key, store.words.search(merged, asked, 9).collect())) == sorted(map(key, store.words.search(store.index_state(), asked, 9).collect()))
    store.compact()
    assert store.index_state().deltas
    store.drop_text_index()
    assert store.index_state() is None
    store.create_text_index()
    agrees(spark, store)


def test_many_changes_are_merged(spark, store, monkeypatch):
    monkeypatch.setattr(text_index, "MERGE_AFTER", 2)
    for i in range(4):
        store.replace_documents(
            spark.createDataFrame([(f"d{i // 2}",)], "document_id string"), chunk_rows(spark, [(f"c{i}", f"d{i // 2}", f"w1 w{i} the")])
        )
    assert len(store.index_state().deltas) <= 2
    agrees(spark, store)


def test_search_through_the_index(spark, store):
    rng = random.Random(4)
    rows = chunk_rows(spark, [(f"c{i:03d}", f"d{i % 9}", prose(rng)) for i in range(150)])
    vector = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: (F.abs(F.hash(F.col("id"), k)) % 100 / 100).cast("float"))
    store.append(rows.withColumns({"vector": vector, "source_name": F.concat(F.lit("s"), F.length("chunk_text") % 3)}))
    query = [0.1, 0.2, 0.3, 0.4]
    for request in (
        SearchRequest(top_k=10),
        SearchRequest(top_k=5, settings=HybridSettings(0.8, 0.2, 5.0, 3)),
        SearchRequest(top_k=5, filters={"source_name": {"$ne": "s1"}}),
        SearchRequest(top_k=4, vector_search_only=True),
    ):
        wanted = search(store.read(), "w5 the w6", query, request)
        found = search_stored(store, "w5 the w6", query, request)
        assert set(found.columns) == set(wanted.columns)
        columns = sorted(found.columns)
        shown = lambda df: [tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).orderBy("rank").collect()]
        assert shown(found) == shown(wanted) and shown(found)


def test_blocks_that_cannot_reach_the_best_are_not_read(spark, store):
    """Short chunks full of a term, and many long ones that hold it once."""
    texts = [(f"s{i}", f"d{i}", "rare rare rare") for i in range(10)] + [(f"l{i}", f"e{i}", "rare " + "pad " * 50) for i in range(200)]
    store.append(chunk_rows(spark, texts))
    asked = spark.createDataFrame([(1, "rare")], "query_id int, query_text string")
    one = text_index._Search(store.words, store.index_state(), asked, 5, None)
    assert {r.id for r in one.result().collect()} <= {f"s{i}" for i in range(10)}
    first, rest, known = one.blocks_read
    assert first == 2 and rest == 0 and known > 20


def test_plan_reads_posting_folders_and_no_text(spark, store):
    store.append(chunk_rows(spark, [(f"c{i}", f"d{i}", f"w{i} w{i + 1} the end w{i * 7}") for i in range(300)]))
    rows = store.words._read("postings", store.index_state(), ["w1", "the"], "term string, block long, n long")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "chunk_text" not in plan
    assert "PartitionFilters: [" in plan and "bucket#" in plan.split("PartitionFilters:")[1].split("PushedFilters")[0]
    assert "In(term, [" in plan.split("PushedFilters:")[1]
    assert "postings:array" not in plan


def test_stores_without_an_index_search_their_texts(spark):
    plain = ChunkStore(spark, work_path(spark, "plain"), "c", buckets=2)
    plain.create()
    plain.append(chunk_rows(spark, [("a", "d", "one two"), ("b", "d", "two")]))
    assert plain.index_state() is None
    found = search_stored(plain, "one", [1.0], SearchRequest(top_k=3)).collect()
    assert [r.id for r in found] == [r.id for r in search(plain.read(), "one", [1.0], SearchRequest(top_k=3)).collect()]
    assert keyword_search(plain.read(), "one", 3).count() == 1


def test_terms_are_counted_in_the_row_and_dealt_once(spark, store):
    """Writing postings takes one shuffle, scoring one by blocks; nothing is repeated over salts."""
    rows = spark.createDataFrame([("", 0), ("one Two two, 2", 4), (None, -1)], "chunk_text string, n int").select(text_index.tokens(F.col("chunk_text")).alias("t"), "n")
    counted = rows.select("n", text_index.term_counts(F.col("t")).alias("c"))
    assert "Exchange" not in counted._jdf.queryExecution().executedPlan().toString()
    found = {r.n: {(p.term, p.tf) for p in r.c or ()} for r in counted.collect()}
    assert found == {0: set(), 4: {("one", 1), ("two", 2), ("2", 1)}, -1: set()}
    store.append(chunk_rows(spark, [(f"c{i}", f"d{i}", f"w{i} the end") for i in range(60)]))
    asked = spark.createDataFrame([(1, "the w1"), (2, "end w2")], "query_id int, query_text string")
    one = text_index._Search(store.words, store.index_state(), asked, 5, None)
    one.result()
    blocks = spark.createDataFrame([(1, 1, 0)], "query_id int, delta int, block long")
    plan = one._scored(blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" not in plan


def test_held_rows_are_not_shuffled_by_a_commit(spark):
    plain = ChunkStore(spark, work_path(spark, "held"), "c", buckets=3)
    plain.append(chunk_rows(spark, [(f"c{i}", f"d{i}", "one two") for i in range(50)]))
    before = {r.id for r in plain.read().collect()}
    spark.sparkContext.setJobGroup("null-slot", "")
    plain.null_slot("metadata_str_1")
    status = spark.sparkContext.statusTracker()
    stages = [s for j in status.getJobIdsForGroup("null-slot") for s in status.getJobInfo(j).stageIds]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(stages) == 1
    assert {r.id for r in plain.read().collect()} == before
    per_folder = {r.f for r in plain.read().select(F.regexp_extract(F.input_file_name(), "bucket=([0-9]+)", 1).alias("f")).distinct().collect()}
    assert per_folder == {"0", "1", "2"}
