"""Changes of stores with a keyword index: given rows are made once, and keys move instead of rows."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import skew
from lodestone.operators.keyword import build_postings, search_postings
from lodestone.session import work_path
from lodestone.sources import text_index
from lodestone.sources.chunk_store import ChunkStore
from tests.test_text_index import chunk_rows, prose


def made(spark, name):
    store = ChunkStore(spark, work_path(spark, name), "c", buckets=2)
    store.create(text_index=True)
    return store


def matches(spark, store, asked, limit=9):
    key = lambda r: (r.query_id, r.rank, r.id, round(r.keyword_bm25_score, 7))
    wanted = search_postings(build_postings(store.read()), asked, limit).collect()
    found = store.words.search(store.index_state(), asked, limit).collect()
    assert sorted(map(key, found)) == sorted(map(key, wanted)) and found


def test_given_rows_are_made_once(spark):
    """What makes the rows of a change runs once, for the table and its index."""
    store, runs = made(spark, "once"), spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        runs.add(1)
        return text

    rows = chunk_rows(spark, [(f"c{i}", f"d{i}", f"w{i % 7} the") for i in range(30)])
    store.append(rows.withColumn("chunk_text", counted("chunk_text")))
    assert runs.value == 30
    named = spark.createDataFrame([(f"d{i}",) for i in range(10)], "document_id string")
    store.replace_documents(named, rows.where("id = 'c3'").withColumn("chunk_text", counted(F.lit("w1 new"))))
    assert runs.value == 31
    matches(spark, store, spark.createDataFrame([(1, "w1 the"), (2, "new")], "query_id int, query_text string"))


@pytest.mark.parametrize("bits", [1 << 27, 1 << 4])
def test_rows_of_many_keys_stay_where_they_are_read(spark, monkeypatch, bits):
    """Half of the rows are named, more than a broadcast holds; with few bits most of the others meet one by chance."""
    monkeypatch.setattr(skew, "KEY_ROWS", 30)
    monkeypatch.setattr(skew, "KEY_BITS", bits)
    path = work_path(spark, "keyed")
    ids = [None if i == 50 else f"d{i}" for i in range(100 if bits > 1 << 20 else 70)]
    spark.createDataFrame([(d, i) for i, d in enumerate(ids)], "document_id string, n int").write.parquet(path)
    rows, keys = spark.read.parquet(path), spark.createDataFrame([(f"d{i}",) for i in range(45)], "document_id string")
    mine = skew.with_keys(rows, keys)
    others, in_place = skew.less_keys(rows, keys)
    assert in_place and sorted(r.n for r in mine.collect()) == list(range(45))
    assert sorted(r.n for r in others.collect()) == list(range(45, len(ids)))
    # Where those that stay are few, they are sent out themselves.
    told = ["bitmap_construct_agg" in df._jdf.queryExecution().optimizedPlan().toString() for df in (mine, others)]
    assert told == [True, len(ids) == 100]


def test_a_sparse_left_join_is_a_left_join(spark):
    large = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d"), (3, "e")], "k int, text string")
    lookup = spark.createDataFrame([(1, 10), (1, 11), (3, None), (None, 12), (9, 13)], "k int, v int")
    found, wanted = skew.sparse_left_join(large, lookup, ["k"]), large.join(lookup, "k", "left")
    key = lambda r: tuple(map(str, r))
    assert found.columns == wanted.columns and sorted(found.collect(), key=key) == sorted(wanted.collect(), key=key)


def test_replaced_documents_beyond_a_broadcast(spark, monkeypatch):
    monkeypatch.setattr(skew, "KEY_ROWS", 3)
    monkeypatch.setattr(text_index, "KEY_ROWS", 3)
    monkeypatch.setattr(text_index, "BLOCK", 8)
    store, rng = made(spark, "many"), random.Random(8)
    store.append(chunk_rows(spark, [(f"c{i}", f"d{i}", prose(rng)) for i in range(60)]))
    named = spark.createDataFrame([(f"d{i}",) for i in range(25)], "document_id string")
    store.replace_documents(named, chunk_rows(spark, [(f"n{i}", f"d{i}", prose(rng)) for i in range(20)]))
    assert {r.id for r in store.read().collect()} == {f"n{i}" for i in range(20)} | {f"c{i}" for i in range(25, 60)}
    asked = spark.createDataFrame([(1, "w1 w2 the"), (2, "W3, w3 w4!"), (3, "the")], "query_id int, query_text string")
    matches(spark, store, asked)
    merged = store.words.merged(store.index_state())
    key = lambda r: (r.query_id, r.rank, r.id)
    found = [sorted(map(key, store.words.search(s, asked, 9).collect())) for s in (merged, store.index_state())]
    assert found[0] == found[1]
