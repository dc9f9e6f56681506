import random
import string
from dataclasses import dataclass
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.functions.metadata import MetadataField
from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.embedding import HashEmbedder, HttpEmbedder, Registry, embed_column, fnv1a_32
from lodestone.operators.reuse import with_stored_vectors
from lodestone.operators.skew import without_keys
from lodestone.plans.catalog import consistent_metadata
from lodestone.plans.ingest import Collection, ingest, patch_document
from lodestone.plans.retrieval import SearchRequest, result_items, search
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.snapshots import WriteConflict
from lodestone.sources.telemetry import append_events, read_events

NOW = datetime(2024, 1, 5, tzinfo=timezone.utc)
FIELDS = (MetadataField("category", "str", 1), MetadataField("year", "num", 1), MetadataField("seen", "date", 1))
COL = Collection("c1", "docs_hash", ChunkConfig("auto", 60, 10), FIELDS)
PARAGRAPHS = [f"Paragraph {i} talks about topic{i} at some length here." for i in range(6)]


def frame(spark, docs):
    rows = [(d, f"upload://{d}.txt", "text/plain", bytearray(t.encode()), m) for d, t, m in docs]
    return spark.createDataFrame(rows, "document_id string, file_uri string, mime_type string, content binary, metadata string")


def status(report):
    return {r.document_id: r for r in report.documents.collect()}


def test_incremental_ingest(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=4)
    text = "\n\n".join(PARAGRAPHS)
    docs = [("a", text, '{"category":"ml","year":"2024","seen":"2024-01-02","x":1}'), ("b", "Short note.", None)]
    first = status(ingest(frame(spark, docs), store, COL, HashEmbedder(), NOW))
    assert first["a"].status == "complete" and first["a"].reused_chunks == 0
    n = first["a"].chunk_count
    assert n > 1 and store.read().count() == n + 1
    assert first["a"]["name"] == PARAGRAPHS[0]
    row = store.read().where("document_id = 'a'").first()
    assert (row.metadata_str_1, row.metadata_num_1, row.metadata_date_1, row.source_name) == ("ml", 2024.0, 1704153600, "a")
    assert abs(sum(x * x for x in row.vector) - 1) < 1e-5

    again = status(ingest(frame(spark, docs[:1]), store, COL, HashEmbedder(), NOW, "refresh"))
    assert (again["a"].reused_chunks, again["a"].stale_chunks, again["a"].chunk_count) == (n, 0, n)
    assert store.read().count() == n + 1

    changed = text.replace("topic5", "topic55")
    report = ingest(frame(spark, [("a", changed, None)]), store, COL, HashEmbedder(), NOW, "refresh")
    after = status(report)["a"]
    assert 0 < after.reused_chunks < n and after.stale_chunks > 0
    assert store.read().where("chunk_text like '%topic5 %'").count() == 0
    event = report.events.first()
    assert (event.intent, event.status, event.embed_cost_usd, event.embed_tokens) == ("refresh", "complete", 0.0, None)
    append_events(report.events, str(tmp_path / "telemetry"), "ingestion_events")
    assert read_events(spark, str(tmp_path / "telemetry"), "ingestion_events", NOW).count() == 1


def test_broken_document_fails_alone(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=2)
    good = frame(spark, [("a", "fine", None)])
    ingest(good, store, COL, HashEmbedder(), NOW)
    bad = frame(spark, [("a", "{broken", None)]).withColumn("mime_type", F.lit("application/json"))
    report = status(ingest(bad.unionByName(frame(spark, [("b", "new", None)])), store, COL, HashEmbedder(), NOW))
    assert report["a"].status == "failed" and report["b"].status == "complete"
    assert {r.document_id: r.chunk_text for r in store.read().collect()} == {"a": "fine", "b": "new"}


def test_search_over_ingested_documents(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=2)
    docs = [("cats", "Cats purr and sleep all day.", '{"category":"pets"}'), ("cars", "Engines burn fuel on roads.", '{"category":"ml"}')]
    ingest(frame(spark, docs), store, COL, HashEmbedder(), NOW)
    vector = HashEmbedder().embed(["why do cats purr"])[0][0]
    hits = result_items(search(store.read(), "why do cats purr", vector, SearchRequest()), FIELDS).collect()
    assert hits[0].source == "cats" and hits[0].rrf_score > hits[1].rrf_score
    assert hits[0].rrf_score_normalized == 100.0 and hits[0].metadata == '{"category":"pets"}'
    request = SearchRequest(vector_search_only=True, filters={"category": "ml"}, fields=FIELDS)
    only = search(store.read(), "why do cats purr", vector, request)
    assert [r.source_name for r in only.collect()] == ["cars"] and "rrf_score" not in only.columns


def test_store_mutations(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=4)
    store.create()
    assert store.read().count() == 0
    ingest(frame(spark, [("a", "one", '{"category":"x"}'), ("b", "two", '{"category":"y"}')]), store, COL, HashEmbedder(), NOW)
    patch_document(store, "a", FIELDS, '{"category":"z","year":"no"}', '{"k":1}')
    got = {r.document_id: r for r in store.read().collect()}
    assert (got["a"].metadata_str_1, got["a"].metadata_num_1, got["a"].extra_json) == ("z", None, '{"k":1}')
    assert (got["b"].metadata_str_1, got["b"].extra_json) == ("y", None)
    assert consistent_metadata(store.read(), FIELDS).where("document_id = 'a'").first().category == "z"
    patch_document(store, "a", FIELDS, extra_json="")
    assert store.read().where("extra_json is not null").count() == 0
    store.null_slot("metadata_str_1")
    assert store.read().where("metadata_str_1 is not null").count() == 0
    before = store.manifest()
    store.compact()
    store.delete_chunks(store.read().where("document_id = 'b'").select("document_id", "id"))
    store.delete_documents(spark.createDataFrame([("zzz",)], "document_id string"))
    assert [r.document_id for r in store.read().collect()] == ["a"]
    with pytest.raises(WriteConflict):
        store.commit(store.read(), None, before)
    assert store.vacuum() and store.read().count() == 1


def test_migrations(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=2)
    ingest(frame(spark, [("a", "one", None)]), store, COL, HashEmbedder(), NOW)
    steps = {1: None, 2: lambda rows: rows.withColumn("external_id", F.lit("e"))}
    assert store.migrate(steps) == 2 and store.migrate(steps) == 2
    assert store.read().first().external_id == "e"
    with pytest.raises(ValueError):
        store.migrate({1: None, 3: None})


def test_embedders(spark):
    assert fnv1a_32("") == 0x811C9DC5 and fnv1a_32("a") == 0xE40C292C
    v = HashEmbedder(8).embed(["a A b"])[0][0]
    assert sum(v) == 3 and v[0xE40C292C % 8] >= 2
    calls = []

    def post(url, body, headers):
        calls.append(body)
        data = [{"index": i, "embedding": [float(i)]} for i in range(len(body["input"]))]
        return {"data": data[::-1], "usage": {"total_tokens": 9}}

    openai = HttpEmbedder("openai", "http://x", "m", 1, "k", post=post)
    assert openai.embed(["x", "y"]) == ([[0.0], [1.0]], 9)
    short = HttpEmbedder("ollama", "http://x", "m", 1, post=lambda *a: {"embeddings": []})
    with pytest.raises(RuntimeError):
        short.embed(["x"])
    df = spark.createDataFrame([("w",), (None,), ("w w",)], "t string").coalesce(1)
    out = [r.e for r in df.select(embed_column(F.col("t"), HashEmbedder(4)).alias("e")).collect()]
    assert out[1] is None and sum(out[2].vector) == 2
    registry = Registry()
    registry.register(HashEmbedder())
    assert registry.get().model == "hash-embedder" and registry.local_models() == ["hash-embedder"]
    with pytest.raises(KeyError):
        registry.get("other")


def _shuffled(spark) -> int:
    """Bytes that the stages so far have written for shuffles."""
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _random_docs(spark, n, size, seed):
    rng = random.Random(seed)
    return frame(spark, [(f"d{i}", "".join(rng.choices(string.ascii_letters + string.digits, k=size)), None) for i in range(n)])


def test_an_ingest_shuffles_its_texts_once(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=2)
    target = Collection("c1", "docs", ChunkConfig("sliding_window", 500, 0))
    docs, texts = _random_docs(spark, 40, 20_000, 1), 40 * 20_000
    for intent in ("ingest", "refresh"):
        before = _shuffled(spark)
        report = ingest(docs, store, target, HashEmbedder(4), NOW, intent)
        assert 0.5 * texts < _shuffled(spark) - before < 1.6 * texts
    assert {(r.chunk_count, r.reused_chunks, r.stale_chunks) for r in report.documents.collect()} == {(40, 40, 0)}
    assert store.read().count() == store.read().select("id").distinct().count() == 40 * 40


def test_many_documents_replaced_and_refused(spark, tmp_path, monkeypatch):
    """No list of keys fits a broadcast here, as with millions of documents."""

    # Defined here, so that tasks get it by value.
    @dataclass(frozen=True)
    class Choosy(HashEmbedder):
        def embed(self, texts):
            if any("@" in t for t in texts):
                raise ValueError("refused")
            return super().embed(texts)

    monkeypatch.setattr("lodestone.operators.skew.KEY_ROWS", 0)
    monkeypatch.setattr("lodestone.plans.ingest.KEY_ROWS", 0)
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=2)
    target = Collection("c1", "docs", ChunkConfig("sliding_window", 40, 0))
    ingest(frame(spark, [(f"d{i}", f"old {i}. " * 20, None) for i in range(12)]), store, target, HashEmbedder(4), NOW)
    old = {r.id for r in store.read().collect()}
    changed = frame(spark, [(f"d{i}", f"new {i}{'@' if i % 4 == 0 else '.'} " * 20, None) for i in range(8)])
    report = status(ingest(changed, store, target, Choosy(4), NOW, "refresh"))
    assert {d for d, r in report.items() if r.status == "failed"} == {"d0", "d4"}
    rows = store.read().collect()
    assert {r.document_id for r in rows if r.chunk_text.startswith("old")} == {"d0", "d4", "d8", "d9", "d10", "d11"}
    assert len({r.document_id for r in rows}) == 12 and {r.id for r in rows if r.document_id in ("d0", "d9")} <= old
    assert all("@" not in r.chunk_text for r in rows)
    counts = {d: sum(r.document_id == d for r in rows) for d in report}
    assert all(report[d].chunk_count == counts[d] for d in report if report[d].status == "complete")


def test_rows_without_many_keys_stay_in_their_tasks(spark, monkeypatch):
    monkeypatch.setattr("lodestone.operators.skew.KEY_ROWS", 5)
    rows = spark.range(20).selectExpr("cast(id as string) as document_id", "id")
    for dropped, in_place in ((range(3), True), (range(17), True), (range(20), True), (range(10), False)):
        kept, stayed = without_keys(rows, spark.createDataFrame([(str(i),) for i in dropped], "document_id string"))
        assert stayed is in_place and sorted(r.id for r in kept.collect()) == [i for i in range(20) if i not in dropped]


def test_a_task_takes_one_deal(spark):
    rows = spark.range(960).selectExpr("cast(id % 16 as int) as _deal", "cast(id as string) as document_id", "cast(id as string) as chunk_hash")
    stored = rows.where("_deal % 3 = 0").withColumn("vector", F.array(F.lit(1.0).cast("float")))
    matched = with_stored_vectors(rows, stored, F.col("document_id"), "_deal", 16)
    tasks = matched.groupBy(F.spark_partition_id().alias("task")).agg(F.count_distinct("_deal").alias("deals"), F.count("stored_vector").alias("known")).collect()
    assert len(tasks) == 16 and {r.deals for r in tasks} == {1} and sum(r.known for r in tasks) == stored.count()


def test_staged_rows_are_not_sorted(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c1", buckets=4)
    named = spark.range(400).select(F.col("id").cast("string").alias("document_id"))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in store.schema.fields if f.name != "document_id"]
    held = spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")
    staged = store.stage(named.select("document_id", *blank), dealt=True)
    plans = spark._jsparkSession.sharedState().statusStore().executionsList()
    plan = plans.apply(plans.size() - 1).physicalPlanDescription()
    assert "InsertIntoHadoopFsRelationCommand" in plan and "Sort" not in plan
    assert store.read_staged(staged).select("document_id").distinct().count() == 400
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == held
