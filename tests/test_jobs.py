from datetime import datetime

from pyspark.sql import functions as F

from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.completion import EchoModel
from lodestone.operators.embedding import HashEmbedder
from lodestone.plans import catalog as plan
from lodestone.plans.events import query_events, query_traces
from lodestone.plans.ingest import Collection
from lodestone.plans.jobs import HELD, Catalog, run_jobs
from lodestone.plans.rag import answer
from lodestone.plans.retrieval import SearchRequest, search
from lodestone.schemas import METADATA_FIELDS
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.remote import Fetched
from lodestone.sources.telemetry import append_events, read_events

NOW = datetime(2024, 1, 5)
COL = Collection("c", "c_hash", ChunkConfig("auto", 200, 20))


def files(spark, *uris):
    return spark.createDataFrame([("c", u, "text/plain") for u in uris], "collection_id string, file_uri string, mime_type string")


def test_job_lifecycle(spark, tmp_path):
    def get(uri, etag, since):
        if "down" in uri:
            return Fetched(error="unexpected status 500")
        return Fetched(f"Text of {uri}".encode(), etag="v1")

    catalog = Catalog.open(spark, str(tmp_path / "catalog"), 2)
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c", 2)
    stamp = F.lit(NOW).cast("timestamp")
    uris = ["https://x/a", "https://x/down", "upload://u.txt"]
    assert catalog.submit(plan.new_jobs(files(spark, *uris), "ingest", stamp)) == 3
    uploads = spark.createDataFrame([("upload://u.txt", bytearray(b"Uploaded."))], "file_uri string, content binary")
    run_jobs(catalog, store, COL, HashEmbedder(), NOW, uploads, get)

    jobs = {r.file_uri: r for r in catalog.jobs.read().collect()}
    docs = {r.file_uri: r for r in catalog.documents.read().collect()}
    assert [jobs[u].status for u in uris] == [docs[u].status for u in uris] == ["complete", "failed", "complete"]
    assert jobs[uris[1]].error == "unexpected status 500" and jobs[uris[0]].executed_at == NOW
    assert (docs[uris[0]].last_etag, docs[uris[0]]["name"], docs[uris[0]].chunk_count) == ("v1", "Text of https://x/a", 1)
    assert {r.chunk_text for r in store.read().collect()} == {"Text of https://x/a", "Uploaded."}

    # Complete documents are skipped, failed ones tried again, the others are left alone.
    assert catalog.submit(plan.new_jobs(files(spark, *uris), "ingest", stamp)) == 1
    assert catalog.submit(plan.new_jobs(files(spark, uris[0], uris[0]), "refresh", stamp)) == 2
    report = run_jobs(catalog, store, COL, HashEmbedder(), NOW, None, get)
    assert [(r.reused_chunks, r.status) for r in report.documents.collect()] == [(1, "complete")]
    errors = sorted(r.error for r in catalog.jobs.read().where("error is not null").collect())
    assert errors == [HELD, "unexpected status 500", "unexpected status 500"]
    assert catalog.documents.read().count() == 3
    assert catalog.jobs.read().where("status in ('pending', 'processing')").count() == 0


def test_fields_and_slots(spark, tmp_path):
    store = ChunkStore(spark, str(tmp_path / "chunks"), "c", 2)
    store.create()
    empty = spark.createDataFrame([], ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in METADATA_FIELDS.fields))
    fields, added = plan.register_fields(empty, "c", [("topic", "str")], NOW)
    store.index_slot(added[0].column)
    fields, freed = plan.delete_field(fields, "c", "topic")
    assert freed == added[0] and fields.count() == 0 and store.indexed == {"metadata_str_1"}
    store.drop_slot(freed.column)
    assert not store.indexed


def test_query_events(spark, tmp_path):
    chunks = spark.createDataFrame(
        [("a", [1.0, 0.0], "alpha", None, "s1")], "id string, vector array<float>, chunk_text string, chunk_header string, source_name string"
    )
    hits = search(chunks, "alpha", [1.0, 0.0], SearchRequest(top_k=2)).cache()
    asked = spark.createDataFrame([(0, "Why?"), (1, "Else?")], "query_id int, query_text string")
    done = answer(asked, hits, "{{context}} {{question}}", EchoModel()).withColumn("event_id", F.concat(F.lit("e"), "query_id"))
    done = done.withColumn("error", F.when(F.col("query_id") == 1, "LLM call failed")).withColumn("occurred_at", F.lit(NOW))
    events = query_events(done, hits, SearchRequest(top_k=2), COL, "rag", "hash-embedder", ["mock-llm"])
    append_events(events, str(tmp_path), "query_events")
    append_events(query_traces(done, hits), str(tmp_path), "query_traces")
    rows = {r.event_id: r for r in read_events(spark, str(tmp_path), "query_events").collect()}
    assert (rows["e0"].status, rows["e0"].llm_cost_usd, rows["e0"].result_count, rows["e0"].origin) == ("complete", 0.0, 1, "admin")
    assert rows["e0"].results[0].similarity == 100.0 and rows["e0"].hybrid_settings.full_text_limit == 200
    assert (rows["e1"].status, rows["e1"].llm_cost_usd, rows["e1"].results) == ("failed", None, [])
    traces = {r.event_id: r for r in read_events(spark, str(tmp_path), "query_traces").collect()}
    assert traces["e0"].chunks[0].chunk_text == "alpha" and traces["e0"].answer.startswith("fake answer for: ")
