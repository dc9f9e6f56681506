from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.completion import EchoModel
from lodestone.operators.embedding import HashEmbedder, Registry
from lodestone.plans import analytics
from lodestone.plans.catalog import Conflict
from lodestone.plans.workspace import Workspace
from lodestone.sources.remote import Fetched

NOW = datetime(2024, 1, 5, 10)


@pytest.fixture(scope="module")
def space(spark, tmp_path_factory):
    embedders, models = Registry(), Registry()
    embedders.register(HashEmbedder(64))
    models.register(EchoModel())
    space = Workspace(spark, str(tmp_path_factory.mktemp("ws")), embedders, models, ChunkConfig("auto", 500, 50), buckets=2)
    space.seed_prompts(NOW)
    space.create_collection("Docs", NOW)
    return space


def upload(spark, *rows):
    return spark.createDataFrame(
        [(u, "text/plain", bytearray(t.encode()), m) for u, t, m in rows], "file_uri string, mime_type string, content binary, metadata string"
    )


def test_everything_together(spark, space):
    slug = "docs_hash_embedder"
    with pytest.raises(Conflict):
        space.create_collection("Docs", NOW)
    space.register_fields(slug, [("category", "str")], NOW)
    files = upload(spark, ("upload://cats.txt", "Cats purr and sleep.", '{"category":"pets"}'), ("upload://cars.txt", "Engines burn fuel.", None))
    space.ingest(slug, files, NOW)
    assert space.list_documents(slug, status="complete").count() == 2

    hits = space.search(slug, "why cats purr", NOW).collect()
    assert hits[0].source_name == "cats" and hits[0].rrf_score > hits[1].rrf_score
    only = space.search(slug, "why cats purr", NOW, filters={"category": "pets"}, vector_search_only=True)
    assert [r.source_name for r in only.collect()] == ["cats"] and "rrf_score" not in only.columns
    done, chunks = space.rag(slug, "why cats purr", NOW, "concise_rag", top_k=1)
    assert done.first().answer.startswith("fake answer for: Answer in 2-3 sentences") and chunks.count() == 1

    events = space.events("query_events")
    volume = analytics.volume_over_time(space.events("ingestion_events"), events, NOW - timedelta(days=1))
    assert [tuple(r) for r in volume.collect()] == [("2024-01-05", "ingestion", 2), ("2024-01-05", "query", 2), ("2024-01-05", "rag", 1)]
    assert analytics.trace_drilldown(events, space.events("query_traces")).where("answer is not null").count() == 1

    cats = space.list_documents(slug).where("file_uri like '%cats%'").first()
    space.update_document(slug, cats.id, name="Felines", metadata='{"category":"animals"}')
    assert space.document_metadata(slug, cats.id).first().category == "animals"
    assert space.list_documents(slug, sort_by="name", sort_dir="asc").where("name = 'Felines'").count() == 1
    assert space.list_chunks(slug, cats.id).count() == 1
    space.delete_document(slug, cats.id)
    assert space.list_chunks(slug, cats.id).count() == 0 and space.list_documents(slug).count() == 1
    space.delete_field(slug, "category")
    with pytest.raises(ValueError):
        space.search(slug, "x", NOW, filters={"category": "pets"})
    job = space.list_jobs(slug, "complete").first()
    space.delete_job(job.id)
    assert space.list_jobs(slug).count() == 1


def test_refresh(spark, space):
    row = space.create_collection("Web", NOW)
    space.patch_collection(row.slug, refresh_enabled=True, refresh_interval_seconds=60)

    def get(version):
        def call(uri, etag, since):
            return Fetched(not_modified=True) if etag == version else Fetched(f"Page {version}.".encode(), etag=version)

        return call

    uris = spark.createDataFrame([("https://x/p", "text/plain")], "file_uri string, mime_type string")
    space.ingest(row.slug, uris, NOW, get=get("v1"))
    later = NOW + timedelta(hours=1)
    assert space.refresh(later, get("v1")) == 0
    assert space.refresh(later + timedelta(seconds=10), get("v2")) == 0  # not due yet
    assert space.refresh(later + timedelta(hours=1), get("v2")) == 1
    assert [r.chunk_text for r in space.store(row).read().collect()] == ["Page v2."]
    assert space.events("ingestion_events").where("intent = 'auto_refresh'").count() == 1
    space.delete_collection(row.slug)
    with pytest.raises(KeyError):
        space.collection(row.slug)
    assert space.list_documents().where(F.col("collection_id") == row.id).count() == 0


def test_prompts_and_keys(space):
    space.create_prompt("My Prompt", "{{context}}", NOW)
    space.update_prompt("my_prompt", NOW + timedelta(days=1), name="Other Prompt")
    assert [r.slug for r in space.list_prompts().collect()] == ["other_prompt"]
    with pytest.raises(PermissionError):
        space.delete_prompt("basic_rag")
    space.delete_prompt("other_prompt")
    assert space.list_prompts().count() == 0
    reader = space.create_key("r", NOW, [("c1", "read")])
    master = space.create_key("m", NOW, [(None, "both")], [("*", "both")])
    checks = [(reader, "c1", "read"), (reader, "c1", "write"), (reader, "c2", "read"), (master, "c2", "write"), ("rp_x", "c1", "read")]
    assert [space.may(*c) for c in checks] == [True, False, False, True, False]
    space.delete_key(space.key(reader).id)
    assert not space.may(reader, "c1", "read")


def test_refusals_failures_and_timings_are_events(spark, space):
    row = space.create_collection("Guarded", NOW)
    files = spark.createDataFrame(
        [("file:///etc/passwd", "text/plain", None), ("upload://a.exe", "text/plain", bytearray(b"x")),
         ("upload://ok.txt", "text/plain", bytearray(b"Cats purr.")), ("https://x/down", "text/html", None)],
        "file_uri string, mime_type string, content binary",
    )

    def down(uri, etag, since):
        return Fetched(error="unexpected status 500")

    space.ingest(row.slug, files, NOW, get=down)
    events = {r.file_uri: r for r in space.events("ingestion_events").where(F.col("collection_id") == row.id).collect()}
    assert {u: r.status for u, r in events.items()} == {
        "file:///etc/passwd": "failed", "upload://a.exe": "failed", "upload://ok.txt": "complete", "https://x/down": "failed"
    }
    assert events["https://x/down"].error == "unexpected status 500" and events["upload://ok.txt"].total_ms > 0
    assert space.list_jobs(row.slug).count() == 2

    space.search(row.slug, "purr", NOW)
    with pytest.raises(ValueError):
        space.search(row.slug, "purr", NOW, filters={"nothing": 1})
    asked = space.events("query_events").where(F.col("collection_id") == row.id).collect()
    assert sorted(r.status for r in asked) == ["complete", "failed"]
    assert all(r.total_ms > 0 for r in asked if r.status == "complete") and any("nothing" in (r.error or "") for r in asked)


def test_a_key_that_cannot_be_stored_leaves_no_grants(space):
    space.create_key("first", NOW, [("c9", "read")], plaintext="rp_same")
    before = space.rows("key_grants").count()
    with pytest.raises(Conflict):
        space.create_key("second", NOW, [("c1", "read")], plaintext="rp_same")
    assert space.rows("key_grants").count() == before


def test_first_key_and_types_that_servers_tell(spark, tmp_path):
    embedders = Registry()
    embedders.register(HashEmbedder(16))
    space = Workspace(spark, str(tmp_path / "ws"), embedders, Registry(), ChunkConfig("auto", 200, 20), buckets=2)
    plaintext = space.first_key(NOW)
    assert (tmp_path / "ws" / "api_key").read_text() == plaintext + "\n"
    assert space.may(plaintext, "any collection", "write") and space.first_key(NOW) is None
    space.create_collection("Web", NOW)
    files = spark.createDataFrame([("http://h/page", None), ("http://h/b.md", None), ("http://h/none", ""), ("http://h/c.txt", "text/plain")], "file_uri string, mime_type string")
    told = {"http://h/page": "text/html; charset=utf-8"}
    get = lambda uri, etag, since: Fetched(b"<p>One page.</p>" if uri.endswith("page") else b"# Title\n\nText.")
    space.ingest("web_hash_embedder", files, NOW, get=get, head=told.get)
    kinds = {r.file_uri: (r.mime_type, r.status) for r in space.list_documents("web_hash_embedder").collect()}
    assert kinds["http://h/page"][0].startswith("text/html") and kinds["http://h/b.md"][0] == "text/markdown"
    assert kinds["http://h/page"][1] == "complete" and kinds["http://h/c.txt"] == ("text/plain", "complete")
    events = {r.file_uri: r.fetch_ms for r in space.events("ingestion_events").collect()}
    assert all(ms is not None and ms < 5000 for ms in events.values())
