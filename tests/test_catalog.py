from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lodestone.plans import catalog
from lodestone.schemas import DOCUMENTS, KEY_GRANTS, METADATA_FIELDS, PROMPTS
from lodestone.sources.snapshots import SnapshotTable

NOW = datetime(2024, 1, 5)


def rows_of(spark, schema, values):
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields]
    return spark.createDataFrame([tuple(v.get(f) for f in schema.fieldNames()) for v in values], ", ".join(fields))


def test_page_bounds():
    cases = {(None, None): (50, 0), ("10", "5"): (10, 5), ("0", "-1"): (50, 0), ("9999", "x"): (500, 0), ("x", "3"): (50, 3)}
    assert {k: catalog.page_bounds(*k) for k in cases} == cases


def test_documents(spark):
    docs = rows_of(spark, DOCUMENTS, [
        {"id": str(i), "collection_id": "c", "file_uri": f"u{i % 2}", "status": "complete" if i else "ingesting", "name": f"n{9 - i}",
         "created_at": NOW + timedelta(days=i), "updated_at": NOW - timedelta(days=i)} for i in range(5)
    ])
    assert [r.id for r in catalog.list_documents(docs, limit=2).collect()] == ["0", "1"]
    assert [r.id for r in catalog.list_documents(docs, "name", "asc", 2, 1).collect()] == ["3", "2"]
    assert catalog.list_documents(docs, status="failed").count() == 0
    assert sorted(r.id for r in catalog.latest_by_uri(docs).collect()) == ["3", "4"]
    claimed = catalog.claim_document(docs, "1", "j9", NOW).where("id = '1'").first()
    assert (claimed.status, claimed.job_id, claimed.chunk_count, claimed.error) == ("ingesting", "j9", 0, None)
    for held in ("0", "missing"):
        with pytest.raises(catalog.Conflict):
            catalog.claim_document(docs, held, "j", NOW)
    jobs = catalog.new_jobs(docs.select("collection_id", "file_uri", "mime_type").distinct(), "ingest", F.lit(NOW))
    assert catalog.skip_completed(jobs, docs).count() == 0
    again = catalog.new_jobs(docs.select("collection_id", "file_uri", "mime_type").distinct(), "refresh", F.lit(NOW))
    assert catalog.skip_completed(again, docs).count() == 2
    assert catalog.may_delete_job("complete") and not catalog.may_delete_job("processing")


def test_collections(spark):
    row = catalog.new_collection(spark, "0123456789", "My Docs!", "text-embedding-3-small", 8, NOW, chunk_size=500).first()
    assert (row.slug, row.table_name, row.chunk_size) == ("my_docs_text_embedding_3_small", "my_docs_01234567", 500)
    for bad in ({"chunk_size": 50}, {"chunk_overlap": 2000}):
        with pytest.raises(ValueError):
            catalog.new_collection(spark, "1", "n", "m", 8, NOW, **bad)
    twice = catalog.new_collection(spark, "1", "n", "m", 8, NOW).unionByName(catalog.new_collection(spark, "2", "n", "m", 8, NOW))
    with pytest.raises(catalog.Conflict):
        catalog.check_unique(twice, ["name", "embed_model"])


def test_prompts(spark):
    prompts = catalog.seed_prompts(rows_of(spark, PROMPTS, []), NOW)
    later = catalog.seed_prompts(prompts, NOW + timedelta(days=1))
    assert sorted(r.slug for r in later.collect()) == ["basic_rag", "concise_rag", "rag_with_citations"]
    assert {r.updated_at for r in later.collect()} == {NOW} and catalog.editable_prompts(later).count() == 0
    edited = later.withColumn("content", F.when(F.col("slug") == "basic_rag", "x").otherwise(F.col("content")))
    restored = {r.slug: r for r in catalog.seed_prompts(edited, NOW + timedelta(days=2)).collect()}
    assert restored["basic_rag"].updated_at > NOW and restored["concise_rag"].updated_at == NOW


def test_keys(spark):
    plaintext, key, own, admin = catalog.new_api_key(spark, "k1", "ci", NOW, [(None, "read")], [("*", "both")])
    assert plaintext.startswith("rp_") and len(plaintext) == 67
    assert catalog.validate_key(key, plaintext).count() == 1 and catalog.validate_key(key, "rp_x").count() == 0
    assert key.first().key_hint == plaintext[-4:] and own.count() == admin.count() == 1
    with pytest.raises(ValueError):
        catalog.new_api_key(spark, "k", "n", NOW)
    with pytest.raises(ValueError):
        catalog.new_api_key(spark, "k", "n", NOW, [(None, "admin")])


@pytest.mark.parametrize(
    "grants,required,expected",
    [
        ([], "read", False),
        ([("c1", "read")], "read", True),
        ([("c2", "read")], "read", False),
        ([(None, "read")], "read", True),
        ([("c1", "read")], "write", False),
        ([("c1", "both")], "write", True),
        ([("c1", "read"), ("c1", "write")], "both", False),
        ([("c1", "both")], "both", True),
        ([(None, "write"), ("c2", "both")], "read", False),
    ],
)
def test_collection_access(spark, grants, required, expected):
    stored = rows_of(spark, KEY_GRANTS, [{"api_key_id": "k", "collection_id": c, "permission": p} for c, p in grants])
    asked = spark.createDataFrame([("k", "c1", required)], "api_key_id string, collection_id string, required string")
    assert (catalog.allowed_requests(asked, stored).count() == 1) == expected


def test_admin_access(spark):
    grants = spark.createDataFrame([("k", "keys", "read"), ("s", "*", "both")], "api_key_id string, resource_type string, permission string")
    asked = spark.createDataFrame(
        [("k", "keys", "read"), ("k", "keys", "write"), ("k", "prompts", "read"), ("s", "prompts", "write"), ("x", "keys", "read")],
        "api_key_id string, resource_type string, required string",
    )
    assert sorted(tuple(r) for r in catalog.allowed_admin(asked, grants).collect()) == [("k", "keys", "read"), ("s", "prompts", "write")]


def test_register_fields(spark):
    fields = rows_of(spark, METADATA_FIELDS, [])
    fields, added = catalog.register_fields(fields, "c", [("a", "str"), ("b", "str"), ("n", "num")], NOW)
    assert [(f.name, f.column) for f in added] == [("a", "metadata_str_1"), ("b", "metadata_str_2"), ("n", "metadata_num_1")]
    fields = fields.where("name <> 'a'")
    fields, added = catalog.register_fields(fields, "c", [("z", "str")], NOW)
    assert added[0].slot == 1 and [f.name for f in catalog.collection_fields(fields, "c")] == ["n", "z", "b"]
    for bad in ([("B", "num")], [("q", "num"), ("Q", "str")], [(f"f{i}", "bool") for i in range(11)]):
        with pytest.raises(catalog.Conflict):
            catalog.register_fields(fields, "c", bad, NOW)
    for bad in ([], [("mime_type", "str")], [("x" * 65, "str")], [("x", "text")]):
        with pytest.raises(ValueError):
            catalog.register_fields(fields, "c", bad, NOW)


def test_snapshot_table_round_trip(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "prompts"), PROMPTS)
    table.commit(catalog.seed_prompts(table.read(), NOW))
    table.commit(table.read().where("slug <> 'basic_rag'"))
    assert table.read().count() == 2 and table.manifest().version == 2
    table.drop()
    assert table.read().count() == 0
