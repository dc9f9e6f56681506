import time
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import functions as F

from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.embedding import HashEmbedder
from lodestone.plans.catalog import new_jobs
from lodestone.plans.ingest import Collection
from lodestone.plans.jobs import Catalog
from lodestone.schemas import COLLECTIONS, DOCUMENTS
from lodestone.sources.chunk_store import ChunkStore
from lodestone.sources.evalsets import read_beir, read_squad
from lodestone.sources.landing import allowed_scheme, detect_mime, read_landing, stream_landing, upload_error
from lodestone.session import clean_work, work_path
from lodestone.sources.remote import Fetched, answered, fetch, fetch_any, fetch_local, probe_types
from lodestone.sources.telemetry import read_events
from lodestone.streaming.ingest import start_ingest
from lodestone.streaming.jobs import accepted, start_submissions
from lodestone.streaming.refresh import refresh_sweep
from lodestone.streaming.timers import due_checks, use_timers

NOW = datetime(2024, 1, 5, 12)


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "v string").select(fn(F.col("v")).alias("x")).first().x


def test_mime_detection(spark):
    cases = {
        "s3://b/a.PDF": "application/pdf",
        "https://x.org/a.md?v=1.txt": "text/markdown",
        "https://x.org/page": "text/html",
        "s3://b/unknown": "text/plain",
        "upload://d.json": "application/json",
    }
    assert {u: one(spark, u, detect_mime) for u in cases} == cases
    assert one(spark, "https://x.org/p", lambda u: detect_mime(u, F.lit("text/csv; charset=utf-8"))) == "text/csv"


def test_type_probing(spark):
    def head(uri):
        if "down" in uri:
            raise OSError("no route")
        return "application/pdf; charset=binary"

    uris = ["https://x/paper", "https://x/down", "https://x/a.md", "s3://b/k"]
    df = spark.createDataFrame([(u,) for u in uris], "file_uri string")
    got = {r.file_uri: r.mime_type for r in probe_types(df, head).collect()}
    assert [got[u] for u in uris] == ["application/pdf", "text/html", "text/markdown", "text/plain"]


def test_work_tables_are_cleaned(spark):
    path = work_path(spark, "scrap")
    spark.range(1).write.parquet(path)
    assert clean_work(spark, 1.0, "scrap") == 0 and spark.read.parquet(path).count() == 1
    assert clean_work(spark, -1.0, "scrap") == 1


def test_allow_lists(spark):
    assert one(spark, "a.exe", lambda n: upload_error(n, F.lit("text/plain"))) == "no reader for the extension .exe"
    assert one(spark, "a.txt", lambda n: upload_error(n, F.lit("image/png"))) == "no reader for the type image/png"
    assert one(spark, "noext", lambda n: upload_error(n, F.lit("text/html; charset=x"))) is None
    assert one(spark, "a.txt", lambda n: upload_error(n, F.lit("text/plain"), F.lit(21 * 1024 * 1024))) == "the file is larger than an upload may be"
    assert [one(spark, u, allowed_scheme) for u in ("HTTPS://x", "s3://b/k", "file:///etc/passwd")] == [True, True, False]


def test_landing_and_stream(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.txt").write_text("Alpha paragraph.\n\nSecond one.")
    (box / "b.md").write_text("# T\nbody")
    (box / "c.exe").write_bytes(b"x")
    rows = {r.file_uri: r for r in read_landing(spark, str(box)).collect()}
    assert rows["upload://c.exe"].refused and rows["upload://c.exe"].content is None
    assert rows["upload://b.md"].mime_type == "text/markdown"

    store = ChunkStore(spark, str(tmp_path / "chunks"), "c", buckets=2)
    target = Collection("c", "c_hash", ChunkConfig("auto", 200, 20))

    def drain():
        uploads = stream_landing(spark, str(box))
        events = str(tmp_path / "events")
        start_ingest(uploads, store, target, HashEmbedder(), str(tmp_path / "cp"), events, once=True).awaitTermination()
        return sorted((r.source_name, r.chunk_text) for r in store.read().collect())

    assert drain() == [("a", "Alpha paragraph.\nSecond one."), ("b", "body")]
    (box / "@2").mkdir()
    (box / "@2" / "a.txt").write_text("Changed.")
    assert drain() == [("a", "Changed."), ("b", "body")]
    events = read_events(spark, str(tmp_path / "events"), "ingestion_events")
    assert events.where("status = 'complete'").count() == 3
    lost = events.where("status = 'failed'").collect()
    assert [(r.file_uri, r.error) for r in lost] == [("upload://c.exe", "no reader for the extension .exe")]


def test_files_of_one_name_in_two_folders(spark, tmp_path):
    for folder in ("a", "b/c", "@7/a"):
        (tmp_path / folder).mkdir(parents=True)
        (tmp_path / folder / "readme.md").write_text(folder)
    uris = sorted(r.file_uri for r in read_landing(spark, f"file://{tmp_path}").select("file_uri").collect())
    assert uris == ["upload://a/readme.md", "upload://a/readme.md", "upload://b/c/readme.md"]


def test_fetch_isolates_errors(spark, tmp_path):
    (tmp_path / "f.txt").write_text("hi")
    df = spark.createDataFrame([(str(tmp_path / "f.txt"),), (str(tmp_path / "missing"),), ("upload://x",)], "file_uri string")
    local = [r.fetched for r in fetch(df, fetch_local).collect()]
    assert bytes(local[0].content) == b"hi" and local[1].error.startswith("fetch:")
    got = [r.fetched for r in fetch(df, fetch_any).collect()]
    assert got[0].content is None and "only http" in got[0].error and got[1].error.startswith("fetch:") and "upload the file once more" in got[2].error


def rows_of(spark, schema, values):
    fields = [f"{f.name} {f.dataType.simpleString()}" for f in schema.fields]
    return spark.createDataFrame([tuple(v.get(f) for f in schema.fieldNames()) for v in values], ", ".join(fields))


def test_refresh_sweep(spark):
    base = {"slug": "s", "refresh_enabled": True, "refresh_interval_seconds": 3600}
    collections = rows_of(spark, COLLECTIONS, [
        {"id": "due", **base}, {"id": "fresh", **base, "last_auto_refresh_at": NOW}, {"id": "off", **base, "refresh_enabled": False},
    ])
    documents = rows_of(spark, DOCUMENTS, [
        {"id": "1", "collection_id": "due", "file_uri": "https://x/same", "mime_type": "text/html", "last_etag": "v1"},
        {"id": "2", "collection_id": "due", "file_uri": "https://x/new", "mime_type": "text/html", "last_etag": "v0"},
        {"id": "3", "collection_id": "due", "file_uri": "https://x/down", "mime_type": "text/html"},
        {"id": "4", "collection_id": "due", "file_uri": "upload://x", "mime_type": "text/plain"},
        {"id": "5", "collection_id": "fresh", "file_uri": "https://x/new", "mime_type": "text/html"},
    ])

    def get(uri, etag, since):
        if uri.endswith("down"):
            raise OSError("no route")
        return Fetched(not_modified=True) if etag == "v1" else Fetched(b"<p>new</p>", etag="v1")

    sweep = refresh_sweep(collections, documents, NOW, get)
    assert [(r.id, r.new_etag, bytes(r.content)) for r in sweep.changed.collect()] == [("2", "v1", b"<p>new</p>")]
    job = sweep.jobs.first()
    assert (job.intent, job.status, job.display_name) == ("auto_refresh", "pending", "new")
    stamps = {r.id: r.last_auto_refresh_at for r in sweep.collections.collect()}
    assert stamps == {"due": NOW, "fresh": NOW, "off": None}


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "qrels").mkdir()
    (tmp_path / "corpus.jsonl").write_text('{"_id":"d1","title":"T","text":"body"}\n')
    (tmp_path / "queries.jsonl").write_text('{"_id":"q1","text":"what"}\n')
    (tmp_path / "qrels" / "test.tsv").write_text("query-id\tcorpus-id\tscore\nq1\td1\t1\n")
    corpus, queries, judged = read_beir(spark, str(tmp_path))
    assert corpus.first().content == "T\n\nbody" and queries.first().query_text == "what"
    assert tuple(judged.first()) == ("q1", "d1", 1)
    (tmp_path / "squad.json").write_text(
        '{"data":[{"title":"A B!","paragraphs":[{"context":"c0","qas":[]},{"context":"c1","qas":['
        '{"question":"q","is_impossible":false,"answers":[{"text":"a"},{"text":"b"}]},'
        '{"question":"no","is_impossible":true,"answers":[]},{"question":"none","answers":[]}]}]}]}'
    )
    assert [tuple(r) for r in read_squad(spark, str(tmp_path / "squad.json")).collect()] == [("a_b_1", "c1", "q", "a")]


def test_bodies_leave_a_task_before_the_next_ones_come():
    kinds = [("id", pa.int64()), ("u", pa.string()), ("e", pa.string()), ("s", pa.string())]
    batch = pa.RecordBatch.from_pylist([{"id": i, "u": str(i), "e": None, "s": None} for i in range(10)], pa.schema(kinds))
    asked = []

    def get(uri, etag, since):
        asked.append(uri)
        return Fetched(not_modified=True) if uri == "3" else Fetched(b"x" * 600)

    seen = []
    for out in answered([batch], get, ["id", "fetched"], limit=1000):
        held = sum(len(r["content"] or b"") for r in out.column("fetched").to_pylist())
        assert held < 1000 + 600
        seen.append((out.column("id").to_pylist(), len(asked)))
    assert [i for ids, _ in seen for i in ids] == list(range(10))
    assert all(n == ids[-1] + 1 for ids, n in seen)  # nothing is fetched before it is wanted


def test_replayed_submissions_run_once(spark, tmp_path):
    catalog = Catalog.open(spark, str(tmp_path / "catalog"), 2)
    files = spark.createDataFrame([(f"https://x/{i}", "text/html", "c1") for i in range(8)], "file_uri string, mime_type string, collection_id string")
    jobs = new_jobs(files, "ingest", F.lit(NOW).cast("timestamp"))
    jobs.write.parquet(str(tmp_path / "once"))
    jobs = spark.read.parquet(str(tmp_path / "once"))
    for i in range(3):  # each submission comes again and again, in another order
        jobs.orderBy(F.hash("id", F.lit(i))).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(jobs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    start_submissions(source, catalog, str(tmp_path / "checkpoint"), once=True).awaitTermination()
    assert sorted(r.id for r in catalog.jobs.read().collect()) == sorted(r.id for r in jobs.collect())
    out = accepted(source).writeStream.format("memory").queryName("accepted_jobs").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    assert spark.table("accepted_jobs").count() == 8


def test_due_checks_follow_each_interval(spark, tmp_path):
    """Collection a every hour, b every three hours from its second setting on, c switched off again."""
    at = lambda h, m=0: NOW + timedelta(hours=h, minutes=m)
    steps = [
        [("a", 3600, at(0)), ("b", 3600, at(0)), ("c", 3600, at(0))],
        [("b", 10800, at(0, 30)), ("c", 0, at(0, 40)), ("d", 1800, at(2, 15))],
        [("z", 0, at(6, 1))],
    ]
    schema = "collection_id string, interval_s long, changed_at timestamp"
    for rows in steps:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)
    use_timers(spark)
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    due = due_checks(source, event_time="1 minute", every_missed=True)
    out = due.writeStream.format("memory").queryName("due_checks").outputMode("append").option("checkpointLocation", str(tmp_path / "cp"))
    out.trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.collection_id, (r.due_at - NOW).total_seconds() / 3600) for r in spark.table("due_checks").collect())
    wanted = [("a", float(h)) for h in range(1, 7)] + [("b", 3.0), ("b", 6.0)] + [("d", 2.75 + k / 2) for k in range(7)]
    assert got == sorted(w for w in wanted if w[1] <= 6)
