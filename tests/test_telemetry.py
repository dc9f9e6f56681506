import os
import time
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators.quantiles import around, exact_quantiles
from lodestone.plans import analytics
from lodestone.schemas import INGESTION_EVENTS, QUERY_EVENTS, QUERY_TRACES
from lodestone.sources.retention import enforce, file_listing, kept_files
from lodestone.sources.telemetry import append_events, prepare_events, read_events
from lodestone.streaming.telemetry import as_messages, start_sink, store_batch

AT = datetime(2024, 3, 5, 10)
INGESTED = [("application/pdf", "complete", 100, 0.001), ("application/pdf", "failed", None, None), ("text/html", "complete", 50, 0.0005)]
ASKED = [
    ("query", "complete", 100, 10, None, None, None),
    ("query", "complete", 100, 10, None, None, None),
    ("rag", "complete", 1000, None, 500, 100, 0.01),
    ("query", "failed", 5, None, None, None, None),
]


def shaped(spark, schema, rows):
    fill = {"string": "", "int": 0, "bigint": 0, "double": None, "boolean": False}
    out = []
    for i, r in enumerate(rows):
        r = {"event_id": f"e{i}", "occurred_at": AT, "collection_slug": "docs", **r}
        out.append(
            tuple(r[f.name] if f.name in r else (None if f.nullable else fill.get(f.dataType.simpleString())) for f in schema.fields)
        )
    return spark.createDataFrame(out, spark.createDataFrame([], schema).select([F.col(f.name) for f in schema.fields]).schema, verifySchema=False)


def ingestion(spark):
    names = ("mime_type", "status", "embed_tokens", "embed_cost_usd")
    return shaped(spark, INGESTION_EVENTS, [dict(zip(names, r)) for r in INGESTED])


def asked(spark):
    names = ("endpoint", "status", "total_ms", "embed_query_tokens", "llm_input_tokens", "llm_output_tokens", "llm_cost_usd")
    rows = [{**dict(zip(names, r)), "hybrid_settings": (0.3, 0.7, 60.0, 200), "results": [], "query_text": "q"} for r in ASKED]
    return shaped(spark, QUERY_EVENTS, rows)


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("telemetry"))
    append_events(ingestion(spark), path, "ingestion_events")
    append_events(asked(spark), path, "query_events")
    return path


def test_panels(spark, root):
    i, q = read_events(spark, root, "ingestion_events"), read_events(spark, root, "query_events")
    start = AT - timedelta(days=1)
    assert [tuple(r) for r in analytics.volume_over_time(i, q, start).collect()] == [
        ("2024-03-05", "ingestion", 3), ("2024-03-05", "query", 3), ("2024-03-05", "rag", 1),
    ]
    assert [tuple(r) for r in analytics.volume_pivot(analytics.volume_over_time(i, q)).collect()] == [("2024-03-05", 3, 3, 1)]
    cost = analytics.cost_by_collection(i, q, start).first()
    assert (round(cost.ingestion_cost_usd, 9), cost.llm_cost_usd) == (0.0015, 0.01)
    assert [tuple(r) for r in analytics.latency(q, start).collect()] == [("query", 2, 100.0, 100.0), ("rag", 1, 1000.0, 1000.0)]
    assert [tuple(r) for r in analytics.ingestion_success_rate(i).collect()] == [("application/pdf", 2, 0.5), ("text/html", 1, 1.0)]
    assert tuple(analytics.token_usage_by_collection(i, q).first()) == ("docs", 150, 20, 500, 100)
    assert analytics.volume_over_time(i, q, AT + timedelta(days=1)).count() == 0


def test_nothing_written_yet(spark, tmp_path):
    i, q = (read_events(spark, str(tmp_path), t) for t in ("ingestion_events", "query_events"))
    for panel in (
        analytics.volume_over_time(i, q), analytics.cost_by_collection(i, q), analytics.latency(q),
        analytics.ingestion_success_rate(i), analytics.token_usage_by_collection(i, q),
    ):
        assert panel.collect() == []


def test_only_ingestion(spark, tmp_path):
    append_events(ingestion(spark), str(tmp_path), "ingestion_events")
    i, q = (read_events(spark, str(tmp_path), t) for t in ("ingestion_events", "query_events"))
    assert analytics.latency(q).collect() == []
    assert tuple(analytics.token_usage_by_collection(i, q).first()) == ("docs", 150, 0, 0, 0)


def test_cutoff():
    now = datetime(2024, 1, 1, tzinfo=timezone.utc)
    days = {None: 30, "7": 7, "0": 1, "-5": 1, "99999": 365, "text": 30, 10: 10}
    assert {d: (now - analytics.cutoff(d, now)).days for d in days} == days


def test_quantiles_interpolate(spark):
    rows = shaped(spark, QUERY_EVENTS, [
        {"endpoint": "rag", "status": "complete", "total_ms": ms, "hybrid_settings": (0.0, 0.0, 1.0, 1), "results": []} for ms in (1, 2, 3, 10)
    ])
    got = analytics.latency(rows).first()
    assert (got.p50_ms, round(got.p95_ms, 9)) == (2.5, 8.95)


def test_look_back_prunes_partitions(spark, root):
    plan = read_events(spark, root, "query_events", AT)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in plan and "PushedFilters: [IsNotNull(occurred_at)" in plan


def test_new_columns_read_as_null_in_old_files(spark, tmp_path):
    old = ingestion(spark).drop("embed_cost_usd").withColumn("event_date", F.to_date("occurred_at"))
    old.write.partitionBy("event_date").parquet(f"{tmp_path}/ingestion_events/batch=old")
    append_events(ingestion(spark), str(tmp_path), "ingestion_events")
    rows = read_events(spark, str(tmp_path), "ingestion_events")
    assert rows.count() == 6 and rows.where("embed_cost_usd is not null").count() == 2


def test_preparation(spark):
    bare = asked(spark).withColumn("event_id", F.lit("")).withColumn("occurred_at", F.lit(None).cast("timestamp"))
    done = prepare_events(bare, "query_events", redact=True).collect()
    assert len({r.event_id for r in done}) == 4 and all(r.occurred_at and r.query_text is None for r in done)
    trace = [("e1", AT, [], None, None), ("", AT, [], None, None)]
    traces = spark.createDataFrame(trace, "event_id string, occurred_at timestamp, chunks " + QUERY_TRACES["chunks"].dataType.simpleString() + ", formatted_prompt string, answer string")
    assert [r.event_id for r in prepare_events(traces, "query_traces").collect()] == ["e1"]
    assert prepare_events(traces, "query_traces", redact=True).count() == 0


def test_stream_sorts_kinds_and_survives_replay(spark, tmp_path):
    messages = as_messages(ingestion(spark), "ingestion_events").unionByName(as_messages(asked(spark), "query_events"))
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    messages.write.parquet(source)
    stream = spark.readStream.schema("kind string, payload string").parquet(source)
    start_sink(stream, root, str(tmp_path / "cp"), once=True).awaitTermination()
    store_batch(messages, root, "telemetry-0")
    assert read_events(spark, root, "ingestion_events").count() == 3
    assert read_events(spark, root, "query_events").where("results is not null").count() == 4
    assert read_events(spark, root, "query_traces").count() == 0


def test_kept_files_matches_deleting_the_oldest(spark):
    files = [(f"f{i}", datetime(2024, 1, 1 + i // 3, i % 3), (i * 37) % 11) for i in range(30)]
    listing = spark.createDataFrame(files, "path string, modified timestamp, bytes long")
    now = datetime(2024, 1, 12)
    alive = sorted((f for f in files if now - f[1] <= timedelta(days=6)), key=lambda f: f[1])
    while sum(f[2] for f in alive) > 40:
        alive.pop(0)
    got = kept_files(listing, F.lit(now), 6, 40).select("path").collect()
    assert sorted(r.path for r in got) == sorted(f[0] for f in alive)


def test_janitor_deletes(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(3):
        append_events(ingestion(spark).coalesce(1), root, "ingestion_events", f"b{n}")
    paths = sorted(r.path.removeprefix("file:") for r in file_listing(spark, root).collect())
    os.utime(paths[0], (time.time() - 40 * 86400,) * 2)
    assert enforce(spark, root, F.current_timestamp(), 30, 10) == 1
    assert not os.path.exists(paths[0]) and os.path.exists(paths[1])
    assert enforce(spark, root, F.current_timestamp(), 30, 0) == 2


def test_quantiles_of_hot_and_null_groups(spark):
    rng = np.random.default_rng(3)
    rows = [(k, None if i % 97 == 0 else int(v)) for k, n in (("hot", 3000), ("small", 3), (None, 40), ("one", 1)) for i, v in enumerate(rng.integers(0, 900, n) ** 2)]
    rows += [("flat", 7)] * 20 + [("empty", None)]
    frame = spark.createDataFrame(rows, "endpoint string, total_ms long")
    got = {r.endpoint: r for r in exact_quantiles(frame, ["endpoint"], "total_ms", {"p50": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}, "n").collect()}
    values = {}
    for k, v in rows:
        if v is not None:
            values.setdefault(k, []).append(v)
    assert set(got) == set(values)
    for k, v in values.items():
        assert got[k].n == len(v)
        assert [got[k].p50, got[k].p95, got[k].low, got[k].high] == pytest.approx(np.quantile(v, [0.5, 0.95, 0, 1]).tolist())


def test_quantiles_of_skewed_values_keep_little_apart(spark):
    """One outlier, far beyond all others, leaves the values around a quantile under 1 % of their group."""
    rng = np.random.default_rng(4)
    values = np.append(np.exp(rng.normal(5, 2, 60_000)), 1e15)
    frame = spark.createDataFrame([("rag", float(v)) for v in values], "endpoint string, total_ms double")
    wanted = {"p50": 0.5, "p95": 0.95, "p99": 0.99}
    got = exact_quantiles(frame, ["endpoint"], "total_ms", wanted, "n").first()
    assert [got.p50, got.p95, got.p99] == pytest.approx(np.quantile(values, [0.5, 0.95, 0.99]).tolist(), rel=1e-12)
    named = frame.select(F.col("endpoint").alias("k"), F.col("total_ms").alias("_v"))
    bounds, cuts = around(named, ["k"], list(wanted.values()))
    row = bounds.first()
    for low, high in zip(cuts[::2], cuts[1::2]):
        assert 0 < np.mean((values >= row[low]) & (values <= row[high])) < 0.01
