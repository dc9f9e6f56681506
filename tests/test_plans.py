"""Shapes of physical plans that matter once the tables are large."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from lodestone.operators.running import running_total
from lodestone.plans.analytics import volume_over_time
from lodestone.sources.adapters import ingestion_events, query_events


OPTIONAL = re.compile(r"op\d+_|pipeline$")


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def plans(spark, sf):
    # These run jobs to build their frame; the training-data operators have tests of their own.
    eager = {"stream_telemetry", "ingest_twice", "keyword_search_indexed", "store_mutations", "beir_loader", "ingest_event_statuses"}
    eager |= {"keyword_search_stored", "hybrid_search_stored", "ingest_refused_texts", "ingest_totals", "stream_jobs", "stream_refresh_checks"}
    return {n: physical(q(spark, sf)) for n, q in contract.queries().items() if n not in eager and not OPTIONAL.match(n)}


def test_no_query_pairs_everything_with_everything(plans):
    for name, plan in plans.items():
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_top_k_is_taken_before_the_shuffle(plans):
    for name in ("knn", "keyword_search", "list_documents"):
        assert "TakeOrderedAndProject" in plans[name], name
    for name in ("knn_batch", "keyword_search_batch", "hybrid_search_batch", "ndcg_recall"):
        assert "WindowGroupLimit" in plans[name] and "Partial" in plans[name], name


def test_native_paths_stay_in_the_jvm(plans):
    for name in ("parse_text", "parse_markdown", "parse_json", "parse_json_nested", "chunk_sliding_window", "chunk_reuse", "knn", "keyword_search", "fingerprint"):
        assert "Python" not in plans[name] and "ArrowEval" not in plans[name], name


def test_scans_read_only_what_is_needed(spark, sf):
    plan = physical(volume_over_time(ingestion_events(spark, sf), query_events(spark, sf)))
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string>" in plan
    assert "PushedFilters: [In(event_type, [error,signup])]" in plan


def test_arrays_are_computed_once(plans):
    # The inner explode would put the tokenizer or the chunker into a size filter as well.
    for name in ("parse_text", "chunk_sliding_window"):
        assert "size(" not in plans[name].split("Generate")[1].split("FileScan")[1], name


def test_running_total_levels(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 3), rng.randint(0, 4), i, rng.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "a int, b int, c int, v long")
    got = {r.c: r.total for r in running_total(df, "v", [F.col("a"), F.col("b"), F.col("c") % 3], [F.col("c")], "total").collect()}
    total, want = 0, {}
    for a, b, c, v in sorted(rows, key=lambda r: (r[0], r[1], r[2] % 3, r[2])):
        total += v
        want[c] = total
    assert got == want
