"""Embedding calls: refused texts fail alone, and all tasks together keep one rate."""

import random
import urllib.error
from collections import Counter
from dataclasses import dataclass, field

import pytest
from pyspark.sql import functions as F

from lodestone.operators.chunking import ChunkConfig
from lodestone.operators.embedding import HashEmbedder, Slots, embed_column, embed_rows, is_outage, isolate
from lodestone.plans.ingest import Collection, ingest
from lodestone.session import work_path
from lodestone.sources.chunk_store import ChunkStore


@dataclass
class Counting:
    refused: set
    error: Exception = field(default_factory=lambda: ValueError("refused"))
    calls: int = 0

    def embed(self, texts):
        self.calls += 1
        if self.refused & set(texts):
            raise self.error
        return [[float(len(t))] for t in texts], len(texts)


@pytest.mark.parametrize("bad", [[], [0], [99], [41, 42], list(range(100))])
def test_refused_texts_are_isolated(bad):
    texts = [f"text {i}" for i in range(100)]
    provider = Counting({texts[i] for i in bad})
    vectors, errors, tokens = isolate(provider.embed, texts)
    assert [i for i, e in enumerate(errors) if e] == bad and all((v is None) == (e is not None) for v, e in zip(vectors, errors))
    assert tokens == 100 - len(bad)
    assert provider.calls <= 1 + 2 * 7 * len(bad)
    assert all(v == [float(len(t))] for v, t in zip(vectors, texts) if v)


def test_an_outage_is_not_searched_for_texts():
    texts = [f"text {i}" for i in range(64)]
    for error in (ConnectionError("gone"), TimeoutError(), urllib.error.HTTPError("u", 503, "busy", None, None), urllib.error.HTTPError("u", 429, "slow", None, None)):
        provider = Counting(set(texts[:1]), error)
        _, errors, _ = isolate(provider.embed, texts)
        assert provider.calls == 1 and all(errors) and is_outage(error)
    assert not is_outage(urllib.error.HTTPError("u", 400, "bad input", None, None))


def test_tasks_share_one_rate():
    """Tasks with clocks of their own and calls of any length: no second holds more than ``rate`` calls."""
    rng = random.Random(1)
    tasks, rate, calls = 5, 10.0, []
    for index in range(tasks):
        now = [100.0]
        slots = Slots(index, tasks, rate, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
        for _ in range(40):
            slots.wait()
            calls.append(now[0] - 100.0)
            now[0] += rng.choice([0.0, 0.01, 0.4, 3.0])
    slots_used = Counter(round(c * rate, 6) for c in calls)
    assert max(slots_used.values()) == 1  # every call has a slot of its own
    assert all(s == int(s) for s in slots_used)


def test_metered_rows_keep_their_columns(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else f"text {i}", [float(i)]) for i in range(40)], "id long, t string, v array<float>")
    made = embed_rows(rows, F.col("t"), HashEmbedder(4), calls_per_second=200.0).collect()
    assert sorted(r.id for r in made) == list(range(40)) and all(r.v == [float(r.id)] for r in made)
    assert all((r._call is None) == (r.id % 4 == 0) for r in made)
    plain = {r.id: r.e for r in rows.select("id", embed_column(F.col("t"), HashEmbedder(4)).alias("e")).collect()}
    assert all(r._call.vector == plain[r.id].vector for r in made if r._call)
    assert sum(r._call.wait_ms for r in made if r._call) >= 0


def test_only_documents_with_refused_texts_fail(spark):
    # Defined here, so that tasks get it by value.
    @dataclass(frozen=True)
    class RemoteLike(HashEmbedder):
        local: bool = False

        def embed(self, texts):
            if any("refuse me" in t for t in texts):
                raise ValueError("not this one")
            return super().embed(texts)

    store = ChunkStore(spark, work_path(spark, "refusals"), "c", buckets=2)
    schema = "document_id string, file_uri string, mime_type string, content binary"
    files = lambda *docs: spark.createDataFrame([(d, "upload://x", "text/plain", bytearray(t.encode())) for d, t in docs], schema)
    target = Collection("c", "c", ChunkConfig("paragraph", 40, 5))
    ingest(files(("a", "first text of a"), ("b", "first text of b")), store, target, HashEmbedder(8))
    long = "\n\n".join(f"paragraph {i} of a, long enough to be a chunk" for i in range(5)) + "\n\nrefuse me, please"
    report = ingest(files(("a", long), ("b", "second text of b"), ("d", "new")), store, target, RemoteLike(8), calls_per_second=500.0)
    got = {r.document_id: (r.status, r.chunk_count, r.stale_chunks) for r in report.documents.collect()}
    assert got["a"] == ("failed", 0, 0) and got["b"][0] == got["d"][0] == "complete"
    assert "not this one" in report.documents.where("document_id = 'a'").first().error
    kept = {r.document_id: r.chunk_text for r in store.read().collect()}
    assert kept == {"a": "first text of a", "b": "second text of b", "d": "new"}
    events = {r.document_id: r.status for r in report.events.collect()}
    assert events == {"a": "failed", "b": "complete", "d": "complete"}


def test_arrow_batches_are_bounded_whatever_the_session_says(spark):
    """A worker's memory follows from the batch, not from the task."""
    import pyarrow as pa

    from lodestone.session import apply_runtime_conf

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        apply_runtime_conf(spark)
        sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"]) for b in batches)
        told = [r.n for r in spark.range(5000).repartition(1).mapInArrow(sizes, "n long").collect()]
        assert sum(told) == 5000 and max(told) <= 1000
    finally:
        spark.conf.set(key, before)


def test_rows_dealt_anew_make_several_tasks_a_core(spark, sf):
    from lodestone.operators.skew import spread

    rows = spark.read.parquet(f"{sf}/orders.parquet").coalesce(1)
    dealt = spread(rows, "o_orderkey")
    assert dealt.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism and dealt.count() == rows.count()
