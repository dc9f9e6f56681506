"""What stored keyword indexes write, and the scores of their blocks."""

import random
import time

import numpy as np
import pyarrow as pa

from lodestone.session import shuffles_released, work_path
from lodestone.sources import files, text_index
from lodestone.sources.chunk_store import ChunkStore
from tests.test_text_index import chunk_rows


def made(spark, name):
    store = ChunkStore(spark, work_path(spark, name), "c", buckets=2)
    store.create(text_index=True)
    return store


def test_postings_are_numbers_and_leave_no_work_table(spark):
    store, rng = made(spark, "numbers"), random.Random(5)
    words = [f"{rng.getrandbits(40):x}" for _ in range(3000)]
    texts = [(f"chunk-{i:012d}", f"document-{i:012d}", " ".join(rng.choice(words) for _ in range(400))) for i in range(300)]
    rows = chunk_rows(spark, texts)
    store.append(rows)
    folder = store.words._folder("postings", *store.index_state().deltas[0][:2])
    assert dict(spark.read.parquet(folder).dtypes)["postings"] == "array<int>"
    work = store.path.rsplit("/", 2)[0]
    assert not [n for n, *_ in files.list_dir(spark, work) if n.startswith("index-counts")]


def test_shuffles_of_a_write_are_given_back(spark):
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        found = disk.getAllFiles()
        return sum("shuffle_" in found.apply(i).getName() for i in range(found.size()))

    before = kept()
    with shuffles_released(spark):
        spark.range(1000).repartition(3, "id").write.parquet(work_path(spark, "released"))
    until = time.monotonic() + 20
    while kept() > before and time.monotonic() < until:
        time.sleep(0.2)
    assert kept() <= before


def test_an_index_of_an_older_layout_is_passed_over(spark):
    store = made(spark, "older")
    store.append(chunk_rows(spark, [("a", "d", "one two")]))
    stored = {k: v for k, v in store.manifest().text_index.items() if k != "layout"}
    assert store.index_state() is not None and text_index.IndexState.from_json(stored) is None


def test_scores_of_a_block_come_out_alike_in_any_number_of_passes(monkeypatch):
    """Also for rows that share an id and document, which are one chunk, and for an id that is null."""
    rng = np.random.default_rng(2)
    postings = []
    for term in range(12):
        numbers = sorted(rng.choice(40, 15, replace=False).tolist())
        postings.append({"df": 20 + term, "queries": rng.choice(30, 8, replace=False).tolist(), "postings": numbers + rng.integers(1, 5, 15).tolist()})
    chunks = [{"number": i, "id": None if i == 4 else f"c{i // 2 * 2 if i < 6 else i:02d}", "document_id": "d", "length": 50 + i} for i in range(38)]
    left = pa.Table.from_pylist(postings, pa.schema([("df", pa.int64()), ("queries", pa.list_(pa.int32())), ("postings", pa.list_(pa.int32()))]))
    listed = pa.list_(pa.struct([("number", pa.int32()), ("id", pa.string()), ("document_id", pa.string()), ("length", pa.int32())]))
    right = pa.Table.from_pylist([{"chunks": chunks, "askers": list(range(3, 25))}], pa.schema([("chunks", listed), ("askers", pa.list_(pa.int32()))]))
    whole = text_index._block_scores(left, right, 200, 60.0, 5).to_pylist()
    want: dict = {}
    for p in postings:
        idf = np.log(1 + (200 - p["df"] + 0.5) / (p["df"] + 0.5))
        for number, tf in zip(p["postings"][:15], p["postings"][15:], strict=True):
            if number < 38:
                part = idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * (50 + number) / 60))
                for q in set(p["queries"]) & set(range(3, 25)):
                    want[q, chunks[number]["id"]] = want.get((q, chunks[number]["id"]), 0) + part
    best = {q: sorted(((-round(s, 9), i or "") for (x, i), s in want.items() if x == q))[:5] for q, _ in want}
    got: dict = {}
    for r in whole:
        got.setdefault(r["query_id"], []).append((-r["keyword_bm25_score"], r["id"] or ""))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted((round(s, 9), i) for s, i in v) for q, v in best.items()}
    for values in (1, 60, 500):
        monkeypatch.setattr(text_index, "SCORE_VALUES", values)
        assert text_index._block_scores(left, right, 200, 60.0, 5).to_pylist() == whole
