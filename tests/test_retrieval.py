import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import render_prompt
from lodestone.functions.vectors import l2_distance, l2_distance_to, l2_normalize
from lodestone.operators import knn as knn_module
from lodestone.operators import skew
from lodestone.operators.completion import ChatModel, EchoModel, complete_column
from lodestone.operators.fusion import HybridSettings, fuse
from lodestone.operators import keyword
from lodestone.operators.keyword import build_postings, keyword_search, query_terms, read_index, search_postings, write_index
from lodestone.operators.knn import knn, knn_batch
from lodestone.plans.catalog import SYSTEM_PROMPTS
from lodestone.plans.rag import answer
from lodestone.plans.retrieval import SearchRequest, at_least, result_stats, search, trace_chunks


def vectors(spark, n, dim, seed=1, start=0):
    rng = random.Random(seed)
    rows = [(i + start, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(1000 + start + i, rows[i][1]) for i in range(3)]  # exact copies
    return spark.createDataFrame(rows, "id long, vector array<float>"), {i: np.array(v, np.float32).astype(float) for i, v in rows}


def nearest(space, q, k):
    return sorted((float(np.sqrt(((v - q) ** 2).sum())), i) for i, v in space.items())[:k]


@pytest.mark.parametrize("dim", [5, 300])
def test_knn_is_exact(spark, dim):
    df, space = vectors(spark, 60, dim)
    q = space[2]
    got = [(r.vector_distance, r.id) for r in knn(df, q.tolist(), 7).collect()]
    want = nearest(space, q, 7)
    assert [i for _, i in got] == [i for _, i in want] and got[0][0] == got[1][0] == 0
    assert np.allclose([d for d, _ in got], [d for d, _ in want])
    kept = [r.id for r in knn(df, q.tolist(), 3, F.col("id") % 2 == 1).collect()]
    assert kept == [i for _, i in nearest({i: v for i, v in space.items() if i % 2}, q, 3)]


@pytest.mark.parametrize("blocked", [False, True])
def test_knn_batch_is_exact(spark, monkeypatch, blocked):
    if blocked:
        monkeypatch.setattr(knn_module, "BLOCK_VALUES", 30)
        monkeypatch.setattr(knn_module, "GROUP_VALUES", 100)
    df, space = vectors(spark, 50, 6)
    queries, asked = vectors(spark, 12, 6, seed=9, start=5000)
    queries = queries.select(F.col("id").alias("query_id"), F.col("vector").alias("query_vector"))
    got = {}
    for r in knn_batch(df.repartition(3), queries, 4, 6).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    want = {q: {n: i for n, (_, i) in enumerate(nearest(space, v, 4))} for q, v in asked.items()}
    assert got == want


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(
        l2_normalize(F.col("a")).alias("u"), l2_normalize(F.col("z")).alias("z"),
        l2_distance(F.col("a"), F.col("z")).alias("d"), l2_distance_to(F.col("a"), [0.0, 0.0]).alias("e"),
    ).first()
    assert np.allclose(row.u, [0.6, 0.8]) and row.z == [0.0, 0.0] and row.d == row.e == 5.0


DOCS = ["the cat sat", "The dog; the DOG!", "", "a cat and a dog", "über straße 42", "nothing here", "cat"]


def brute_bm25(query):
    toks = [[t for t in re.split(r"[\W_]+", d.lower()) if t] for d in DOCS]
    n, avg = len(DOCS), sum(map(len, toks)) / len(DOCS)
    out = {}
    for term in {t for t in re.split(r"[\W_]+", query.lower()) if t}:
        df = sum(term in t for t in toks)
        for i, t in enumerate(toks):
            tf = t.count(term)
            if tf:
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                out[i] = out.get(i, 0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg))
    return sorted(((round(s, 9), i) for i, s in out.items()), key=lambda p: (-p[0], p[1]))


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "id long, chunk_text string").cache()


@pytest.mark.parametrize("query", ["cat", "the dog cat cat", "ÜBER straße", "absent", "--"])
def test_keyword_search(spark, docs, tmp_path, query):
    want = [(i, s) for s, i in brute_bm25(query)]
    got = [(r.id, r.keyword_bm25_score) for r in keyword_search(docs, query, 3).collect()]
    assert [i for i, _ in got] == [i for i, _ in want[:3]] and np.allclose([s for _, s in got], [s for _, s in want[:3]])
    asked = spark.createDataFrame([(1, query), (2, "nothing")], "query_id int, query_text string")
    write_index(docs, str(tmp_path / "ix"))
    for lists in (build_postings(docs), read_index(spark, str(tmp_path / "ix"), query_terms(spark, query + " nothing"))):
        rows = search_postings(lists, asked, 3).where("query_id = 1").orderBy("rank").collect()
        assert [r.id for r in rows] == [i for i, _ in want[:3]]


def test_keyword_filter_keeps_corpus_statistics(spark, docs):
    whole = {i: s for s, i in brute_bm25("cat dog")}
    got = keyword_search(docs, "cat dog", 10, F.col("id") != 3).collect()
    assert {r.id: r.keyword_bm25_score for r in got} == pytest.approx({i: s for i, s in whole.items() if i != 3})
    asked = spark.createDataFrame([(1, "cat dog")], "query_id int, query_text string")
    rows = search_postings(build_postings(docs), asked, 10, docs.where("id <> 3")).collect()
    assert {r.id: r.keyword_bm25_score for r in rows} == pytest.approx({i: s for i, s in whole.items() if i != 3})


def test_large_lookup_is_salted(spark, docs, monkeypatch):
    asked = spark.createDataFrame([(1, "cat dog the")], "query_id int, query_text string")
    small = {(r.id, r.keyword_bm25_score) for r in search_postings(build_postings(docs), asked, 10).collect()}
    monkeypatch.setattr(skew, "fits_broadcast", lambda *a: False)
    from lodestone.operators import keyword

    monkeypatch.setattr(keyword, "fits_broadcast", lambda *a: False)
    assert {(r.id, r.keyword_bm25_score) for r in search_postings(build_postings(docs), asked, 10).collect()} == small


def test_fusion_by_hand(spark):
    near = spark.createDataFrame(
        [(0, "a", 0, 0.1, 99.5), (0, "b", 1, 0.2, 98.0)], "query_id int, id string, rank int, vector_distance double, vector_similarity double"
    )
    found = spark.createDataFrame(
        [(0, "b", 0, 7.0), (0, "c", 1, 6.0), (0, "d", 1, 6.0)], "query_id int, id string, rank int, keyword_bm25_score double"
    )
    rows = fuse(near, found, HybridSettings(), 3).orderBy("rank").collect()
    f = np.float32
    b = f(f(0.7) / f(61)) + f(f(0.3) / f(60))
    assert [(r.id, r.rrf_score) for r in rows] == [("b", b), ("a", f(f(0.7) / f(60))), ("c", f(f(0.3) / f(61)))]
    assert rows[0].rrf_score_normalized == 100.0 and rows[0].vector_similarity == 98.0 and rows[0].keyword_bm25_score == 7.0
    assert rows[2].vector_distance is None


def test_settings_bounds():
    for bad in ({"full_text_weight": -1}, {"rrf_k": 0}, {"full_text_limit": 0}, {"full_text_limit": 1001}):
        with pytest.raises(ValueError):
            HybridSettings(**bad)
    for k in (0, 101):
        with pytest.raises(ValueError):
            SearchRequest(top_k=k)


@pytest.fixture(scope="module")
def hits(spark):
    rows = [
        ("a", [1.0, 0.0], "alpha words", "h1", "s1"),
        ("b", [0.6, 0.8], "beta words", None, "s2"),
        ("c", [-1.0, 0.0], "gamma gamma {{question}}", "", "s3"),
    ]
    chunks = spark.createDataFrame(rows, "id string, vector array<float>, chunk_text string, chunk_header string, source_name string")
    return search(chunks, "gamma", [1.0, 0.0], SearchRequest(top_k=2)).cache()


def test_keyword_only_hit_fails_min_similarity(hits):
    assert {r.id: r.vector_similarity for r in hits.collect()} == {"a": 100.0, "b": pytest.approx(60.0)}
    wide = at_least(hits, 50.0)
    assert wide.count() == 2 and at_least(hits, 0).count() == 2 and at_least(hits, 61.0).count() == 1
    none = hits.withColumn("vector_similarity", F.lit(None).cast("double"))
    assert at_least(none, 1.0).count() == 0 and at_least(none, 1.0, keyword_passes=True).count() == 2


def test_stats_and_traces(hits):
    assert [s.source_name for s in result_stats(hits).first().results] == ["s1", "s2"]
    assert [c.chunk_header for c in trace_chunks(hits).first().chunks] == ["h1", None]


def test_rag(spark, hits):
    asked = spark.createDataFrame([(0, "Why?"), (1, "Nothing?")], "query_id int, query_text string")
    rows = {r.query_id: r for r in answer(asked, hits, "{{context}} | {{question}}", EchoModel()).collect()}
    want = "[Source 1: s1]\n[Section: h1]\nalpha words\n\n---\n\n[Source 2: s2]\nbeta words | Why?"
    assert rows[0].formatted_prompt == want and rows[0].answer == "fake answer for: " + want[:40]
    assert rows[1].formatted_prompt == " | Nothing?"
    nested = spark.range(1).select(render_prompt(F.lit("{{context}}"), F.lit("see {{question}}"), F.lit("Q")).alias("p"))
    assert nested.first().p == "see Q"
    assert all("{{context}}" in p[2] and "{{question}}" in p[2] for p in SYSTEM_PROMPTS.values())


def test_echo_cuts_bytes_not_characters(spark):
    prompt = "x" * 39 + "é and more"
    got = spark.range(1).select(complete_column(F.lit(prompt), EchoModel()).alias("c")).first().c.answer
    assert got == "fake answer for: " + "x" * 39 + "\ufffd"


def test_chat_models(spark):
    def post(url, body, headers, timeout):
        if "boom" in body["messages"][0]["content"]:
            raise OSError("down")
        return {"content": [{"text": "hi"}], "usage": {"input_tokens": 3, "output_tokens": 1}}

    model = ChatModel("anthropic", "http://x", "m", post=post)
    df = spark.createDataFrame([("ok",), ("boom",), (None,)], "p string").coalesce(1)
    got = [r.c for r in df.select(complete_column(F.col("p"), model).alias("c")).collect()]
    assert (got[0].answer, got[0].input_tokens, got[0].error) == ("hi", 3, None)
    assert got[1].answer is None and got[1].error == "LLM call failed: down" and got[2] is None
    openai = ChatModel("openai", "u", "m", post=lambda *a: {"choices": [{"message": {"content": "y"}}], "usage": {"prompt_tokens": 2}})
    assert openai.complete("x") == ("y", 2, 0)
    ollama = ChatModel("ollama", "u", "m", post=lambda *a: {"message": {"content": "z"}, "eval_count": 4})
    assert ollama.complete("x") == ("z", 0, 4)


def test_rows_without_a_whole_vector_are_no_neighbours(spark):
    for dim in (4, 300):
        unit = [1.0] + [0.0] * (dim - 1)
        rows = [(1, unit), (2, None), (3, unit[:-1]), (4, [None, *unit[1:]]), (5, [0.0, 1.0, *unit[2:]])]
        chunks = spark.createDataFrame(rows, "id long, vector array<float>")
        assert [r.id for r in knn(chunks, unit, 10).collect()] == [1, 5]
        asked = spark.createDataFrame([(0, unit), (1, None)], "query_id int, query_vector array<float>")
        assert sorted((r.query_id, r.id) for r in knn_batch(chunks, asked, 10, dim).collect()) == [(0, 1), (0, 5)]


def test_cells_that_cannot_hold_a_neighbour_are_skipped(spark, monkeypatch):
    """Clustered vectors, one crowded cell, copies and rows with gaps: exact, and most pairs are never compared."""
    monkeypatch.setattr(knn_module, "PIVOTS", 24)
    monkeypatch.setattr(knn_module, "GROUP_VALUES", 6 * 40)
    rng = np.random.default_rng(8)
    centers = rng.normal(0, 20, (20, 6))
    label = np.where(np.arange(600) % 3 == 0, 0, rng.integers(0, 20, 600))
    space = {i: (centers[c] + rng.normal(0, 1, 6)).astype(np.float32).astype(float) for i, c in enumerate(label)}
    rows = [(i, v.tolist()) for i, v in space.items()] + [(9000, [None] * 6), (9001, [1.0])]
    space |= {7000 + i: space[i] for i in range(5)}
    rows += [(7000 + i, space[i].tolist()) for i in range(5)]
    asked = {q: (centers[q % 20] + rng.normal(0, 1, 6)).astype(np.float32).astype(float) for q in range(60)} | {99: np.full(6, 500.0)}
    pairs = spark.createDataFrame(rows, "id long, vector array<float>").where(F.size("vector") == 6).repartition(5)
    queries = spark.createDataFrame([(q, v.tolist()) for q, v in asked.items()], "query_id long, vector array<float>")
    kinds = "query_id long, id long, vector_distance double"
    schema = spark.createDataFrame([], kinds).schema
    for k in (1, 7, 1000):
        join = knn_module.CellJoin(pairs, queries, k, 6, schema)
        found = {}
        for r in join.result().collect():
            found.setdefault(r.query_id, []).append((r.vector_distance, r.id))
        for q, v in asked.items():
            got, wanted = sorted(found[q])[:k], nearest(space, v, k)
            assert [i for _, i in got] == [i for _, i in wanted] and np.allclose([d for d, _ in got], [d for d, _ in wanted])
        assert join.shares.max() > 1 and (join.pruned() > 0.6 or k == 1000)


def test_postings_take_no_shuffle_and_tasks_a_bounded_share(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"the w{i % 7} w{i % 5} w{i % 5}") for i in range(200)], "id int, chunk_text string")
    assert "Exchange" not in build_postings(docs).postings._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([(q, f"the w{q}") for q in range(5)], "query_id int, query_text string")
    shown = lambda: sorted(tuple(r) for r in search_postings(build_postings(docs), asked, 10).collect())
    wanted = shown()
    monkeypatch.setattr(keyword, "TASK_PARTS", 100)
    plan = search_postings(build_postings(docs), asked, 10)._jdf.queryExecution().executedPlan().toString()
    # 5 queries meet "the" 200 times and a word or two of their own: more than 1,000 parts to add.
    assert max(int(n) for n in re.findall(r"hashpartitioning\(id#\d+, (\d+)\)", plan)) > 10
    assert shown() == wanted


def test_answers_keep_texts_out_of_the_join_with_vectors(spark, sf, monkeypatch):
    from queries import retrieval

    plans = []
    told = lambda rows: plans.append(rows._jdf.queryExecution().analyzed().toString())
    monkeypatch.setattr(retrieval, "search_batch", lambda chunks, asked, dim, request, postings: told(postings.postings) or told(postings.corpus))
    monkeypatch.setattr(retrieval, "attach_chunks", lambda hits, chunks, *others: told(chunks))
    retrieval._shown_results(spark, sf)
    assert len(plans) == 3 and not any("Join" in p for p in plans)
