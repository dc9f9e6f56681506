import math

import pytest

from lodestone.plans.evaluation import aggregate, against_baseline, first_per_document, judge_cost, merge_baseline, ndcg, recall, sample


def test_metrics(spark):
    ranked = spark.createDataFrame(
        [("q1", "d1", 0), ("q1", "d2", 1), ("q1", "d3", 2), ("q2", "x", 0)], "query_id string, doc_id string, rank int"
    )
    judged = spark.createDataFrame(
        [("q1", "d2", 2), ("q1", "d9", 1), ("q2", "x", 0), ("q3", "y", 1)], "query_id string, doc_id string, relevance int"
    )
    got = {r.query_id: r.ndcg for r in ndcg(ranked, judged, 10).collect()}
    assert got["q1"] == pytest.approx((2 / math.log2(3)) / (2 + 1 / math.log2(3))) and got["q2"] == 0.0 and got["q3"] == 0.0
    assert {r.query_id: r.ndcg for r in ndcg(ranked, judged, 1).collect()}["q1"] == 0.0
    r = recall(ranked, judged, 100)
    assert {x.query_id: x.recall for x in r.collect()} == {"q1": 0.5, "q2": None, "q3": 0.0}
    means = {m.metric: m.value for m in aggregate(r, "recall").collect()}
    assert means == {"recall": 0.25}


def test_first_per_document(spark):
    df = spark.createDataFrame([("q", "a", 0), ("q", "b", 1), ("q", "a", 2), ("q", "c", 3)], "query_id string, doc_id string, rank int")
    assert sorted((r["rank"], r.doc_id) for r in first_per_document(df).collect()) == [(0, "a"), (1, "b"), (2, "c")]


def test_baseline(spark):
    now = spark.createDataFrame([("ndcg", 0.9), ("new", 1.0)], "metric string, value double")
    old = spark.createDataFrame([("ndcg", 0.8)], "metric string, value double")
    got = {r.metric: r.delta for r in against_baseline(now, old).collect()}
    assert got["ndcg"] == pytest.approx(0.1) and got["new"] is None
    stored = spark.createDataFrame([("a", "m", 1.0), ("b", "m", 2.0)], "track string, metric string, value double")
    run = spark.createDataFrame([("a", "m", 3.0)], "track string, metric string, value double")
    assert sorted(tuple(r) for r in merge_baseline(stored, run).collect()) == [("a", "m", 3.0), ("b", "m", 2.0)]


def test_sampling_is_repeatable_and_keeps_relevant(spark):
    corpus = spark.createDataFrame([(f"d{i}",) for i in range(40)], "doc_id string")
    queries = spark.createDataFrame([(f"q{i}",) for i in range(10)], "query_id string")
    judged = spark.createDataFrame([(f"q{i}", f"d{i}", 1) for i in range(8)], "query_id string, doc_id string, relevance int")
    docs, chosen, kept = sample(corpus, queries, judged, 42, 5, 12)
    ids = {r.doc_id for r in docs.collect()}
    assert len(ids) == 12 and chosen.count() == 5 and {r.doc_id for r in kept.collect()} <= ids
    assert {r.doc_id for r in sample(corpus.repartition(3), queries, judged, 42, 5, 12)[0].collect()} == ids


def test_judge_cost(spark):
    usage = spark.createDataFrame([(1_000_000, 500_000)], "input_tokens long, output_tokens long")
    assert judge_cost(usage, "gpt-4o-mini").first()[0] == pytest.approx(0.45)
    assert judge_cost(usage, "other").first()[0] is None
