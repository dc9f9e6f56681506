"""Names that clash, repeated ids, texts that weak hashes cannot tell apart, and models against plain loops."""

import datetime
import io
import os
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from lodestone.llm import decontam, language, membership, neardup, quality, sampling, toxicity, urls, warc  # noqa: E402
from lodestone.llm.tables import WorkTables  # noqa: E402

INTERNAL = ["_doc", "_text", "_found", "_day", "_lead", "_dropped", "row", "member_id", "maybe", "bitmap_word", "overlaps", "item"]


def thue_morse(size, letters="ab"):
    return "".join(letters[bin(i).count("1") % 2] for i in range(size))


def with_internal_names(df):
    for k, name in enumerate(INTERNAL):
        df = df.selectExpr("*", f"{70 + k} AS `{name}`")
    return df


def own_values(rows):
    return all(r[name] == 70 + k for r in rows for k, name in enumerate(INTERNAL))


# --- hashes -----------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1024, 2048, 4096])
def test_lines_that_polynomial_hashes_confuse(size):
    text = f"{thue_morse(size)}\n{thue_morse(size, 'ba')}\n{thue_morse(size)}"
    metrics = dict(zip(quality.METRICS, quality.text_metrics(pa.array([text]))))
    assert metrics["n_dup_lines"].tolist() == [1] and metrics["n_words"].tolist() == [3]


def test_words_that_polynomial_hashes_confuse(spark):
    a, b = thue_morse(2048), thue_morse(2048, "ba")
    rows = [(1, f"{a} x y"), (2, f"{b} x y"), (3, f"{a} x y"), (4, f"{b} x z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, neardup.NearDupConfig(shingle=3, percent=85)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_duplicates(rows, 3, 85)


# --- names ------------------------------------------------------------------------------

ITEM = " ".join(f"word{i}" for i in range(25))


def test_decontamination_keeps_columns_of_any_name(spark):
    docs = with_internal_names(spark.createDataFrame([(1, ITEM), (2, "clean text"), (None, "x"), (3, "pad " * 30_000 + ITEM)], "doc_id long, text string"))
    benchmark = spark.createDataFrame([(5, ITEM), (6, "too short"), (7, None)], "item_id long, text string")
    for rules in (decontam.DecontamRules(), decontam.DecontamRules(broadcast_found=0)):
        clean = decontam.clean_documents(docs, benchmark, rules)
        assert clean.columns == docs.columns
        rows = clean.collect()
        assert sorted((r.doc_id or -1) for r in rows) == [-1, 2] and own_values(rows)
        found = decontam.overlaps(docs, benchmark, rules).where("overlaps IS NOT NULL").collect()
        assert sorted(r.doc_id for r in found) == [1, 3] and {r.item for r in found} == {81}
    short = decontam.items_without_evidence(benchmark).collect()
    assert sorted((r.item_id, r.n_words) for r in short) == [(6, 2), (7, 0)]


def test_url_verdicts_keep_columns_of_any_name(spark):
    day = datetime.date(2024, 1, 5)
    rows = [(1, "http://bad.com/" + "a/" * 20_000, day), (2, None, day), (3, "http://fine.com", None)]
    captures = with_internal_names(spark.createDataFrame(rows, "page_id long, url string, fetched_at date"))
    events = spark.createDataFrame([("bad.com", datetime.date(2024, 1, 1), "block", "spam")], "entry string, day date, action string, category string")
    got = urls.judge(captures, events).collect()
    assert {r.page_id: r.verdict for r in got} == {1: "blocked", 2: "invalid", 3: "unlisted"} and own_values(got)


@pytest.mark.parametrize("few", [500_000, 0])
def test_first_of_each_group_keeps_columns_of_any_name(spark, few):
    text = " ".join(f"w{i}" for i in range(80))
    rows = [(1, text), (2, text), (3, text + " more"), (4, "other words of a text that stands alone"), (None, text), (5, None)]
    docs = with_internal_names(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = neardup.first_of_each_group(docs, neardup.NearDupConfig(few_ids=few))
    assert kept.columns == docs.columns
    rows = kept.collect()
    assert sorted((r.doc_id or -1) for r in rows) == [-1, 1, 4, 5] and own_values(rows)


@pytest.mark.parametrize("few", [1000, 0])
def test_membership(spark, few):
    rows = spark.range(5000).selectExpr("IF(id = 7, NULL, id) AS id", "'x' AS maybe")
    ids = WorkTables(spark, "test").write(spark.range(0, 5000, 3).selectExpr("id"), "ids")
    with_ = {r.id for r in membership.with_ids(rows, "id", ids, few).collect()}
    without = [r.id for r in membership.without_ids(rows, "id", ids, few).collect()]
    assert with_ >= set(range(0, 5000, 3)) and len(with_) < 1800
    assert sorted(without, key=lambda i: i or 0) == sorted([None if i == 7 else i for i in range(5000) if i % 3], key=lambda i: i or 0)


# --- repeated ids -----------------------------------------------------------------------


def test_samples_are_bounded_whatever_ids_repeat(spark):
    rows = spark.range(10_000).selectExpr("1L AS doc_id", "concat('text ', id % 3000) AS text", "'en' AS lang", "7 AS _bytes")
    same = spark.range(10_000).selectExpr("2L AS doc_id", "'one text' AS text", "'en' AS lang", "7 AS _bytes")
    docs = rows.unionByName(same)
    chosen = sampling.sample(sampling.sized(docs, "lang"), "lang", 50, 100, 60)
    texts = sampling.sampled_texts(docs, chosen, "lang", 100).collect()
    assert 1 <= len(texts) <= 2 and len({r.doc_id for r in texts}) == len(texts)


# --- models against plain loops ------------------------------------------------------------


def test_language_model_against_a_direct_solve():
    """Coefficients and scores from kernels over all pairs, one language against the rest at a time."""
    rng = np.random.default_rng(2)
    texts = ["".join(rng.choice(list("abcdefgh "[k % 3 :]), 60)) for k in range(24)]
    tongues = [["x", "y", "z"][k % 3] for k in range(24)]
    config = language.LanguageConfig(landmarks=24, ridge=0.05)
    grams = language.Grams()
    sets = [set(grams.distinct(t).tolist()) for t in texts]
    model = language.fit([grams.distinct(t) for t in texts], tongues, config)
    kernel = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    weight = np.full(24, 1 / 24)
    for k, name in enumerate(model.languages):
        target = np.array([1.0 if t == name else -1.0 for t in tongues])
        # Weighted kernel ridge with a free bias: minimise sum w (K a + b - y)^2 + ridge / n * a' K a.
        system = np.zeros((25, 25))
        system[:24, :24] = weight[:, None] * kernel + config.ridge / 24 * np.eye(24)
        system[:24, 24] = weight
        system[24, :24] = weight @ kernel
        system[24, 24] = weight.sum()
        solved = np.linalg.solve(system, np.append(weight * target, weight @ target))
        direct = kernel @ solved[:24] + solved[24]
        presence = [grams.presence(t, model.columns) for t in texts]
        scores = model.scores(np.stack([p for p, _ in presence]), np.array([n for _, n in presence]))
        assert np.allclose(scores[:, k], direct, atol=2e-3)


def test_noisy_or_against_a_plain_loop():
    """Scores of documents by multiplying over sentences, and the gradient at the fitted weights."""
    rng = np.random.default_rng(4)
    vocabulary = np.sort(rng.integers(1, 1 << 62, 12).astype(np.uint64))
    bags = [[rng.choice(vocabulary, 3, replace=False) for _ in range(rng.integers(1, 5))] for _ in range(60)]
    label = np.array([int(any(vocabulary[0] in s or vocabulary[1] in s for s in bag)) for bag in bags])
    word, sentence, document = [], [], []
    for d, bag in enumerate(bags):
        for s in bag:
            word += s.tolist()
            sentence += [len(document)] * len(s)
            document.append(d)
    config = toxicity.ToxicityConfig(min_association=1.0, min_weight=0.0, min_documents=1, steps=4000, rate=0.05, ridge=1e-2)
    model = toxicity.fit(np.array(word, np.uint64), np.array(sentence), np.array(document), label, config)
    weights = dict(zip(model.words.tolist(), model.weights.tolist()))
    share = np.where(label == 1, 0.5 / label.sum(), 0.5 / (1 - label).sum())

    def loss(change=None, by=0.0):
        total = config.ridge / 2 * sum((w + by * (k == change)) ** 2 for k, w in weights.items())
        for bag, y, part in zip(bags, label, share):
            clean = 1.0
            for s in bag:
                known = [weights[w] + by * (w == change) for w in s.tolist() if w in weights]
                if known:
                    clean *= 1 - 1 / (1 + np.exp(-(model.bias + by * (change == "bias") + sum(known))))
            total -= part * np.log(max(1 - clean if y else clean, 1e-12))
        return total

    assert weights and all(abs(loss(k, 1e-4) - loss(k, -1e-4)) / 2e-4 < 5e-3 for k in [*weights, "bias"])


def test_sentences_end_at_stops_of_any_script():
    text = "これは悪い。次の文です！ok? यह है। end"
    raw = np.frombuffer(text.encode(), np.uint8)
    found = toxicity.sentences(raw, np.array([0, len(raw)]))
    assert [raw[a:b].tobytes().decode() for a, b in zip(found.start, found.end)] == ["これは悪い", "次の文です", "ok", "यह है", "end"]


# --- archives ------------------------------------------------------------------------------


def test_a_task_begins_a_new_archive_when_one_is_full(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    writer = warc.ArchiveWriter(f"file://{tmp_path}", b"")
    rng = np.random.default_rng(1)
    bodies = [rng.bytes(9_000).hex().encode() for _ in range(7)] + [rng.bytes(1_500_000).hex().encode()]  # over one read
    for i, body in enumerate(bodies):
        writer.write(warc.build_record(i, "http://h/", body, warc.payload_digest(body), None))
    writer.close()
    assert len(writer.done) == 3 and sum(n for _, n, _ in writer.done) == len(bodies)
    read = []
    for name, _, size in writer.done:
        raw = (tmp_path / name).read_bytes()
        assert len(raw) == size
        read += [warc.parse_record(r)[1] for r in warc.read_archive(io.BytesIO(raw))]
    assert sorted(read) == sorted(bodies)


@pytest.mark.parametrize("few", [500_000, 0])
def test_first_pages_of_few_and_many_repeats(spark, monkeypatch, few):
    monkeypatch.setattr(warc, "FEW", few)
    html = ["a", "b", "a", None, "", "c", "a", "b"] * 5 + [f"own {i}" for i in range(60)]
    rows = [(None if i == 17 else i, "u", h) for i, h in enumerate(html)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = sorted((-1 if i is None else i, h or "", None if first[h or ""] == i else first[h or ""]) for i, _, h in rows)
    got = [(-1 if r.page_id is None else r.page_id, bytes(r.payload).decode(), r.first) for r in warc.with_first_pages(pages).collect()]
    assert sorted(got, key=str) == sorted(wanted, key=str)


def test_archives_are_read_by_as_many_tasks(spark, tmp_path):
    pages = spark.range(40).selectExpr("id AS page_id", "'u' AS url", "concat('page ', id) AS html").repartition(5)
    manifest = warc.write_archives(pages, f"file://{tmp_path}")
    read = warc.read_archives(manifest, f"file://{tmp_path}")
    assert read.rdd.getNumPartitions() == manifest.count() == 5 and read.count() == 40
