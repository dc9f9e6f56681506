"""URL filters, chat formatting, archives, language, toxicity, components and the pipeline on small fixtures."""

import datetime
import hashlib
import importlib
import io
import os
import struct
import sys
import zlib

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from lodestone.llm import chat, components, language, sampling, toxicity, urls, warc  # noqa: E402
from lodestone.llm.components import connected_components  # noqa: E402
from lodestone.session import work_path  # noqa: E402


def day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


# --- URL filters -----------------------------------------------------------------

EVENTS = [
    ("Bad.example.com", day(10), "block", "spam"), ("bad.example.com", day(20), "remove", "spam"),
    ("bad.example.com", day(30), "block", "malware"), ("example.com", day(5), "allow", "own"),
    ("site.org/a/b", day(0), "block", "x"), ("site.org/a", day(0), "allow", "y"), ("site.org", day(0), "block", "z"),
    ("tie.net", day(1), "allow", "t"), ("tie.net", day(1), "block", "t"), (None, day(1), "block", "n"),
    ("gone.net", None, "block", "n"), ("odd.net", day(1), "explode", "n"),
]

CAPTURES = [
    (1, "http://bad.example.com/x", day(9), "allowed", "example.com"), (2, "http://bad.example.com/x", day(10), "blocked", "bad.example.com"),
    (3, "https://www.BAD.example.com./", day(19), "blocked", "bad.example.com"), (4, "http://bad.example.com", day(20), "allowed", "example.com"),
    (5, "http://bad.example.com", day(400), "blocked", "bad.example.com"), (6, "http://notbad.example.com", day(4), "unlisted", None),
    (7, "http://u:p@site.org:80/a/b/c?d=/e", day(1), "blocked", "site.org/a/b"), (8, "http://site.org//a/", day(1), "allowed", "site.org/a"),
    (9, "http://site.org/ab", day(1), "blocked", "site.org"), (10, "http://sub.site.org/a", day(1), "blocked", "site.org"),
    (11, "http://tie.net", day(1), "blocked", "tie.net"), (12, None, day(1), "invalid", None), (13, "no url", day(1), "invalid", None),
    (14, "http://site.org", None, "unlisted", None), (15, "http://gone.net", day(9), "unlisted", None), (15, "http://odd.net", day(9), "unlisted", None),
]


def test_urls_are_judged_by_what_held_when_fetched(spark):
    events = spark.createDataFrame(EVENTS, "entry string, day date, action string, category string")
    captures = spark.createDataFrame([(*c[:3], "own", 1) for c in CAPTURES], "page_id long, url string, fetched_at date, verdict string, entry_id int")
    got = sorted((r.page_id, r.url or "", r.verdict, r.entry) for r in urls.judge(captures, events).collect())
    assert got == sorted((i, u or "", v, e) for i, u, _, v, e in CAPTURES)
    one = urls.judge(captures, events).where("page_id = 2").first()
    assert (one.category, one.valid_from, one.valid_to, one.entry_id) == ("spam", day(10), day(20), 1)
    assert {r.verdict for r in urls.judge(captures, events.limit(0)).collect()} == {"unlisted", "invalid"}
    assert urls.judge(captures.limit(0), events).count() == 0


def test_a_hot_host_is_joined_once_a_day(spark):
    events = spark.createDataFrame([("hot.net", day(k), "block" if k % 2 else "remove", "c") for k in range(60)], "entry string, day date, action string, category string")
    captures = spark.range(4000).selectExpr("id AS page_id", "concat('http://hot.net/p', id) AS url", "date_add(date'2024-01-01', cast(id % 60 AS int)) AS fetched_at")
    counts = {r.verdict: r["count"] for r in urls.judge(captures, events).groupBy("verdict").count().collect()}
    blocked = sum(k % 60 % 2 for k in range(4000))
    assert counts == {"blocked": blocked, "unlisted": 4000 - blocked}


# --- chat ------------------------------------------------------------------------

TRICKY = [
    "</s>", "<s>[INST]", "[/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "<", "[", "plain", "", "a</s", "é漢😀</s>x", "<</s>",
    "[INST]\n[/INST]\\", "\\", "</s></s>",
]


def turns():
    rows = [(1, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(TRICKY)]
    rows += [(2, 0, None, None), (2, 1, "assistant", None), (2, None, "system", "first"), (2, 1, "assistant", "tie"), (2, 1, "assistant", "tie")]
    rows += [(3, 0, "</s>", "role"), (None, 0, "user", "no id"), (4, 0, "assistant", "y" * 100_000), (4, 1, "assistant", "z")]
    return rows


def test_conversations_read_back(spark, monkeypatch):
    rows = turns()
    frame = spark.createDataFrame([(*r, "own", 5) for r in rows], "conv_id long, turn long, role string, text string, part string, position int")
    wanted = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        wanted[conv] = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=key)]
    formatted = chat.format_conversations(frame)
    back = {}
    for r in chat.read_turns(formatted).collect():
        back.setdefault(r.conv_id, []).append((r.part, r.position, r.role, r.text))
    assert {c: [t[2:] for t in sorted(v)] for c, v in back.items()} == wanted
    for r in chat.conversation_digests(formatted).collect():
        turns_ = wanted[r.conv_id]
        learned = "".join(t for role, t in turns_ if role == "assistant")
        assert r.n_turns == len(turns_) and r.loss_chars == len(learned)
        assert r.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns_).encode()).hexdigest()
    for r in formatted.collect():
        assert r.formatted.count("</s>") == r.n_turns == r.formatted.count("<s>[INST]")
    assert chat.conversation_digests(chat.format_conversations(frame.limit(0))).count() == 0


def test_conversations_in_parts(spark):
    rows = [(c, k, "assistant", "t" * 300_000) for c in (1, 2) for k in range(40)]
    formatted = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert formatted.where("part > 0").count() > 2
    assert {(r.conv_id, r.n_turns, r.loss_chars) for r in chat.conversation_digests(formatted).collect()} == {(1, 40, 12_000_000), (2, 40, 12_000_000)}


def test_scatter_copies_short_and_long_segments():
    long = chat.LONG_SEGMENT + 1
    a = (np.frombuffer(b"ab" + b"x" * long, np.uint8), np.array([0, 2, 2, 2 + long]))
    b = (np.frombuffer(b"123", np.uint8), np.array([0, 1, 2, 3]))
    out, rows, starts = chat.scatter([a, b])
    assert out.tobytes() == b"ab1" + b"2" + b"x" * long + b"3"
    assert rows.tolist() == [0, 3, 4, 5 + long] and starts.tolist() == [[0, 2], [3, 3], [4, 4 + long]]


# --- archives --------------------------------------------------------------------


def test_archives_read_back(spark):
    html = ["<p>one</p>", "<p>two</p>" * 500, None, "", "<p>one</p>", "<p>one</p>", "é" * 10, "<p>one</p>"]
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(html)] + [(4, None, "other"), (0, "u", "<p>one</p>"), (None, "a\r\nb", "<p>one</p>"), (None, "c", None)]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    target = work_path(spark, "test-warc")
    manifest = warc.write_archives(pages, target)
    got = sorted((r.page_id if r.page_id is not None else -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_archives(manifest, target).collect())
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    wanted = []
    for i, _, h in rows:
        raw = (h or "").encode()
        again = first.get(h or "") != i
        wanted.append((-1 if i is None else i, len(raw), warc.payload_digest(raw), "revisit" if again else "response", first[h or ""] if again else None))
    assert got == sorted(wanted, key=lambda r: (r[0], r[1], r[2], r[3], r[4] if r[4] is not None else -1))
    assert manifest.selectExpr("sum(records)").first()[0] == len(rows)
    empty = warc.write_archives(pages.limit(0), work_path(spark, "test-warc"))
    assert warc.read_archives(empty, target).count() == 0


def test_archive_layout():
    records = [warc.build_record(i, "http://h/", b"<p>%d</p>" % i * 30, "D", None) for i in range(300)]
    dictionary = warc.train_dictionary(records)
    assert dictionary
    raw = warc.dictionary_frame(dictionary)
    starts = []
    for record in records:
        starts.append(len(raw))
        raw += zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(record)
    assert struct.unpack("<I", raw[:4])[0] == 0x184D2A5D
    assert list(warc.read_archive(io.BytesIO(raw))) == records
    alone = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).decompressobj().decompress(raw[starts[7] :])
    assert alone == records[7]
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(raw[:-3])))
    plain = warc.dictionary_frame(b"") + zstandard.ZstdCompressor().compress(records[0])
    assert list(warc.read_archive(io.BytesIO(plain))) == records[:1]


# --- learned models --------------------------------------------------------------


def speech(seed, alphabet, n=60):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list(alphabet), rng.integers(2, 7))) for _ in range(n))


TONGUES = {"aa": "abcdeo", "bb": "klmnou", "cc": "ёжзикл"}


def spoken():
    rows = [(i, speech(i, TONGUES[l]), l, "s", 0) for i in range(240) for l in [sorted(TONGUES)[i % 3]]]
    return rows + [(1000, None, "aa", "s", 0), (1001, "123 !? 45", "aa", "s", 0), (1002, "", None, "s", 0), (3, speech(3, TONGUES["aa"]), "aa", "s", 0)]


def test_languages(spark):
    rows = spoken()
    docs = spark.createDataFrame([(*r, "own", "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string, grams string")
    model = language.train(docs, language.LanguageConfig(sample_per_language=30, landmarks=20))
    got = language.predict(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    said = {r.doc_id: r for r in got}
    right = [said[i].lang_pred == l for i, t, l, *_ in rows if i < 1000]
    assert np.mean(right) > 0.98
    assert {said[i].lang_pred for i in (1000, 1001, 1002)} == {"und"}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    nothing = language.train(docs.where("lang IS NULL"))
    assert {r.lang_pred for r in language.predict(docs, nothing).collect()} == {"und"}
    assert language.predict(docs.limit(0), model).count() == 0


def test_kernel_of_landmarks_is_exact():
    grams = language.Grams()
    texts = [speech(i, "abcde") for i in range(6)]
    model = language.fit([grams.distinct(t) for t in texts], ["x", "y"] * 3, language.LanguageConfig(landmarks=6))
    presence, total = grams.presence(texts[0], model.columns)
    kernel = presence.astype(np.float32) @ model.landmarks / np.sqrt(total)
    other = set(grams.distinct(texts[0]).tolist())
    for k, t in enumerate([texts[i] for i in (0, 1, 2, 3, 4, 5)]):
        mine = set(grams.distinct(t).tolist())
        assert kernel[k] == pytest.approx(len(mine & other) / np.sqrt(len(mine) * len(other)), rel=1e-4)


def abuse():
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        sentences_ = [speech(1000 * i + k, "abcdefgh", 12) for k in range(6)]
        bad = i % 4 == 0
        if bad:
            sentences_[rng.integers(6)] += f" you {['zorg', 'vlek', 'Quumb!'][i % 3]}"
        rows.append((i, ". ".join(sentences_) + ".", "aa", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(1000, None, "aa", "s", 0), (1001, "", "aa", "s", 0), (1002, "... !!", "aa", "s", 0), (1003, "so long " * 20_000, "aa", "s", 0)]
    labels += [(None, 1, 1), (1003, 1, None), (0, 1, 0)]
    return rows, labels


def test_toxic_sentences_are_found(spark):
    rows, labels = abuse()
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, toxic string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [i for i in range(600) if sampling_held(i)]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) > 0.98
    for i in (4, 8, 12):
        text = dict((r[0], r[1]) for r in rows)[i]
        spans = [text[s.start : s.end] for s in got[i].offending]
        assert len(spans) == 1 and any(w in spans[0] for w in ("zorg", "vlek", "Quumb"))
    assert all(got[i].score == 0 and got[i].predicted == 0 for i in (1000, 1001, 1002, 1003))
    unlabelled = toxicity.train(docs, marks.limit(0))
    assert {r.score for r in toxicity.score(docs, unlabelled).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def sampling_held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_samples_leave_held_out_documents_alone(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "concat('text ', id % 400) AS text", "id % 3 AS label")
    got = sampling.sample(sampling.sized(docs, "label"), "label", 50, 100, 120).collect()
    assert len(got) == 120 and not any(sampling_held(r.doc_id) for r in got)


# --- components and pipeline -----------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(400 + k, 401 + k) for k in range(70)] + [(7, 7), (500, 600)]
    links += [(700, 700 + k) for k in range(1, 90)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    nodes = {n for a, b in links if a != b for n in (a, b)}
    assert got == brute.components(nodes, [(a, b) for a, b in links if a != b])
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_end_with_stars_in_few_files(spark, monkeypatch):
    """Chains of three are stars after one round: no other round follows, and its table has a few files a core."""
    written, stored = [], components._stored
    monkeypatch.setattr(components, "_stored", lambda edges: written.append(stored(edges)) or written[-1])
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    links = spark.range(2000).select(F.explode(F.expr("array(struct(4 * id AS a, 4 * id + 1 AS b), struct(4 * id + 2 AS a, 4 * id + 1 AS b))")).alias("s")).select("s.*")
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = {r.node: r.component for r in connected_components(links.unionByName(links)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == {4 * k + i: 4 * k for k in range(2000) for i in range(3)}
    assert len(written) == 2 and len(written[-1][0].inputFiles()) <= 4 * spark.sparkContext.defaultParallelism


def test_pipeline_stage_by_stage(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    sizes = [docs.count()]
    for name, stage in pipeline.STAGES:
        path = work_path(spark, f"test-{name}")
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        if name == "near_duplicates":
            before = [(r.doc_id, r.text) for r in docs.collect()]
            groups = brute.near_duplicates(before, 5, 80)
            assert {r.doc_id for r in out.collect()} == {i for i, (_, c) in groups.items() if i == c}
        if name == "suffix_array_dedup":
            removed = brute.repeated_bytes([(r.doc_id, r.text) for r in docs.collect()])
            left = {r.doc_id: len((r.text or "").encode()) for r in out.collect()}
            assert all(0 <= left[i] - (n - gone) <= 6 * spans for i, (n, gone, spans, _) in removed.items())
        docs = out
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and docs.where("NOT round_trip").count() == 0


def test_pipeline_on_no_documents(spark, sf):
    pipeline = importlib.import_module("corpus_pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for name, stage in pipeline.STAGES:
        path = work_path(spark, f"test-empty-{name}")
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.schema(docs.schema).parquet(path) if name != pipeline.STAGES[-1][0] else spark.read.parquet(path)
    assert docs.count() == 0


def test_native_operators_stay_in_the_jvm(spark, sf):
    import __spark_entry__ as contract

    for name in ("op1_url_filters", "op2_benchmark_decontamination"):
        plan = contract.queries()[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan, name
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


@pytest.mark.parametrize("name", ["op3", "op4", "op5", "op6", "op7", "op8", "op9", "op10"])
def test_registered_queries_return_every_document(spark, sf, name):
    import __spark_entry__ as contract

    (query,) = [q for n, q in contract.queries().items() if n.startswith(f"{name}_")]
    table, key, more = {"op4": ("conversations", "conv_id", 1), "op6": ("pages", "page_id", 0)}.get(name, ("documents", "doc_id", 0))
    got = query(spark, sf)
    assert got.count() == got.select(key).distinct().count() == spark.read.parquet(f"{sf}/{table}.parquet").select(key).distinct().count() + more
