"""Quality, repeats, near duplicates, decontamination and pieces on small fixtures."""

import itertools
import os
import sys

import duckdb
import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute  # noqa: E402
from lodestone.llm import decontam, neardup, pieces, quality, repeats  # noqa: E402
from lodestone.llm.phrases import phrases  # noqa: E402
from lodestone.llm.textbytes import SubstringHash, blocks, flat, words  # noqa: E402

WORDS = [f"{a}{b}" for a in "bcdfghklmn" for b in ("a", "ei", "o", "ur", "é")]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(WORDS[i] for i in rng.integers(0, len(WORDS), n))


def edited(text, places):
    parts = text.split(" ")
    for p in places:
        parts[p] = "edited"
    return " ".join(parts)


def corpus():
    base, other = prose(1, 400), prose(2, 300)
    passage = prose(3, 40)
    texts = [
        base, edited(base, [10, 200]), edited(base, range(0, 400, 9)), other, base, None, "", "   ", "one", "one two",
        "one two", "x" * 350, prose(4, 90) + " " + passage + " " + prose(5, 30), passage + " " + prose(6, 120),
        "\n".join(["same line here"] * 60), other.upper(), prose(7, 20_000), passage,
    ]
    return [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def clash(df, *names):
    """The table with columns named like results and internals."""
    for name in names:
        df = df.selectExpr("*", f"'own' AS {name}")
    return df


def test_flat_reads_slices_and_nulls():
    raw, offsets = flat(pa.array(["skip", None, "é b", ""]).slice(1))
    assert raw.tobytes() == "é b".encode() and offsets.tolist() == [0, 0, 4, 4]
    assert list(blocks(np.array([0, 5, 5, 20, 21]), 6)) == [(0, 2), (2, 3), (3, 4)]


def test_words_end_with_their_row():
    starts, ends, first = words(np.frombuffer(b"ab cdef", np.uint8), np.array([0, 5, 5, 7]))
    assert (starts.tolist(), ends.tolist(), first.tolist()) == ([0, 3, 5], [2, 5, 7], [0, 2, 2, 3])


def test_equal_strings_have_their_trigger_at_the_same_place():
    text = prose(11, 200).encode()
    raw = np.frombuffer(text + b"#" * 7 + text[50:400], np.uint8)
    found = phrases(raw, np.array([0, len(raw)]), SubstringHash(raw))
    assert found.count.sum() == len(raw) - 99
    shift = len(text) + 7 - 50
    inner = {(s, c) for s, c in zip(found.start.tolist(), found.count.tolist())}
    moved = [(s, c) for s, c in inner if 200 < s < 250]
    assert moved and all((s + shift, c) in inner for s, c in moved)


def test_quality_counts(docs, none):
    got = {r.doc_id: r for r in quality.judge(clash(docs, "kept", "n_words", "host")).collect()}
    assert len(got) == len(corpus())
    for i, text, *_ in corpus():
        found = brute.WORD.findall(text or "")
        triples = list(zip(found, found[1:], found[2:]))
        covered = {k + d for k, t in enumerate(triples) if triples.count(t) > 1 for d in range(3)} if len(found) < 2000 else None
        assert got[i].n_words == len(found) and got[i].word_chars == sum(map(len, found))
        if covered is not None:
            assert got[i].n_repeat_words == len(covered)
            assert got[i].base_failed == (len(found) < 50 or 100 * len(covered) > 50 * len(found))
    assert got[14].n_dup_lines == 59 and got[5].n_words == 0
    assert quality.judge(none).count() == 0 and quality.passing_documents(none).count() == 0


def test_passing_documents_keep_their_columns(spark):
    good, bad = prose(20, 80), "too short"
    rows = [(i, good if i % 4 else bad, "en", "mixed", 0) for i in range(40)]
    rows += [(100 + i, bad if i < 35 else good, "en", "spam", 0) for i in range(40)] + [(200, good, "en", None, 0)]
    docs = clash(spark.createDataFrame(rows, DOCS), "host", "host_kept")
    for rules in (quality.QualityRules(), quality.QualityRules(broadcast_hosts=0)):
        kept = quality.passing_documents(docs, rules)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i in range(40) if i % 4} | {200}
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    assert {i for i, k in verdict.items() if k} == {i for i in range(40) if i % 4} | {200}


def test_repeats_match_brute_force(docs, none):
    rows = [(r[0], r[1]) for r in corpus()]
    wanted = brute.repeated_bytes(rows)
    got = repeats.removed_spans(clash(docs, "key", "runs", "n_bytes")).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == wanted
    assert all(len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert repeats.removed_spans(none).count() == 0


def test_repeats_in_shares_and_bundles(spark, monkeypatch):
    """Many contexts around one passage, ranked in shares of three and bundles of a few kB."""
    passage = prose(30, 60)
    rows = [(i, f"{prose(100 + i, 30)} {passage} {prose(200 + i, 30)}") for i in range(40)]
    monkeypatch.setattr(repeats, "SHARE", 3)
    monkeypatch.setattr(repeats, "BUNDLE_BYTES", 4096)
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)

    found = list(repeats._matched(_sorted_entries(rows)))
    assert max(b.column("share").to_numpy().max() for b in found if b.num_rows) > 2
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in repeats.removed_spans(docs).collect()}
    assert got == brute.repeated_bytes(rows)


def _sorted_entries(rows):
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows]), pa.array([i for i, _ in rows])], ["text", "key"])
    table = pa.Table.from_batches(list(repeats._parse([batch])))
    table = table.sort_by([(c, "ascending") for c in ("core", "context", "key", "run")])
    return table.to_batches(max_chunksize=7)


def test_repeats_with_repeated_and_null_ids(spark):
    a, b = prose(40, 60), prose(41, 60)
    rows = [(1, a), (1, a), (2, b), (2, a), (None, b), (3, None)]
    got = repeats.removed_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    gone = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed > 0) for r in got)
    # null comes first, so the b of document 2 is a repeat; the first a of document 1 stays
    assert gone == [(-1, False), (1, False), (1, True), (2, True), (2, True), (3, False)]


def test_without_repeats_keeps_text_valid(spark):
    shared = "é" * 120
    rows = [(1, "a" + shared, "en", "s", 121), (2, "ù" + shared + "end", "en", "s", 124), (3, None, "en", "s", 0)]
    docs = clash(spark.createDataFrame(rows, DOCS), "key", "runs", "_absent")
    got = {r.doc_id: r for r in repeats.without_repeats(docs).collect()}
    assert repeats.without_repeats(docs).columns == docs.columns
    assert got[1].text.startswith("a") and got[2].text == "ùend" and got[2].n_chars == 4
    assert got[3].text is None and got[3].key == "own"


@pytest.mark.parametrize("size, percent, block", [(3, 85, 512), (5, 80, 2)])
def test_near_duplicates_match_brute_force(docs, none, size, percent, block):
    config = neardup.NearDupConfig(shingle=size, percent=percent, block=block)
    got = neardup.near_duplicates(clash(docs, "node", "key", "component_id"), config).collect()
    wanted = brute.near_duplicates([(r[0], r[1]) for r in corpus()], size, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    assert neardup.near_duplicates(none, config).count() == 0


def test_group_without_a_common_center(spark):
    """A chain of near copies: each links to the next only, whatever the smallest is."""
    words_ = prose(50, 120).split(" ")
    rows = []
    for i in range(60):
        text = list(words_)
        for k in range(i):
            text[(7 * k) % 120] = f"new{k}"
        rows.append((1000 - i if i % 2 else i, " ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    config = neardup.NearDupConfig(shingle=3, percent=85, block=8, center_share=2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, config).collect()}
    assert got == brute.near_duplicates(rows, 3, 85)


def test_near_duplicates_with_repeated_and_null_ids(spark):
    a, b, c = prose(60, 80), prose(61, 80), prose(62, 80)
    rows = [(5, a), (5, b), (7, edited(a, [3])), (9, edited(b, [4])), (11, c), (None, c), (11, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(docs, neardup.NearDupConfig(shingle=3, percent=85)).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (5, 5), (5, 5), (7, 5), (9, 5), (11, 11), (11, 11)]
    stay = neardup.first_of_each_group(docs, neardup.NearDupConfig(shingle=3, percent=85))
    assert sorted(r.doc_id or -1 for r in stay.collect()) == [-1, 5, 5, 11, 11]


def test_pruning_bounds_grow_with_the_evidence():
    bounds = neardup.pruning_bounds(128, 16, 0.8, 1e-6)
    assert len(bounds) == 8 and (np.diff(bounds) > 0).all() and bounds[-1] < 0.8 * 128


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi"


def benchmark(spark):
    rows = [(4, ITEM), (2, ITEM.title()), (3, None), (5, "too short to be evidence"), (6, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontamination(spark, none):
    changed = ITEM.replace("delta", "x").replace("kappa", "y").replace("pi", "z")
    broken = " ".join(w if i % 3 else "x" for i, w in enumerate(ITEM.split()))
    rows = [
        (1, f"{prose(70, 30)} {ITEM} {prose(71, 30)}"), (2, prose(72, 60) + " " + changed), (3, broken), (4, prose(73, 500)),
        (5, None), (6, ""), (7, ITEM.upper().replace(" ", ", ")), (8, " ".join(ITEM.split()[:9])), (9, " ".join(ITEM.split()[:20])),
        (1, "the other text of one"), (10, "too short to be evidence"),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
    for rules in (decontam.DecontamRules(), decontam.DecontamRules(broadcast_seeds=0)):
        got = {r.doc_id: r for r in decontam.contaminated(clash(docs, "item", "shift"), benchmark(spark), rules).collect()}
        assert set(got) == {1, 2, 7, 9} and got[1].item_ids == [2] and got[1].matched_words == 20
        clean = decontam.clean_documents(clash(docs, "overlaps", "words").drop("overlaps"), benchmark(spark), rules)
        assert sorted(r.doc_id for r in clean.collect()) == [1, 3, 4, 5, 6, 8, 10]
    assert decontam.contaminated(none, benchmark(spark)).count() == 0
    assert decontam.contaminated(docs, benchmark(spark).limit(0)).count() == 0


def test_decontamination_of_documents_without_id(spark):
    rows = [(None, f"{prose(74, 30)} {ITEM}"), (None, prose(75, 60)), (None, ITEM), (1, ITEM), (2, prose(76, 60)), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = decontam.contaminated(docs, benchmark(spark)).collect()
    assert sorted((r.doc_id or -1, r.item_ids) for r in got) == [(-1, [2]), (-1, [2]), (1, [2])]
    clean = decontam.clean_documents(docs, benchmark(spark)).collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in clean) == sorted([(-1, rows[1][1]), (2, rows[4][1]), (-1, "")])


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination_with_a_prompt_that_many_items_share(spark, broadcast):
    """However many items a document is aligned with, a row holds a bounded number of them and none of their words."""
    prompt, ends = prose(77, 12), [prose(820 + k, 9) for k in range(30)]
    items = spark.createDataFrame([(k, f"{prompt} {end}") for k, end in enumerate(ends)], "item_id long, text string")
    rows = [(1, f"{prompt} {ends[3]} {prose(78, 20)} {prompt} {ends[20]}"), (2, f"{prose(79, 5)} {prompt} {prose(80, 40)}")]
    docs = spark.createDataFrame([*rows, (1, rows[1][1]), rows[0], (None, rows[0][1])], "doc_id long, text string")
    rules = decontam.DecontamRules(at_once=7, broadcast_found=broadcast)
    proposed = decontam.alignments(docs, decontam.benchmark_items(items), rules)
    assert proposed.count() >= 4 * 30 and "words" not in proposed.columns
    held = [len(r.proposed) for r in decontam.shares(proposed, rules).collect()]
    assert max(held) == 7 and sum(held) == proposed.count()
    got = [(r.doc_id, r.item_ids, r.matched_words) for r in decontam.contaminated(docs, items, rules).collect()]
    assert sorted(got, key=str) == [(1, [3, 20], 20)] * 2 + [(None, [3, 20], 20)]
    clean = decontam.clean_documents(docs, items, rules).collect()
    assert sorted(r.doc_id for r in clean) == [1, 2] and {r.text for r in clean} == {rows[1][1]}


# The rule without seeds: every shift of every item along every document.
OVERLAPS_SQL = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS dw FROM documents),
items AS (
  SELECT min(item_id) AS item, iw, len(iw) AS n, least(len(iw), 20) AS width FROM (
    SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS iw FROM benchmark)
  WHERE len(iw) >= 6 GROUP BY iw),
shifted AS (SELECT *, unnest(range(width - n, len(dw) - width + 1)) AS shift FROM docs, items),
places AS (SELECT *, unnest(range(greatest(0, -shift), least(n, len(dw) - shift) - width + 1)) AS s FROM shifted),
scored AS (
  SELECT *, len(list_filter(range(s, s + width), lambda k: dw[k + shift + 1] = iw[k + 1])) AS matched FROM places)
SELECT doc_id, list_sort(list(DISTINCT item)) AS item_ids, max(matched) AS matched_words
FROM scored WHERE matched >= CASE WHEN n < 10 THEN width ELSE 0.8 * width END GROUP BY doc_id ORDER BY doc_id"""


@pytest.mark.parametrize("broadcast", [1_000_000, 0])
def test_decontamination_against_the_rule_without_seeds(spark, broadcast):
    """Copies of items of 5 to 45 words with more and more words substituted, between other words or alone."""
    rng = np.random.default_rng(80)
    items = [(n, prose(800 + n, n)) for n in [*range(5, 24), 30, 45]] + [(99, prose(810, 10))]
    rows = []
    for n, text in items:
        for k in range(min(len(text.split(" ")), 20) // 4 + 1):
            for sides in ((0, 0), (4, 9)):
                changed = edited(text, rng.choice(len(text.split(" ")), k, replace=False))
                rows.append((len(rows), " ".join([prose(900 + len(rows), sides[0]), changed, prose(9, sides[1])]).strip()))
        rows += [(len(rows), " ".join(text.split(" ")[:-2])), (len(rows) + 1, " ".join(text.split(" ")[5:]))]
    docs, benchmark = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]}))
    con.register("benchmark", pa.table({"item_id": [i for i, _ in items], "text": [t for _, t in items]}))
    got = decontam.contaminated(docs, benchmark, decontam.DecontamRules(broadcast_seeds=broadcast)).orderBy("doc_id").collect()
    assert [(r.doc_id, r.item_ids, r.matched_words) for r in got] == con.execute(OVERLAPS_SQL).fetchall()
    assert any(r.item_ids == [6] for r in got) and not any(5 in r.item_ids for r in got)


def patterns(n, rules):
    return itertools.combinations(range(n), n - rules.agreeing(n))


def test_no_pattern_of_substitutions_escapes_the_seeds():
    rules = decontam.DecontamRules()
    for n in range(rules.least_words, rules.window + 1):
        seeds = [{p + i for i in mask} for mask in rules.masks for p in range(n - rules.span + 1)]
        fewest = min(sum(not s & set(changed) for s in seeds) for changed in patterns(n, rules))
        assert fewest >= rules.sure_seeds(n) >= 1
    with pytest.raises(ValueError, match="without a common seed"):
        decontam.DecontamRules(least_words=2)
    with pytest.raises(ValueError, match="without a common seed"):
        decontam.DecontamRules(percent=60)
    with pytest.raises(ValueError, match="one span"):
        decontam.DecontamRules(masks=((0, 1, 3), (0, 1)))
    assert all(set(range(rules.span)) - set(mask) for mask in rules.masks)  # every mask ignores a place


def test_every_pattern_of_substitutions_is_found(spark):
    """All patterns within the rule for items of 10, 12, 15, 16 and 20 words, alone in their document."""
    rules = decontam.DecontamRules()
    items = [(n, " ".join(f"i{n}w{k}" for k in range(n))) for n in (10, 12, 15, 16, 20)]
    rows = [(n, edited(text, changed)) for n, text in items for changed in patterns(n, rules)]
    assert len(rows) == 45 + 66 + 455 + 560 + 4845
    docs = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string"), rules).collect()
    assert {r.doc_id: r.item_ids for r in got} == {i: [n] for i, (n, _) in enumerate(rows)}


MODEL = "/opt/tokenizers/piece_bpe_32k.model"
HARD = ["Hello  world\n é 漢 \t x ", "", "   ", " a", "😀😀 ok", "日本語テキスト", "a\0b", "x" * 500, "end　 .", "one▁two"]


def clamped():
    """The library adds scores in single precision; scores of -1e9 would hide all others there."""
    vocabulary = pieces.load_vocabulary(MODEL)
    return vocabulary._replace(scores=[max(s, -40000.0) for s in vocabulary.scores])


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
def test_pieces_agree_with_the_library():
    from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = 1  # best path instead of merges, over the same pieces
    for p in model.pieces:
        p.score = max(p.score, -40000.0)
    library = SentencePieceProcessor(model_proto=model.SerializeToString())
    codec = pieces.Codec(clamped())
    for text in [*HARD, prose(80, 300), edited(prose(81, 50), [3])]:
        assert list(codec.encode(text)) == library.encode(text)
        assert codec.decode(codec.encode(text)).decode() == text.replace("▁", " ")


def best_score(codec, text):
    """The best score of any segmentation, by trying every piece at every place."""
    table = {p: s for p, s, t in zip(codec.vocabulary.pieces, codec.vocabulary.scores, codec.vocabulary.types) if t == pieces.NORMAL}
    best = [0.0] + [float("-inf")] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(max(0, end - 16), end):
            piece = text[start:end]
            score = table.get(piece, codec.unknown_score if len(piece) == 1 else float("-inf"))
            best[end] = max(best[end], best[start] + score)
    return best[-1]


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
def test_pieces_find_the_best_path():
    codec = pieces.Codec(clamped())
    for text in ["unbelievable", "thethethe of", "naïve 漢字", prose(82, 20)]:
        led = "▁" + text.replace(" ", "▁")
        ids = codec.encode(text)
        score = {i: s for i, (s, t) in enumerate(zip(codec.vocabulary.scores, codec.vocabulary.types))}
        unknown = sum(c not in codec.single for c in led)
        plain = [i for i in ids if codec.vocabulary.types[i] == pieces.NORMAL]
        assert sum(score[i] for i in plain) + unknown * codec.unknown_score == pytest.approx(best_score(codec, led))


@pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary")
def test_pieces_in_spark(docs, none):
    vocabulary = pieces.load_vocabulary(MODEL)
    encoded = pieces.encode(clash(docs, "ids", "pieces"), vocabulary)
    got = {r.doc_id: r for r in pieces.decode(encoded, vocabulary).collect()}
    for i, text, *_ in corpus():
        assert got[i].text == text and (got[i].ids is None) == (text is None) and got[i].pieces == "own"
    assert pieces.decode(pieces.encode(none, vocabulary), vocabulary).count() == 0
    marked = docs.sparkSession.createDataFrame([(1, "plain text"), (2, "a▁b"), (3, None), (4, "")], "doc_id long, text string")
    same = {r.doc_id: r.ok for r in pieces.encode(marked, vocabulary, checked="ok").collect()}
    assert same == {1: True, 2: False, 3: None, 4: True}  # the piece mark itself is read back as a space


def test_pieces_without_byte_fallback_or_led_spaces():
    tiny = pieces.Vocabulary(["<unk>", "▁a", "b", "a▁b", "▁"], [0.0, -1.0, -2.0, -0.5, -3.0], [2, 1, 1, 1, 1], 0)
    codec = pieces.Codec(tiny)
    assert codec.segments is None
    assert [tiny.pieces[i] for i in codec.encode("a b??b")] == ["▁", "a▁b", "<unk>", "b"]
