"""The prefix trie, the dataset manifest and the language model against brute force."""

import hashlib
import os
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import brute_structures as brute  # noqa: E402
from lodestone.llm import merkle, ngrams, trie  # noqa: E402
from lodestone.llm.textbytes import span_hashes  # noqa: E402

TURNS = "conv_id long, turn long, role string, text string"
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def clash(df, *names):
    for name in names:
        df = df.selectExpr("*", f"'own' AS `{name}`")
    return df


# --- trie -----------------------------------------------------------------------------

NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations(seed, n, most):
    """Turns with few different texts, so that conversations share prefixes of every length."""
    rng = np.random.default_rng(seed)
    said = ["", "a", "é b", "long " * 300, None]
    rows = []
    for conv in range(-7, n):
        if conv % 11 == 3:
            continue
        for turn in range(int(rng.integers(0, most))):
            rows.append((conv, turn if turn else None, ["user", "assistant", None][turn % 3], said[int(rng.integers(0, 5)) if turn > 2 else turn]))
    return rows


@pytest.mark.parametrize(("height", "most"), [(2, 23), (3, 30), (16, 12)])
def test_trie_matches_brute_force(spark, height, most):
    rows = conversations(height, 40, most)
    rows += [(None, 1, "user", "no conversation"), (12, 1, "user", "tie"), (12, 1, "user", "tie"), (12, 1, "system", "tie")]
    rows += [(3, t, "user", f"hot {t % 2}") for t in range(90)]  # one long conversation
    turns = clash(spark.createDataFrame(rows, TURNS).repartition(3), "key", "conv", "group", "pos", "n", "_task", "parent", "path")
    for five, rebuild in ((True, trie.prefix_of_first_in_five), (False, trie.own_turns)):
        found = trie.prefix_trie(turns, rebuild, trie.TrieConfig(height)).select(*NODE).collect()
        assert len(found) == len(set(found))
        assert {tuple(r) for r in found} == brute.trie(rows, five)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], TURNS)).collect() == []
    short = [c for c in range(1, 200) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 1][:3]
    rows = [(c, 0, "user", "gone") for c in short]  # the first of five is absent, and the own turn is among the first h
    found = trie.prefix_trie(spark.createDataFrame(rows, TURNS), trie.prefix_of_first_in_five).select(*NODE).collect()
    ids = hashlib.sha256(",".join(map(str, short)).encode()).hexdigest()
    assert [tuple(r) for r in found] == [(short[0], 0, None, 3, 0, 1, 0, ids)]


def test_lists_of_ids_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE_IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(1000)]
    found = trie.prefix_trie(spark.createDataFrame(rows, TURNS).repartition(5)).where("depth = 1").first()
    assert found.ends_sha256 == hashlib.sha256(",".join(map(str, range(1000))).encode()).hexdigest()


# --- manifest --------------------------------------------------------------------------

VERSION = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def documents(n):
    """A source with a third of all rows, a lone leaf, null and empty values, repeated ids and rows."""
    rows = [(i, "hot" if i % 3 else f"s{i % 11}", ["en", None][i % 2], i * 7, f"Text Ä {i}") for i in range(n)]
    rows += [(5, "hot", "en", 1, "Again"), (5, "hot", "en", 1, "Again"), (None, "hot", None, None, None), (None, None, None, None, "X")]
    rows += [(n + 1, "", "", 0, ""), (n + 2, "lone", "en", 1, None), (n + 3, "é", "en", 1, "WORD " * 20_000), (n + 4, "a", "x", 1, "lower")]
    return rows


def made(docs, config=merkle.MerkleConfig()):
    changed = merkle.lower_cased(F.col("text"))
    return merkle.versions(docs, merkle.marked_for_tampering(F.col("doc_id")), changed, config)


@pytest.mark.parametrize(("arity", "levels"), [(2, 2), (3, 1), (16, 3)])
def test_manifest_matches_brute_force(spark, arity, levels):
    rows = documents(150)
    docs = clash(spark.createDataFrame(rows, DOCS).repartition(4), "leaf", "group", "pos", "tree", "digest", "other", "row", "_task", "copies")
    found = made(docs, merkle.MerkleConfig(arity, levels)).collect()
    assert sorted((tuple(r[c] for c in VERSION) for r in found), key=repr) == brute.manifest(rows, arity)
    assert 0 < sum(not r.verified for r in found) < len(found) / 3
    for r in found:  # a version copies its own ancestors and nothing else
        assert (not r.copies) == r.verified and (r.verified or r.copies[-1] == r.folded_root)


def test_manifest_of_few_rows(spark):
    assert made(spark.createDataFrame([], DOCS)).collect() == []
    row = (1, None, None, None, "Alone")
    only = made(spark.createDataFrame([row], DOCS)).first()
    assert only.leaf == only.subroot == only.root == brute.leaf(*row) and only.proof_sha256 == brute.sha("")
    assert not only.copies and [tuple(only[c] for c in VERSION)] == brute.manifest([row], 16)


# --- language model ------------------------------------------------------------------------

def unseen_of(doc_id):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2


TEXTS = "doc_id long, text string"


def texts(n, seed=1):
    rng = np.random.default_rng(seed)
    names = np.array([f"w{i}" for i in range(30)] + ["Éa", "éa", "UP", "up"])
    rows = [(i, " ".join(rng.choice(names, int(rng.integers(0, 40))))) for i in range(n)]
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "word"), (n + 3, "word"), (None, "no id here"), (n + 4, "w1 w2 " * 9000)]
    return rows + [(n + 5, "x" * 5000 + " " + "x" * 5001)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_match_brute_force(spark, order):
    rows, config = texts(120), ngrams.NgramConfig(order=order, folds=4, bundle_tokens=900, part_grams=200)
    docs = clash(spark.createDataFrame(rows, TEXTS).repartition(3), "unseen", "fold", "bundle", "held", "score", "n_tokens")
    fold = [bool(r[0]) for r in spark.createDataFrame(rows, TEXTS).select(F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(4)) == 0).collect()]
    unseen = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    expected = brute.language_model([t for _, t in rows], unseen, fold, order, config.iterations, config.prior)
    found = ngrams.language_model_scores(docs, unseen_of("doc_id"), config).collect()
    key = lambda r: (repr(r[0]), *r[1:4], round(r[5], 6))
    found = sorted(((r.doc_id, r.unseen, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found), key=key)
    wanted = sorted(((i, u, a, b, n, base, score) for (i, _), u, (a, b, n, base, score) in zip(rows, unseen, expected)), key=key)
    assert [f[:5] for f in found] == [w[:5] for w in wanted]
    assert np.allclose([f[5:] for f in found], [w[5:] for w in wanted], atol=1e-7)


def test_scores_without_training(spark):
    assert ngrams.language_model_scores(spark.createDataFrame([], TEXTS), unseen_of("doc_id")).collect() == []
    ids = [i for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    docs = spark.createDataFrame([(i, "one two") for i in ids], TEXTS)
    found = ngrams.language_model_scores(docs, unseen_of("doc_id")).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in found} == {(3, 0, 0, 0.0, 0.0)}


def test_a_better_fit_for_text_like_the_training(spark):
    """Weights from held-out counts: known sequences score better than the same words shuffled."""
    rng = np.random.default_rng(3)
    cycle = " ".join(f"w{i}" for i in range(50))
    rows = [(i, cycle if i % 2 else " ".join(rng.permutation(cycle.split()))) for i in range(300)]
    got = {r.doc_id: r for r in ngrams.language_model_scores(spark.createDataFrame(rows, TEXTS), unseen_of("doc_id")).collect()}
    ordered, mixed = ([r.score for r in got.values() if r.unseen and r.doc_id % 2 == k] for k in (1, 0))
    assert ordered and mixed and min(ordered) > max(mixed)


def test_mixture_sums_to_one():
    """Over the training vocabulary and one unknown token, the probabilities of a context add up."""
    counts = np.array([[3, 5, 2, 0], [2, 0, 1, 0]])
    contexts = np.array([[10] * 4, [3] * 4])
    weights = {64 * 2 + 1: [0.2, 0.3, 0.5]}
    assert ngrams.mixture(counts, contexts, weights, 3).sum() == pytest.approx(1)
    unseen = np.array([[10] * 4, [0] * 4])
    assert ngrams.mixture(counts, unseen, weights, 3).sum() == pytest.approx(1)


def test_span_hashes_tell_texts_apart():
    """Spans of all lengths, and the pairs on which polynomial hashes modulo a power of two collide."""
    rng = np.random.default_rng(5)
    raw = rng.integers(97, 99, 6000).astype(np.uint8)
    start = rng.integers(0, 4000, 5000)
    end = start + rng.integers(0, 1200, 5000)
    hashes = span_hashes(raw, start, end)
    texts_ = [raw[a:b].tobytes() for a, b in zip(start, end)]
    assert len(set(texts_)) == len(set(hashes.tolist()))
    assert len({(t, h) for t, h in zip(texts_, hashes.tolist())}) == len(set(texts_))
    for size in (1024, 2048, 4096):
        bits = np.array([bin(i).count("1") % 2 for i in range(size)], np.uint8)
        both = np.concatenate([bits + 97, 98 - bits])
        assert len(set(span_hashes(both, np.array([0, size]), np.array([size, 2 * size])).tolist())) == 2
