import hashlib
import os
import random
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import plain_chunkers  # noqa: E402
from lodestone.functions import chunkers  # noqa: E402
from lodestone.functions.text import WHITESPACE  # noqa: E402
from lodestone.operators.chunking import ChunkConfig, chunk_documents, explode_chunks
from lodestone.schemas import UNITS

SCHEMA = "doc int, mime_type string, title string, error string"


def run(spark, docs, config, mime="text/plain"):
    """docs: list of list of (text, metadata)."""
    rows = [(i, mime, None, None, [("u", t, m) for t, m in units]) for i, units in enumerate(docs)]
    df = spark.createDataFrame(rows, f"{SCHEMA}, units {UNITS.simpleString()}")
    out = {i: [] for i in range(len(docs))}
    for r in chunk_documents(df, config).collect():
        assert [c.chunk_index for c in r.chunks] == list(range(len(r.chunks)))
        out[r.doc] = [(c.chunk_text, c.chunk_header) for c in r.chunks]
    return [out[i] for i in range(len(docs))]


def plain(spark, docs, config, mime="text/plain"):
    result = run(spark, [[(t, {}) for t in d] for d in docs], config, mime)
    return [[t for t, _ in d] for d in result]


def rolling_buffer(units, size, overlap):
    """The rolling buffer described step by step, as the check."""
    buf, out = "", []

    def emit(end):
        if buf[:end].strip():
            out.append(buf[:end].strip())

    for u in (u.strip() for u in units):
        if not u:
            continue
        buf = buf + "\n" + u if buf else u
        while len(buf) >= size:
            emit(size)
            buf = "" if len(buf) == size else buf[size - overlap :]
    if buf:
        emit(len(buf))
    return out


@pytest.mark.parametrize("size,overlap", [(10, 3), (7, 0), (5, 4), (12, 6), (100, 20)])
def test_sliding_window_matches_rolling_buffer(spark, size, overlap):
    rng = random.Random(size * 31 + overlap)
    docs = []
    for _ in range(60):
        docs.append(["".join(rng.choice("ab é𝄞\n") for _ in range(rng.randint(0, 25))) for _ in range(rng.randint(0, 6))])
    docs.append(["x" * size, "y" * 3])
    docs.append(["z" * (2 * size - overlap), "w"])
    got = plain(spark, docs, ChunkConfig("sliding_window", size, overlap))
    assert got == [rolling_buffer(d, size, overlap) for d in docs]


def test_sliding_window_needs_progress():
    with pytest.raises(ValueError):
        ChunkConfig("sliding_window", 10, 10)


def test_paragraph_carries_at_least_one(spark):
    got = plain(spark, [["aaaa", "bbbb", "cccc", "dddd"]], ChunkConfig("paragraph", 10, 0))
    assert got == [["aaaa\nbbbb", "bbbb\ncccc", "cccc\ndddd"]]
    got = plain(spark, [["aaaa", "bb", "cc", "dddddd"]], ChunkConfig("paragraph", 12, 5))
    assert got == [["aaaa\nbb\ncc", "bb\ncc\ndddddd"]]


def test_paragraph_oversize_is_split(spark):
    got = plain(spark, [["one two three four", "x"]], ChunkConfig("paragraph", 10, 0))
    assert got == [["one two", "three four", "one two", "three", "four\nx"]]


def test_split_overlap_and_long_token(spark):
    got = plain(spark, [["abcdefghij klm"]], ChunkConfig("unit", 5, 2))
    assert got == [["abcde", "defgh", "ghij", "j klm"]]


def test_section_headers(spark):
    docs = [[("body", {"heading": "# A\n## B"}), ("  ", {"heading": "# Z"}), ("other", {"heading": ""})]]
    assert run(spark, docs, ChunkConfig("auto", 100, 10), "text/markdown") == [[("body", "A > B"), ("other", None)]]
    docs = [[("word " * 10, {"heading": "# H"})]]
    got = run(spark, docs, ChunkConfig("section", 12, 0))[0]
    assert {h for _, h in got} == {"H"} and len(got) == 5
    assert got[0][0] == "word word" and got[-1][0] == "word word"


def test_row_group(spark):
    def row(text, sheet="s", header="h1\th2"):
        return (text, {"sheet": sheet, "headers": header})

    docs = [[row("1\t2"), row("3\t4"), row("5\t6", "t", "k"), row("7\t8"), row("x" * 30)]]
    got = run(spark, docs, ChunkConfig("row_group", 14, 0))[0]
    assert [t for t, _ in got] == ["h1\th2\n1\t2\n3\t4", "h1\th2\n7\t8", "h1\th2\n" + "x" * 30, "k\n5\t6"]
    blank = run(spark, [[row(" ")]], ChunkConfig("row_group", 14, 0))[0]
    assert [t for t, _ in blank] == ["h1\th2"]
    bare = run(spark, [[("a: 1", {}), ("b: 2", {})]], ChunkConfig("auto", 100, 0), "application/json")[0]
    assert [t for t, _ in bare] == ["a: 1\nb: 2"]


def test_auto_unknown_mime_is_an_error(spark):
    df = spark.createDataFrame([(0, "image/png", None, None, [])], f"{SCHEMA}, units {UNITS.simpleString()}")
    assert "no chunk strategy" in chunk_documents(df, ChunkConfig()).first().error


def test_fingerprint_uses_configured_strategy(spark):
    config = ChunkConfig("auto", 100, 10)
    df = spark.createDataFrame(
        [(0, "text/markdown", None, None, [("section", "body", {"heading": "# A"})])], f"{SCHEMA}, units {UNITS.simpleString()}"
    )
    row = explode_chunks(chunk_documents(df, config), config, "doc").first()
    assert row.chunk_hash == hashlib.sha256(b"1|auto|100|10|A\nbody").hexdigest()


def plain_row(rng, sheets):
    return rng.choice(sheets), rng.choice(["h", "h1\th2", ""]), "".join(rng.choice("ab \t") for _ in range(rng.randint(0, 12))).strip()


@pytest.mark.parametrize("seed", range(12))
def test_documents_in_step_match_one_at_a_time(monkeypatch, seed):
    """Random sizes and overlaps, with blanks of all kinds, long words and empty documents."""
    rng = random.Random(seed)
    monkeypatch.setattr(chunkers, "BLOCK_CHARS", rng.choice([1, 50, 10_000]))
    size, overlap = rng.randint(1, 30), rng.randint(0, 35)
    text = lambda most: "".join(rng.choice("ab\u00e9\U0001d504  \n\t\u00a0") for _ in range(rng.randint(0, most))).strip(WHITESPACE)
    docs = [[t for t in (text(60) for _ in range(rng.randint(0, 8))) if t] for _ in range(40)]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    every = [t for d in docs for t in d]
    pieces, counts = chunkers.paragraph_chunks(every, first, size, overlap)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    wanted = [[t for t, _ in plain_chunkers.paragraph_chunks(d, size, overlap)] for d in docs]
    assert [pieces[a:b] for a, b in zip(cuts[:-1], cuts[1:])] == wanted
    pieces, counts = chunkers.split_texts(every, size, overlap)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    assert [pieces[a:b] for a, b in zip(cuts[:-1], cuts[1:])] == [[t for t, _ in plain_chunkers._fit(u, None, size, overlap)] for u in every]

    tables = [[plain_row(rng, ["s", "t", ""]) for _ in range(rng.randint(0, 12))] for _ in range(40)]
    rows = [r for table in tables for r in table]
    first = np.concatenate([[0], np.cumsum([len(t) for t in tables])])
    pieces, counts = chunkers.row_chunks([r[2] for r in rows], [r[0] for r in rows], [r[1] for r in rows], first, size)
    cuts = np.concatenate([[0], np.cumsum(counts)])
    assert [pieces[a:b] for a, b in zip(cuts[:-1], cuts[1:])] == [[t for t, _ in plain_chunkers.row_group_chunks(table, size)] for table in tables]
