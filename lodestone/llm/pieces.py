"""SentencePiece encoding and decoding: one pass of an Aho-Corasick automaton over each text.

The automaton reports, at every position, the vocabulary pieces that end there
(following output links, longest first); each relaxes the best score of that
position from the best score where it starts.  A character that no one-character
piece covers costs ten less than the worst piece and becomes its UTF-8 bytes where
the vocabulary has byte pieces, else the unknown piece.

White space is part of a piece only at its front, so the best path of a text is
the best paths of its space-led segments end to end; segments repeat and are
solved once per worker.  A vocabulary with other pieces is solved text by text.

A null text gives null ids and an empty one none; a text of any length is encoded
whole.  The piece mark U+2581 in a text is read back as a space.  Rows are encoded
one by one, also repeated ones; no rows give no rows.  Ids are for any column named
by the caller; other columns are kept.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestone.llm.textbytes import blocks, flat

SPACE = "▁"
UNKNOWN_PENALTY = 10.0
CACHED_SEGMENTS = 200_000
CACHED_LENGTH = 64  # longer segments are solved where they occur

# Piece types of the model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class Vocabulary(NamedTuple):
    pieces: list[str]
    scores: list[float]
    types: list[int]
    unknown: int
    add_dummy_prefix: bool = True


def load_vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a model file whose normalizer leaves texts as they are."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    normalizer = model.normalizer_spec
    if normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces or not normalizer.escape_whitespaces:
        raise ValueError("the model rewrites texts before it encodes them")
    pieces = [p.piece for p in model.pieces]
    types = [p.type for p in model.pieces]
    return Vocabulary(pieces, [p.score for p in model.pieces], types, types.index(UNKNOWN), normalizer.add_dummy_prefix)


class Codec:
    """Encoder and decoder of one vocabulary, built once per worker."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        v = self.vocabulary = vocabulary
        scores = [s for s, t in zip(v.scores, v.types) if t == NORMAL]
        self.unknown_score = min(scores, default=0.0) - UNKNOWN_PENALTY
        highest = max(scores, default=0.0)
        self.automaton = ahocorasick.Automaton()
        self.single = set()
        for i, (piece, score, kind) in enumerate(zip(v.pieces, v.scores, v.types)):
            if kind not in (NORMAL, USER_DEFINED) or not piece:
                continue
            if kind == USER_DEFINED:
                score = len(piece.encode()) * highest - 0.1
            self.automaton.add_word(piece, (len(piece), score, i))
            if len(piece) == 1:
                self.single.add(piece)
        self.automaton.make_automaton()
        bytes_ = {int(p[1:-1], 16): i for i, (p, t) in enumerate(zip(v.pieces, v.types)) if t == BYTE}
        self.byte_ids = [bytes_[b] for b in range(256)] if len(bytes_) == 256 else None
        matched = [p for p, t in zip(v.pieces, v.types) if t in (NORMAL, USER_DEFINED)]
        led = all(SPACE not in p.lstrip(SPACE) for p in matched)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+") if led else None
        self.surface = [self._surface(p, t) for p, t in zip(v.pieces, v.types)]
        self.solved: dict[str, bytes] = {}

    def _surface(self, piece: str, kind: int) -> bytes:
        if kind == BYTE:
            return bytes([int(piece[1:-1], 16)])
        if kind == CONTROL:
            return b""
        return b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(SPACE, " ").encode()

    def best_path(self, text: str) -> array:
        """Ids of the best segmentation of one segment; of equal scores the longer last piece.

        Pieces that end at one place are reported longest first, and only a better
        score replaces an earlier one.
        """
        n = len(text)
        best = [float("-inf")] * (n + 1)
        best[0] = 0.0
        length, piece = [1] * (n + 1), [-1] * (n + 1)
        matches = self.automaton.iter(text)
        if not self.single.issuperset(text):
            matches = self._with_unknown(text, matches)
        for last, (size, score, number) in matches:
            end = last + 1
            value = best[end - size] + score
            if value > best[end]:
                best[end] = value
                length[end] = size
                piece[end] = number
        path, end = [], n
        while end:
            path.append(end)
            end -= length[end]
        path.reverse()
        ids = array("i", [piece[end] for end in path])
        return self._without_unknown(text, path, ids) if -1 in ids else ids

    def _with_unknown(self, text: str, matches) -> Iterator[tuple]:
        """The matches, and after those of a place its own character where no one-character piece covers it."""
        place = 0
        unknown = (1, self.unknown_score, -1)
        for match in matches:
            while place < match[0]:
                if text[place] not in self.single:
                    yield place, unknown
                place += 1
            yield match
        for last in range(place, len(text)):
            if text[last] not in self.single:
                yield last, unknown

    def _without_unknown(self, text: str, path: list[int], found: array) -> array:
        """Unknown characters as bytes, or a run of them as one unknown piece."""
        ids, before = array("i"), False
        for end, number in zip(path, found):
            if number >= 0:
                ids.append(number)
            elif self.byte_ids:
                ids.extend(self.byte_ids[b] for b in text[end - 1].encode())
            elif not before:
                ids.append(self.vocabulary.unknown)
            before = number < 0
        return ids

    def encode(self, text: str) -> array:
        """The ids of a text."""
        return array("i", self.encoded(text))

    def encoded(self, text: str) -> bytes:
        """The ids of a text as 32-bit integers end to end."""
        if not text:
            return b""
        text = (SPACE if self.vocabulary.add_dummy_prefix else "") + text.replace(" ", SPACE)
        if self.segments is None:
            return self.best_path(text).tobytes()
        solved = self.solved
        if len(solved) >= CACHED_SEGMENTS:
            solved.clear()
        segments = self.segments.findall(text)
        long = {}
        for segment in set(segments).difference(solved):
            path = self.best_path(segment).tobytes()
            (solved if len(segment) <= CACHED_LENGTH else long)[segment] = path
        if long:
            return b"".join([solved.get(s) or long[s] for s in segments])
        return b"".join(map(solved.__getitem__, segments))

    def decode(self, ids) -> bytes:
        """The bytes that the ids stand for, without the space put in front of a text."""
        surface = self.surface
        raw = b"".join([surface[i] for i in ids])
        return raw[1:] if self.vocabulary.add_dummy_prefix and raw[:1] == b" " else raw


_codecs: dict[int, Codec] = {}


def _codec(shared) -> Codec:
    """The worker's codec of a broadcast vocabulary."""
    if shared.id not in _codecs:
        _codecs.clear()
        _codecs[shared.id] = Codec(shared.value)
    return _codecs[shared.id]


def _share(df: DataFrame, vocabulary: Vocabulary):
    broadcast = df.sparkSession.sparkContext.broadcast(vocabulary)

    class Shared(NamedTuple):
        id: int
        broadcast: object

        @property
        def value(self):
            return self.broadcast.value

    return Shared(broadcast._jbroadcast.id(), broadcast)


def _kinds(df: DataFrame, columns: list[str]) -> str:
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


def encode(
    docs: DataFrame, vocabulary: Vocabulary, text: str = "text", into: str = "ids", checked: str | None = None
) -> DataFrame:
    """``docs`` with the piece ids of a text column in place of it; no shuffle.

    ``checked`` names a column that says whether decoding the ids gives the text
    back (null for a null text), found while both are at hand.
    """
    others = [c for c in docs.columns if c not in (text, into, checked)]
    shared = _share(docs, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            column = batch.column(text)
            raw, offsets = flat(column)
            for a, b in blocks(offsets):
                found = [codec.encoded(value or "") for value in column.slice(a, b - a).to_pylist()]
                ends = np.cumsum([0, *map(len, found)]) // 4
                mask = column.slice(a, b - a).is_null()
                values = pa.array(np.frombuffer(b"".join(found), np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), values, mask=mask)
                columns = [*(batch.column(c).slice(a, b - a) for c in others), lists]
                if checked:
                    texts = (raw[x:y].tobytes() for x, y in zip(offsets[a:b], offsets[a + 1 : b + 1]))
                    same = [codec.decode(array("i", ids)) == value for ids, value in zip(found, texts)]
                    columns.append(pa.array(same, mask=mask.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [*others, into, *([checked] if checked else [])]
    kinds = [_kinds(docs, others), f"`{into}` array<int>", f"`{checked}` boolean" if checked else ""]
    schema = ", ".join(filter(None, kinds))
    return docs.select(*others, text).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocabulary: Vocabulary, ids: str = "ids", into: str = "text") -> DataFrame:
    """``encoded`` with the text that the ids stand for; broken byte sequences become U+FFFD."""
    others = [c for c in encoded.columns if c != into]
    shared = _share(encoded, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared)
        for batch in batches:
            column = batch.column(ids)
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            for a, b in blocks(offsets - offsets[0]):
                part = column.slice(a, b - a)
                flat_ids = part.flatten().to_pylist()
                ends = np.cumsum([0, *(0 if n is None else n for n in part.value_lengths().to_pylist())])
                texts = [codec.decode(flat_ids[x:y]).decode("utf-8", "replace") for x, y in zip(ends[:-1], ends[1:])]
                text = pa.array(texts, pa.string(), mask=part.is_null().to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in others), text], [*others, into])

    return encoded.select(*others).mapInArrow(run, f"{_kinds(encoded, others)}, `{into}` string")
