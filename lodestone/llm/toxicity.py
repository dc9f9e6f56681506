"""Toxicity by multiple-instance learning: documents are labelled, sentences are scored.

A sentence's score is logistic in the words it contains, of a vocabulary that goes
with toxic documents; the chance that a document is toxic is the noisy-or of its sentences, 1 - prod(1 - p).  Weights are fitted by
gradient descent on the likelihood of the document labels alone, over a bounded
sample, and the fitted sentence scores then locate the offending sentences.

A null text is an empty one; a text without words scores 0.  Rows that repeat an id
are scored one by one; conflicting labels of an id count as toxic, and one row of a
repeated id is learned from.  Texts of any length are scored whole.  Sentences end at
the stops of any script.  No documents give no scores; without labels of both kinds
every score is 0.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import held_out, sample, sampled_texts, sized
from lodestone.llm.textbytes import LOWER, blocks, flat, signed, span_hashes


@dataclass(frozen=True)
class ToxicityConfig:
    sample_per_label: int = 2_000  # documents the model learns from, of each label
    sample_bytes: int = 20_000  # longest text among them
    min_documents: int = 3  # a word counts when so many sampled documents have it
    min_association: float = 20.0  # and its presence goes with the label: chi-square, one in 100,000 by chance
    min_weight: float = 1.0  # words of a smaller weight are dropped and the others fitted again
    steps: int = 300
    rate: float = 0.1
    ridge: float = 1e-4  # on the squared weights, against a likelihood averaged over both labels


_WORD = np.zeros(256, bool)
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


_WIDE_STOPS = [sign.encode() for sign in "。！？．｡।۔"]


def _stops(raw: np.ndarray) -> np.ndarray:
    """The bytes of signs that end a sentence, ASCII or not."""
    stop = _STOP[raw]
    lead = np.flatnonzero(raw >= 0xC0)
    for sign in _WIDE_STOPS:
        at = lead[lead + len(sign) <= len(raw)]
        for i, byte in enumerate(sign):
            at = at[raw[at + i] == byte]
        for i in range(len(sign)):
            stop[at + i] = True
    return stop


@dataclass(frozen=True)
class Sentences:
    """Distinct words of each sentence of a block; sentences without words are left out."""

    word: np.ndarray  # hash, per (sentence, word)
    owner: np.ndarray  # its sentence
    row: np.ndarray  # per sentence
    start: np.ndarray  # bytes of the block
    end: np.ndarray


def sentences(raw: np.ndarray, offsets: np.ndarray) -> Sentences:
    raw = LOWER[raw]
    stop = _stops(raw)
    inside = _WORD[raw] & ~stop
    cut = np.zeros(len(raw) + 1, bool)
    cut[offsets] = True
    if not len(raw):
        none = np.zeros(0, np.int64)
        return Sentences(none.astype(np.uint64), none, none, none, none)
    starts = np.flatnonzero(inside & (~np.append(False, inside[:-1]) | cut[:-1]))
    ends = np.flatnonzero(inside & (~np.append(inside[1:], False) | cut[1:])) + 1
    stops = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(stop, out=stops[1:])
    rows = np.searchsorted(offsets, starts, side="right") - 1
    new = np.ones(len(starts), bool)
    new[1:] = (rows[1:] != rows[:-1]) | (stops[starts[1:]] != stops[starts[:-1]])
    owner = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    word = span_hashes(raw, starts, ends)
    order = np.lexsort((word, owner))
    distinct = np.ones(len(order), bool)
    distinct[1:] = (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    kept = order[distinct]
    return Sentences(word[kept], owner[kept], rows[first], starts[first], ends[last] if len(first) else first)


@dataclass(frozen=True)
class ToxicityModel:
    words: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float

    def logits(self, found: Sentences) -> np.ndarray:
        """The logit of each sentence; a sentence without a learned word is clean."""
        total = np.full(len(found.row), -np.inf)
        if len(self.words) and len(found.word):
            slot, table = self._table()
            at = slot[(found.word >> np.uint64(44)).astype(np.int64)]
            width = int(table)
            hit = np.full(len(found.word), -1)
            for step in range(width):  # words with the same leading bits stand together
                place = np.minimum(at + step, len(self.words) - 1)
                hit = np.where(self.words[place] == found.word, place, hit)
            known = hit >= 0
            told = found.owner[known]
            total[told] = self.bias + np.bincount(told, weights=self.weights[hit[known]], minlength=len(total))[told]
        return total

    def _table(self):
        if not hasattr(self, "_slots"):
            lead = (self.words >> np.uint64(44)).astype(np.int64)
            slots = np.searchsorted(lead, np.arange(1 << 20))
            object.__setattr__(self, "_slots", (slots, np.bincount(lead).max()))
        return self._slots


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0.0, z)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def fit(word: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, config: ToxicityConfig) -> ToxicityModel:
    """Weights for (word, sentence) incidences; ``document`` per sentence, ``label`` per document.

    Full-batch Adam on the noisy-or likelihood.  With S the sum of log(1 + e^z)
    over a document's sentences, its chance of being clean is e^-S.
    """
    none = np.zeros(0)
    if not len(word) or label.min() == label.max():
        return ToxicityModel(none.astype(np.uint64), none, -30.0)
    model = _descend(word, sentence, document, label, config)
    strong = model.words[model.weights >= config.min_weight]
    kept = np.isin(word, strong)  # faint evidence would add up over a long text
    return _descend(word[kept], sentence[kept], document, label, config) if kept.any() else model


def _descend(word: np.ndarray, sentence: np.ndarray, document: np.ndarray, label: np.ndarray, config: ToxicityConfig) -> ToxicityModel:
    words, at = np.unique(word, return_inverse=True)
    pairs = np.unique(np.stack([at, document[sentence]]), axis=1)
    toxic = label[pairs[1]] == 1
    a = np.bincount(pairs[0][toxic], minlength=len(words)).astype(float)  # toxic documents with the word
    b = np.bincount(pairs[0][~toxic], minlength=len(words)).astype(float)
    c, d = (label == 1).sum() - a, (label == 0).sum() - b
    association = len(label) * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d) + 1e-9)
    frequent = (a + b >= config.min_documents) & (association >= config.min_association) & (a * d > b * c)
    number = np.cumsum(frequent) - 1
    used = frequent[at]
    feature = number[at[used]]
    told, owner = np.unique(sentence[used], return_inverse=True)  # sentences with a learned word
    document = document[told]
    n, n_sentences, n_docs = int(frequent.sum()), len(told), len(label)
    parameters = np.zeros(n + 1)
    parameters[n] = -8.0
    mean, square = np.zeros(n + 1), np.zeros(n + 1)
    weight = np.where(label == 1, 0.5 / max(label.sum(), 1), 0.5 / max((1 - label).sum(), 1))
    for step in range(1, config.steps + 1):
        z = np.bincount(owner, weights=parameters[feature], minlength=n_sentences) + parameters[n]
        clean = np.bincount(document, weights=_softplus(z), minlength=n_docs)
        pull = np.where(label == 1, -1.0 / np.maximum(np.expm1(np.minimum(clean, 50.0)), 1e-9), 1.0) * weight
        slope = _sigmoid(z) * pull[document]
        gradient = np.append(np.bincount(feature, weights=slope[owner], minlength=n), slope.sum())
        gradient[:n] += config.ridge * parameters[:n]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient**2
        parameters -= config.rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
    return ToxicityModel(words[frequent], parameters[:n], float(parameters[n]))


def train(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """A model of the documents of ``docs`` that ``labels(doc_id, toxic)`` marks.

    Words of the sampled documents are extracted by Spark; only their hashes, of
    at most ``2 * sample_per_label`` texts of ``sample_bytes``, reach the driver.
    """
    marks = labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = sample(sized(docs).join(marks, "doc_id"), "toxic", config.sample_per_label, config.sample_bytes, 2 * config.sample_per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets):
                found = sentences(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                row = found.row[found.owner] + a
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").take(pa.array(row)),
                        batch.column("toxic").take(pa.array(row)),
                        pa.array(found.owner + (a << 32)),
                        pa.array(signed(found.word)),
                    ],
                    ["doc_id", "toxic", "sentence", "word"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sampled_texts(docs, chosen, "toxic", config.sample_bytes)
    got = rows.mapInArrow(run, f"doc_id {kind}, toxic int, sentence long, word long").toArrow()
    if not got.num_rows:
        return fit(np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int), np.zeros(0, int), config)
    ids, doc = np.unique(got.column("doc_id").to_numpy(), return_inverse=True)
    label = np.zeros(len(ids), int)
    label[doc] = got.column("toxic").to_numpy()
    _, first, sentence = np.unique(
        np.stack([doc, got.column("sentence").to_numpy()]), axis=1, return_index=True, return_inverse=True
    )
    return fit(got.column("word").to_numpy().view(np.uint64), sentence.reshape(-1), doc[first], label, config)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted, n_sentences, offending`` of every document.

    ``offending`` are the character ranges (end exclusive) and scores of the
    sentences that are more likely toxic than not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            for a, b in blocks(offsets):
                part, local = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                found = sentences(part, local)
                z = model.logits(found)
                n = b - a
                clean = np.bincount(found.row, weights=_softplus(z), minlength=n)
                count = np.bincount(found.row, minlength=n)
                chars = np.zeros(len(part) + 1, np.int64)
                np.cumsum((part & 0xC0) != 0x80, out=chars[1:])
                bad = np.flatnonzero(z >= 0)
                base = chars[local[found.row[bad]]]
                spans = pa.StructArray.from_arrays(
                    [
                        pa.array(chars[found.start[bad]] - base),
                        pa.array(chars[found.end[bad]] - base),
                        pa.array(_sigmoid(z[bad])),
                    ],
                    ["start", "end", "score"],
                )
                ends = np.append(0, np.cumsum(np.bincount(found.row[bad], minlength=n))).astype(np.int32)
                chance = -np.expm1(-clean)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id").slice(a, n),
                        batch.column("held_out").slice(a, n),
                        pa.array(chance),
                        pa.array((chance >= 0.5).astype(np.int32)),
                        pa.array(count.astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), spans),
                    ],
                    ["doc_id", "held_out", "score", "predicted", "n_sentences", "offending"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(
        run,
        f"doc_id {kind}, held_out boolean, score double, predicted int, n_sentences long,"
        " offending array<struct<start:long,end:long,score:double>>",
    )
