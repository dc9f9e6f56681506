"""Language identification with a string kernel.

Two texts are compared by the blended spectrum they share: the distinct n-grams of
1 to 3 characters (letters in lower case, everything else one space) that both
have, k(x, y) = |G(x) & G(y)| / sqrt(|G(x)| |G(y)|).  A sample of landmark texts
spans the kernel's feature space (Nystrom), one-versus-rest kernel ridge regression
is solved in it, and a batch of texts is scored by two matrix products: n-gram
presence times landmarks, kernel values times coefficients.

A null text, or one without a letter, is ``und`` with score 0.  Of equal scores the
alphabetically first language wins.  Rows that repeat an id are judged one by one,
and one of them is learned from.  Texts of any length are judged whole.  No documents
give no predictions; without labelled ones every text is ``und``.  Other columns are
ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.sampling import held_out, sample, sampled_texts, sized

UNDETERMINED = "und"
_BITS = 19  # n-grams are told apart by so many bits of a hash
_LETTER = re.compile(r"[^\W\d_]")


@dataclass(frozen=True)
class LanguageConfig:
    sample_per_language: int = 200  # labelled documents the model learns from, of each language
    sample_total: int = 2_000  # and of all languages together
    sample_bytes: int = 20_000  # longest text among them
    landmarks: int = 128
    ridge: float = 1e-2


class Grams:
    """Which n-grams a text has; one table, reused from text to text."""

    def __init__(self) -> None:
        self.table = np.zeros(1 << _BITS, np.uint8)
        self.letters: dict[str, str] = _Letters()

    def codes(self, text: str) -> np.ndarray:
        """N-gram codes of a text, with repeats."""
        points = np.frombuffer(text.lower().translate(self.letters).encode("utf-32-le", "surrogatepass"), np.uint32)
        one = points.astype(np.uint64) + np.uint64(1)
        two = one[:-1] * np.uint64(0x100000001B3) + one[1:]
        three = two[:-1] * np.uint64(0x100000001B3) + one[2:]
        parts = []
        for size, grams in enumerate((one, two, three), 1):
            mixed = (grams + np.uint64(size << 56)) * np.uint64(0x9E3779B97F4A7C15)
            parts.append((mixed >> np.uint64(64 - _BITS)).astype(np.int64))
        return np.concatenate(parts)

    def presence(self, text: str, columns: np.ndarray) -> tuple[np.ndarray, int]:
        """Presence of the n-grams in ``columns``, and how many the text has in all."""
        codes = self.codes(text)
        table = self.table
        table[codes] = 1
        row = table[columns]
        total = int(np.count_nonzero(table)) if len(codes) > 50_000 else len(np.unique(codes))
        table[codes] = 0
        return row, total

    def distinct(self, text: str) -> np.ndarray:
        return np.unique(self.codes(text))


class _Letters(dict):
    """Translation table: letters stay, every other character becomes a space."""

    def __missing__(self, point: int) -> int:
        kept = point if chr(point).isalpha() else 32
        self[point] = kept
        return kept


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    columns: np.ndarray  # n-gram codes of the landmarks
    landmarks: np.ndarray  # presence, n-grams x landmarks, scaled by 1 / sqrt(size)
    coefficients: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def scores(self, presence: np.ndarray, totals: np.ndarray) -> np.ndarray:
        kernel = presence.astype(np.float32) @ self.landmarks / np.sqrt(np.maximum(totals, 1))[:, None]
        return kernel @ self.coefficients + self.bias


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def fit(grams: list[np.ndarray], languages: list[str], config: LanguageConfig) -> LanguageModel:
    """Solve the ridge regression on the n-gram sets of labelled texts."""
    names = sorted(set(languages))
    if not names:
        none = np.zeros(0)
        return LanguageModel([], none.astype(np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0)), none)
    truth = np.array([names.index(x) for x in languages])
    rank = np.zeros(len(truth), int)  # landmarks are taken from all languages in turn
    for k in range(len(names)):
        rank[truth == k] = np.arange((truth == k).sum())
    marks = np.lexsort((truth, rank))[: config.landmarks]
    columns = np.unique(np.concatenate([grams[i] for i in marks]))
    landmarks = np.zeros((len(columns), len(marks)), np.float32)
    for k, i in enumerate(marks):
        landmarks[np.searchsorted(columns, grams[i]), k] = 1 / np.sqrt(len(grams[i]))
    kernel = np.empty((len(grams), len(marks)))
    for i, g in enumerate(grams):
        at = np.searchsorted(columns, g)
        at = at[(at < len(columns)) & (columns[np.minimum(at, len(columns) - 1)] == g)]
        kernel[i] = landmarks[at].sum(axis=0) / np.sqrt(max(len(g), 1))
    values, vectors = np.linalg.eigh(kernel[marks])
    kept = values > 1e-6 * values.max()
    root = vectors[:, kept] / np.sqrt(values[kept])
    features = kernel @ root
    target = np.where(truth[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = 1.0 / np.bincount(truth)[truth]  # every language weighs the same
    share /= share.sum()
    center, mean = share @ features, share @ target
    centered = (features - center) * share[:, None]
    gram = centered.T @ (features - center) + config.ridge / len(grams) * np.eye(features.shape[1])
    solved = np.linalg.solve(gram, centered.T @ (target - mean))
    return LanguageModel(names, columns, landmarks, (root @ solved).astype(np.float32), mean - center @ solved)


def train(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> LanguageModel:
    """A model of ``docs(doc_id, text, lang)``; n-gram sets of the bounded sample reach the driver."""
    chosen = sample(sized(docs, "lang"), "lang", config.sample_per_language, config.sample_bytes, config.sample_total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Grams()
        for batch in batches:
            sets = [made.distinct(t) if has_letter(t) else None for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("lang"), pa.array([None if s is None else s.astype(np.int32) for s in sets], pa.list_(pa.int32()))],
                ["doc_id", "lang", "grams"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sampled_texts(docs, chosen, "lang", config.sample_bytes)
    rows = rows.mapInArrow(run, f"doc_id {kind}, lang string, grams array<int>").where("grams IS NOT NULL")
    got = sorted(rows.collect(), key=lambda r: (r.doc_id, r.lang))
    return fit([np.array(r.grams, np.int64) for r in got], [r.lang for r in got], config)


def predict(docs: DataFrame, model: LanguageModel, batch_rows: int = 256) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every document, from its whole text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Grams()
        for batch in batches:
            for a in range(0, batch.num_rows, batch_rows):
                part = batch.slice(a, batch_rows)
                texts = part.column("text").to_pylist()
                known = [k for k, t in enumerate(texts) if model.languages and has_letter(t)]
                names, score = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if known:
                    presence = np.zeros((len(known), len(model.columns)), np.uint8)
                    totals = np.zeros(len(known))
                    for i, k in enumerate(known):
                        presence[i], totals[i] = made.presence(texts[k], model.columns)
                    values = model.scores(presence, totals)
                    best = values.argmax(axis=1)
                    score[known] = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
                    for k, i in zip(known, best):
                        names[k] = model.languages[i]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(names), pa.array(score)],
                    ["doc_id", "held_out", "lang_pred", "score"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")
