"""A language model by deleted interpolation, counted and applied over all documents.

The model mixes the maximum-likelihood estimates of all n-gram orders with a uniform
share.  Which weights are used depends on the frequency of the longest context that
occurred at all: contexts of one order and one power of two form a *bucket*.  The
weights of each bucket are learned by expectation-maximisation on the counts of a
held-out fold of the training documents, estimated from the other folds; the counts
that score are those of all training documents.

Steps, each a table in the shared folder:

1. *Bundles*: the tokens of some thousand documents as numbers into the bundle's
   own list of word hashes.  Held-out documents have bundles of their own.
2. *Counts*: each bundle sends every distinct n-gram once, with its count, to the part
   of the hash range it falls into, so a frequent n-gram is one row entry per bundle;
   the part adds up and sends each bundle its totals, in the order they came.
3. *Weights*: the held-out tokens, reduced to (counts, count of cases), go through
   some rounds of one small aggregation each.
4. *Scores*: bundles meet their totals, and every document is scored where it is.

Nothing is capped: every n-gram of every training document is counted.  A task holds
one bundle, or one part.  On very large inputs a bundle sends few n-grams to each of
many parts, so the number of shuffled rows tends to that of the distinct n-grams of
all bundles.

Definitions: words are runs without ASCII white space, A-Z in lower case, and one end
follows the words of every text.  A null or empty text is an end alone.  A document
with a null id has no checksum and is learned from.  Rows are scored one by one, also
those that repeat an id.  Words and n-grams are told apart by 64-bit hashes.  A text
is held by one task, like the Arrow batch it comes in.  Other columns are ignored.
Without training documents every token has the uniform share 1 / 1.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import WorkTables
from lodestone.llm.textbytes import LOWER, blocks, combine, flat, mix, span_hashes, words

END, START = (mix(np.array([i], np.uint64))[0] for i in (1, 2))


@dataclass(frozen=True)
class NgramConfig:
    order: int = 2
    folds: int = 16  # one of them is held out
    iterations: int = 15
    prior: float = 0.5  # cases that every component of a bucket has in advance
    bundle_tokens: int = 600_000
    part_grams: int = 600_000


# --- packed arrays ------------------------------------------------------------------


def _pack(values: np.ndarray) -> bytes:
    """Whole numbers, byte plane by byte plane, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _pack_sorted(values: np.ndarray) -> bytes:
    return _pack(np.diff(values, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


# --- bundles ------------------------------------------------------------------------


class _Bundle:
    """Documents of one task that travel together."""

    def __init__(self, held: bool) -> None:
        self.held = held
        self.clear()

    def clear(self) -> None:
        self.ids: list[int | None] = []
        self.train: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.tokens: list[np.ndarray] = []
        self.n_tokens = 0

    def add(self, ids: list, train: np.ndarray, sizes: np.ndarray, tokens: np.ndarray) -> None:
        self.ids += ids
        self.train.append(train)
        self.sizes.append(sizes)
        self.tokens.append(tokens)
        self.n_tokens += len(tokens)

    def row(self) -> pa.RecordBatch:
        train, sizes = np.concatenate(self.train), np.concatenate(self.sizes)
        vocabulary, codes = np.unique(np.concatenate(self.tokens), return_inverse=True)
        row = {
            "bundle": uuid.uuid4().int >> 65,
            "held": self.held,
            "n_tokens": self.n_tokens,
            "n_words": len(vocabulary),
            "train_tokens": int(sizes[train].sum()),
            "train_docs": int(train.sum()),
            "ids": self.ids,
            "train": train.tobytes(),
            "sizes": sizes.astype(np.int64).tobytes(),
            "vocabulary": _pack_sorted(vocabulary),
            "codes": _pack(codes.astype(np.uint32)),
        }
        self.clear()
        return pa.RecordBatch.from_pylist([row], _BUNDLE)


_BUNDLE = pa.schema(
    [("bundle", pa.int64()), ("held", pa.bool_()), ("n_tokens", pa.int64()), ("n_words", pa.int64()), ("train_tokens", pa.int64())]
    + [("train_docs", pa.int64()), ("ids", pa.list_(pa.int64()))]
    + [(c, pa.binary()) for c in ("train", "sizes", "vocabulary", "codes")]
)
BUNDLE = (
    "bundle long, held boolean, n_tokens long, n_words long, train_tokens long, train_docs long, ids array<long>,"
    " train binary, sizes binary, vocabulary binary, codes binary"
)


def _tokens(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block and tokens of each row; an end closes every row."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    return np.insert(span_hashes(raw, starts, ends), first[1:], END), np.diff(first) + 1


def bundles(docs: DataFrame, unseen: Column, config: NgramConfig) -> DataFrame:
    """The documents' tokens in bundles; ``unseen`` marks those that are not learned from."""
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(config.folds)) == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = {held: _Bundle(held) for held in (False, True)}
        for batch in batches:
            raw, offsets = flat(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            train = ~batch.column("unseen").to_numpy(zero_copy_only=False)
            held = train & batch.column("fold").to_numpy(zero_copy_only=False)
            for a, b in blocks(offsets):
                tokens, sizes = _tokens(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for bundle in open_.values():
                    mine = held[a:b] == bundle.held
                    if mine.any():
                        own = [ids[a + k] for k in np.flatnonzero(mine)]
                        bundle.add(own, train[a:b][mine], sizes[mine], tokens[np.repeat(mine, sizes)])
                        if bundle.n_tokens >= config.bundle_tokens:
                            yield bundle.row()
        yield from (bundle.row() for bundle in open_.values() if bundle.ids)

    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(unseen, F.lit(False)).alias("unseen"), fold.alias("fold"), "text"
    )
    return slim.mapInArrow(run, BUNDLE)


class _Opened:
    """A bundle's tokens, documents and n-grams."""

    def __init__(self, row: dict, order: int) -> None:
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.train = np.frombuffer(row["train"], bool)
        codes = _unpack(row["codes"], np.uint32)
        tokens = _unpack_sorted(row["vocabulary"])[codes]
        place = np.arange(len(tokens)) - np.repeat(self.starts, self.sizes)  # of a token in its document
        before = [tokens]
        for k in range(1, order):
            shifted = np.concatenate([np.full(k, START), tokens])[: len(tokens)]
            shifted[place < k] = START
            before.insert(0, shifted)
        self.grams = [np.unique(combine(before[order - k :]), return_inverse=True) for k in range(1, order + 1)]
        self.first = place == 0

    def counts(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Each order with its distinct n-grams and how often training documents have them."""
        learned = np.repeat(self.train, self.sizes)
        for k, (grams, inverse) in enumerate(self.grams, 1):
            yield k, grams, np.bincount(inverse[learned], minlength=len(grams)).astype(np.uint32)

    def columns(self, totals: list[np.ndarray], n: int, docs: int) -> tuple[np.ndarray, np.ndarray]:
        """Counts of every token's n-grams, and of their contexts, a row per order."""
        counts = np.stack([total[inverse].astype(np.int64) for total, (_, inverse) in zip(totals, self.grams)])
        contexts = np.full_like(counts, n)
        for k in range(1, len(counts)):
            contexts[k, 1:] = counts[k - 1, :-1]
            contexts[k, self.first] = docs
        return counts, contexts


# --- counts -------------------------------------------------------------------------


def _sent(coded: DataFrame, parts: list[int], config: NgramConfig) -> DataFrame:
    """``order, part, bundle, held, grams, counts``: every bundle's distinct n-grams, by ranges of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for order, grams, counts in _Opened(row, config.order).counts():
                    n = parts[order - 1]
                    bounds = [(p << 64) // n for p in range(1, n)]
                    cuts = [0, *np.searchsorted(grams, np.array(bounds, np.uint64)).tolist(), len(grams)]
                    out = [
                        {"order": order, "part": p, "bundle": row["bundle"], "held": row["held"],
                         "grams": _pack_sorted(grams[a:b]), "counts": _pack(counts[a:b])}
                        for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])) if b > a
                    ]
                    yield pa.RecordBatch.from_pylist(out, schema)

    schema = pa.schema(
        [("order", pa.int32()), ("part", pa.int32()), ("bundle", pa.int64()), ("held", pa.bool_())]
        + [("grams", pa.binary()), ("counts", pa.binary())]
    )
    columns = ["bundle", "held", "train", "sizes", "vocabulary", "codes"]
    return coded.select(*columns).mapInArrow(run, "order int, part int, bundle long, held boolean, grams binary, counts binary")


def _totals(sent: DataFrame) -> DataFrame:
    """``bundle, order, part, whole, kept, n_whole, n_kept``: what was sent, answered by totals.

    ``whole`` counts all training documents, ``kept`` those that are not held out.
    The numbers of distinct n-grams stand in one row of each part.
    """

    def run(table: pa.Table) -> pa.Table:
        grams = [_unpack_sorted(g.as_py()) for g in table.column("grams")]
        counts = [_unpack(c.as_py(), np.uint32) for c in table.column("counts")]
        held = np.repeat(table.column("held").to_numpy(), [len(g) for g in grams])
        distinct, inverse = np.unique(np.concatenate(grams), return_inverse=True)
        counts = np.concatenate(counts).astype(np.float64)
        kept = np.bincount(inverse, np.where(held, 0, counts), len(distinct)).astype(np.uint64)
        whole = np.bincount(inverse, counts, len(distinct)).astype(np.uint64)
        ends = np.cumsum([len(g) for g in grams])
        zeros = [0] * (len(grams) - 1)
        answered = {"whole": [], "kept": []}
        for a, b, h in zip([0, *ends[:-1]], ends, table.column("held").to_pylist()):
            answered["whole"].append(_pack(whole[inverse[a:b]]))
            answered["kept"].append(_pack(kept[inverse[a:b]]) if h else None)
        return pa.table(
            {"bundle": table.column("bundle"), "order": table.column("order"), "part": table.column("part"),
             "whole": pa.array(answered["whole"], pa.binary()), "kept": pa.array(answered["kept"], pa.binary()),
             "n_whole": pa.array([int((whole > 0).sum()), *zeros], pa.int64()),
             "n_kept": pa.array([int((kept > 0).sum()), *zeros], pa.int64())}
        )

    schema = "bundle long, order int, part int, whole binary, kept binary, n_whole long, n_kept long"
    return sent.groupBy("order", "part").applyInArrow(run, schema)


def _met(coded: DataFrame, totals: DataFrame, which: str) -> DataFrame:
    """Bundles with the totals of their n-grams, a list for each order."""
    answers = totals.groupBy("bundle").agg(F.sort_array(F.collect_list(F.struct("order", "part", which))).alias("answers"))
    return coded.select("bundle", "ids", "train", "sizes", "vocabulary", "codes").join(answers, "bundle")


def _of_order(answers: list[dict], which: str, order: int) -> list[np.ndarray]:
    return [
        np.concatenate([_unpack(a[which], np.uint64) for a in answers if a["order"] == k]) for k in range(1, order + 1)
    ]


# --- weights ------------------------------------------------------------------------


@dataclass(frozen=True)
class _Sizes:
    tokens: int
    docs: int
    types: int


def buckets(contexts: np.ndarray) -> np.ndarray:
    """Of each column: 64 times the longest order whose context occurred, plus the context's power of two.

    The empty context of order 1 has one bucket; 0 is for no training at all.
    """
    out = np.where(contexts[0] > 0, 64, 0)
    for k in range(1, len(contexts)):
        seen = contexts[k] > 0
        out[seen] = 64 * (k + 1) + np.frexp(contexts[k][seen].astype(np.float64))[1] - 1
    return out


def _weight_of(weights: dict[int, list[float]], bucket: int, order: int) -> list[float]:
    """A bucket's weights: its own, else those of the nearest bucket of its order, else equal ones."""
    known = [b for b in weights if b // 64 == bucket // 64]
    if known:
        return weights[min(known, key=lambda b: (abs(b - bucket), b))]
    used = bucket // 64 + 1
    return [1 / used] * used + [0.0] * (order + 1 - used)


def mixture(counts: np.ndarray, contexts: np.ndarray, weights: dict[int, list[float]], types: int) -> np.ndarray:
    """The model's probability of each token."""
    order = len(counts)
    found, inverse = np.unique(buckets(contexts), return_inverse=True)
    table = np.array([_weight_of(weights, int(b), order) for b in found]).reshape(-1, order + 1)
    out = table[inverse, 0] / (types + 1)
    for k in range(order):
        share = np.divide(counts[k], contexts[k], out=np.zeros(len(out)), where=contexts[k] > 0)
        out += table[inverse, k + 1] * share
    return out


def _cases(met: DataFrame, sizes: _Sizes, config: NgramConfig) -> DataFrame:
    """``c1.., x1.., n``: how many held-out tokens have these counts of n-grams and contexts."""
    order = config.order
    names = [f"c{k}" for k in range(1, order + 1)] + [f"x{k}" for k in range(1, order + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                opened = _Opened(row, order)
                both = np.concatenate(opened.columns(_of_order(row["answers"], "kept", order), sizes.tokens, sizes.docs))
                distinct, n = np.unique(both, axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([*map(pa.array, distinct), pa.array(n)], [*names, "n"])

    cases = met.mapInArrow(run, ", ".join(f"{c} long" for c in [*names, "n"]))
    return cases.groupBy(*names).agg(F.sum("n").alias("n"))


def _bucket(order: int) -> Column:
    out = F.when(F.col("x1") > 0, 64).otherwise(0)
    for k in range(2, order + 1):
        out = F.when(F.col(f"x{k}") > 0, 64 * k + F.length(F.bin(f"x{k}")) - 1).otherwise(out)
    return out.cast("int")


def learned_weights(cases: DataFrame, types: int, config: NgramConfig) -> dict[int, list[float]]:
    """Mixture weights of every bucket, uniform share first, by expectation-maximisation.

    Each round is one aggregation over the cases; a bucket's weights (64 buckets an
    order at most) are all that reaches the driver.
    """
    order, spark = config.order, cases.sparkSession
    shares = [F.lit(1 / (types + 1))]
    for k in range(1, order + 1):
        shares.append(F.when(F.col(f"x{k}") > 0, F.col(f"c{k}") / F.col(f"x{k}")).otherwise(0.0))
    rows = cases.select(_bucket(order).alias("bucket"), "n", *[s.alias(f"f{k}") for k, s in enumerate(shares)])
    weights: dict[int, list[float]] = {}
    for b in sorted(r[0] for r in rows.select("bucket").distinct().collect()):
        weights[b] = _weight_of({}, b, order)
    names = [f"w{k}" for k in range(order + 1)]
    for _ in range(config.iterations if weights else 0):
        now = spark.createDataFrame([(b, *w) for b, w in weights.items()], "bucket int, " + ", ".join(f"{c} double" for c in names))
        parts = [F.col(c) * F.col(f"f{k}") for k, c in enumerate(names)]
        total = sum(parts[1:], parts[0])
        mixed = rows.join(F.broadcast(now), "bucket").select("bucket", "n", *[p.alias(f"p{k}") for k, p in enumerate(parts)], total.alias("p"))
        sums = [F.sum(F.col("n") * F.col(f"p{k}") / F.col("p")) for k in range(order + 1)]
        for bucket, *found in mixed.groupBy("bucket").agg(*sums).collect():
            used = bucket // 64 + 1
            whole = sum(found) + config.prior * used
            weights[bucket] = [(x + config.prior) / whole if k < used else 0.0 for k, x in enumerate(found)]
    return weights


# --- scores ---------------------------------------------------------------------------


def _scored(met: DataFrame, weights: dict[int, list[float]], sizes: _Sizes, config: NgramConfig) -> DataFrame:
    order = config.order

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                opened = _Opened(row, order)
                counts, contexts = opened.columns(_of_order(row["answers"], "whole", order), sizes.tokens, sizes.docs)
                add = lambda x: np.add.reduceat(x, opened.starts)
                base = np.log10((counts[0] + 1) / (sizes.tokens + sizes.types + 1))
                score = np.log10(mixture(counts, contexts, weights, sizes.types))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(~opened.train), pa.array(opened.sizes),
                        pa.array(add((counts[0] > 0).astype(np.int64))), pa.array(add(base)), pa.array(add(score)),
                    ],
                    ["doc_id", "unseen", "n_tokens", "n_known", "base_score", "score"],
                )

    return met.mapInArrow(run, "doc_id long, unseen boolean, n_tokens long, n_known long, base_score double, score double")


def language_model_scores(docs: DataFrame, unseen: Column, config: NgramConfig = NgramConfig()) -> DataFrame:
    """``doc_id, unseen, n_tokens, n_known, train_tokens, base_score, score`` for every row.

    Documents where ``unseen`` holds are scored only.  ``base_score`` is the sum of
    log10 of add-one unigram shares, ``score`` that of the interpolated model.
    """
    tables = WorkTables(docs.sparkSession, "ngrams")
    coded = tables.write(bundles(docs, unseen, config), "bundles")
    summed = ["n_tokens", "n_words", "train_tokens", "train_docs"]
    known = {r["held"]: r for r in coded.groupBy("held").agg(*[F.sum(c).alias(c) for c in summed]).collect()}
    total = lambda c, *held: sum(known[h][c] for h in held if h in known)
    share = lambda n: max(1, math.ceil(n / config.part_grams))
    parts = [share(total("n_words", False, True))] + [share(total("n_tokens", False, True))] * (config.order - 1)

    totals = tables.write(_totals(_sent(coded, parts, config)), "totals")
    types = totals.where("order = 1").agg(F.sum("n_whole"), F.sum("n_kept")).first()
    whole = _Sizes(total("train_tokens", False, True), total("train_docs", False, True), types[0] or 0)
    kept = _Sizes(total("train_tokens", False), total("train_docs", False), types[1] or 0)

    held = _met(coded.where("held"), totals.where("kept IS NOT NULL"), "kept")
    cases = tables.write(_cases(held, kept, config), "cases")
    weights = learned_weights(cases, kept.types, config)
    tables.drop(cases)
    scored = _scored(_met(coded, totals, "whole"), weights, whole, config)
    return scored.withColumn("train_tokens", F.lit(whole.tokens).cast("long")).select(
        "doc_id", "unseen", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
