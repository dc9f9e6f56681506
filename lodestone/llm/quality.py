"""Quality rules per document, and per host with an empirical beta prior.

A document fails by itself when it has too few words or consists of repeated
three-word windows.  Hosts are then judged by the share of their documents that
fail: rates of small hosts are drawn towards the corpus by a beta prior fitted to
all hosts, and every document of a host above the limit is refused.

Null text is a text without words.  A null host is no host: its documents stand
on their own rules.  Rows with a repeated ``doc_id`` are judged one by one.  Texts
of any length are counted whole.  No documents give no verdicts, and no host rates.
Other columns are ignored by :func:`base_metrics` and kept by
:func:`passing_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.textbytes import blocks, combine, flat, row_of, span_hashes, words
from lodestone.session import work_path


@dataclass(frozen=True)
class QualityRules:
    min_words: int = 50
    max_repeat_percent: int = 50
    host_limit: float = 0.5  # highest shrunk failure rate of a host that is kept
    max_strength: float = 1e6  # prior weight, in documents, when hosts do not differ
    broadcast_hosts: int = 50_000  # hosts sent whole to every task, at most (names of hosts are short)


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    running = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=running[1:])
    return running[offsets[1:]] - running[offsets[:-1]]


def _block_metrics(raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    rows = len(offsets) - 1
    starts, ends, first = words(raw, offsets)
    n_words = np.diff(first)

    lead = (raw & 0xC0) != 0x80  # first byte of a code point
    running = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(lead, out=running[1:])
    chars = running[ends] - running[starts]
    word_row = np.repeat(np.arange(rows), n_words)
    word_chars = np.bincount(word_row, weights=chars, minlength=rows).astype(np.int64)

    breaks = np.flatnonzero(raw == 10)
    begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    begin_row = np.concatenate([np.arange(rows), np.searchsorted(offsets, breaks, side="right") - 1])
    begin_row = np.sort(begin_row)
    end = np.append(begin[1:] - 1, offsets[-1])
    last = np.append(begin_row[1:] != begin_row[:-1], True)
    end[last] = offsets[1:]
    lines = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    line_row = begin_row[lines]
    line_key = combine([line_row.astype(np.uint64), span_hashes(raw, begin[lines], end[lines])])
    _, kept = np.unique(line_key, return_index=True)
    n_dup_lines = np.bincount(line_row, minlength=rows) - np.bincount(line_row[kept], minlength=rows)

    repeated = np.zeros(len(starts), bool)
    if len(starts) >= 3:
        word_hash = span_hashes(raw, starts, ends)
        window = np.flatnonzero(word_row[2:] == word_row[:-2])
        key = combine([word_row[window].astype(np.uint64), word_hash[window], word_hash[window + 1], word_hash[window + 2]])
        _, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        twice = window[counts[inverse] > 1]
        for step in range(3):
            repeated[twice + step] = True
    return [n_words, word_chars, _per_row(_SYMBOL[raw], offsets), n_dup_lines, _per_row(repeated, first)]


def text_metrics(column: pa.Array) -> list[np.ndarray]:
    """The five counts of every text of an Arrow column."""
    raw, offsets = flat(column)
    parts = [
        _block_metrics(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets)
    ]
    if not parts:
        return [np.zeros(0, np.int64)] * len(METRICS)
    return [np.concatenate(column).astype(np.int64) for column in zip(*parts)]


def _failed(metrics: list[np.ndarray], rules: QualityRules) -> np.ndarray:
    n_words, n_repeat = metrics[0], metrics[4]
    return (n_words < rules.min_words) | (100 * n_repeat > rules.max_repeat_percent * n_words)


def base_metrics(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """``doc_id``, ``host``, the five counts and ``base_failed`` of each document."""
    slim = docs.select("doc_id", F.col(host).alias("host"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            metrics = text_metrics(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("host"), *map(pa.array, metrics), pa.array(_failed(metrics, rules))],
                ["doc_id", "host", *METRICS, "base_failed"],
            )

    id_type = slim.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {id_type}, host string, {', '.join(f'{m} long' for m in METRICS)}, base_failed boolean"
    return slim.withColumn("host", F.col("host").cast("string")).mapInArrow(run, schema)


def host_rates(metrics: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """``host``, documents, failures, shrunk rate and whether the host is kept.

    The prior is fitted by moments over the hosts' raw rates: mean m and variance
    v give the strength m (1 - m) / v - 1, at least 1.  Only these two numbers
    reach the driver.
    """
    hosts = (
        metrics.where(F.col("host").isNotNull())
        .groupBy("host")
        .agg(F.count("*").alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    )
    rate = F.col("failures") / F.col("n")
    fitted = hosts.agg(F.avg(rate).alias("m"), F.avg(rate * rate).alias("s")).first()
    mean = fitted.m or 0.0
    variance = max((fitted.s or 0.0) - mean * mean, 0.0)
    spread = mean * (1 - mean)
    limit = rules.max_strength
    strength = min(max(spread / variance - 1, 1.0), limit) if variance * limit > spread else limit
    shrunk = (F.col("failures") + F.lit(mean * strength)) / (F.col("n") + F.lit(strength))
    return hosts.withColumn("host_rate", shrunk).withColumn("host_kept", shrunk <= rules.host_limit)


def _metrics_table(docs: DataFrame, rules: QualityRules) -> DataFrame:
    """The counts as a table: host rates and verdicts read them without the texts."""
    path = work_path(docs.sparkSession, "quality")
    base_metrics(docs, rules).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def judge(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """Counts, ``base_failed``, ``host_rate`` and the verdict ``kept`` of each document.

    Host verdicts come back by an equi-join on the host.  While there are at most
    ``broadcast_hosts`` of them they are sent to the documents, so a host with a
    third of all documents is not brought together; more are joined by shuffling
    counts, and the adaptive join splits such a host.
    """
    metrics = _metrics_table(docs, rules)
    hosts = host_rates(metrics, rules).select("host", "host_rate", "host_kept")
    path = work_path(docs.sparkSession, "host-rates")
    hosts.write.parquet(path)
    hosts = docs.sparkSession.read.schema(hosts.schema).parquet(path)
    if hosts.count() <= rules.broadcast_hosts:
        hosts = F.broadcast(hosts)
    kept = ~F.col("base_failed") & F.coalesce("host_kept", F.lit(True))
    return metrics.join(hosts, "host", "left").select(
        "doc_id", *METRICS, "base_failed", "host", "host_rate", kept.alias("kept")
    )


def passing_documents(docs: DataFrame, rules: QualityRules = QualityRules(), host: str = "source") -> DataFrame:
    """The documents both verdicts keep, with all their columns.

    The texts are never shuffled: the rules are applied where a text is read, and
    refused hosts are sent to the tasks while their number is within
    ``broadcast_hosts``; more of them are joined by shuffling.
    """
    refused = host_rates(_metrics_table(docs, rules), rules).where(~F.col("host_kept")).select("host")
    path = work_path(docs.sparkSession, "refused-hosts")
    refused.write.parquet(path)
    refused = docs.sparkSession.read.schema(refused.schema).parquet(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            failed = _failed(text_metrics(batch.column("text")), rules)
            yield batch.filter(pa.array(~failed))

    passing = docs.mapInArrow(run, docs.schema)
    few = refused.count() <= rules.broadcast_hosts
    lookup = F.broadcast(refused) if few else refused
    return passing.join(lookup, passing[host].cast("string") == lookup["host"], "left_anti")
