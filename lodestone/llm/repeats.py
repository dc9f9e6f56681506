"""Removal of long repeated strings by prefix-free parsing and truncated suffix order.

A byte is removed when a string of 100 bytes over it also starts earlier in the
corpus.  Texts are parsed into phrases at rolling-hash triggers
(:mod:`lodestone.llm.phrases`); a phrase stands for the run of strings that share
its trigger.  The distinct phrases with the bytes under their strings are the
*dictionary*, their places (document, start) the *parse*:

1. Sorted by (core, context, place), equal dictionary entries meet.  All strings of
   an entry but those at its first place are repeats, whole runs at a time.
2. Only entries with the same core and different contexts can still share strings:
   the edges of repeated passages.  Their suffixes are ranked to a depth of 100
   bytes by prefix doubling, as in the construction of a suffix array, and equal
   suffixes ordered by parse place: every one but the first is a repeat.
3. The runs of repeated starts go back to their documents and become byte spans.

The parse order is ``doc_id`` (null first), then start.  Rows that repeat an id are
ordered by text.  A null text is empty and loses nothing; texts under 100 bytes
lose nothing either.  Texts of any length are parsed whole.  No rows give no rows.
Strings of 100 bytes are told apart by 64-bit hashes; bytes are not compared again.
A null or repeated id makes the whole corpus be ordered and stored once more.
Other columns are ignored by :func:`removed_spans` and kept by
:func:`without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.packing import pack_texts, unpacked
from lodestone.llm.phrases import LENGTH, phrases
from lodestone.llm.textbytes import SubstringHash, blocks, flat, mix, signed
from lodestone.session import work_path

# Dictionary entries of one core that are ranked together; more are ranked share by share.
SHARE = 50_000
# Dictionary bytes ranked at once.
BUNDLE_BYTES = 1024 * 1024

_LOW = np.int64(0xFFFFFFFF)


def _run(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """A run of starts as one long."""
    return (start.astype(np.int64) << 32) | count.astype(np.int64)


def _merged(key: np.ndarray, start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Adjoining runs of one key joined; gives keys and packed runs."""
    if not len(key):
        return key, np.zeros(0, np.int64)
    order = np.lexsort((start, key))
    key, start, count = key[order], start[order], count[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (start[1:] != start[:-1] + count[:-1])
    at = np.flatnonzero(new)
    return key[at], _run(start[at], np.add.reduceat(count, at))


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Dictionary entries at their first place in a block; other places in the block are runs already.

    Rows are ``core, context, key, run``; a run that is known to be repeated has
    a negative sign.
    """
    for batch in batches:
        raw, offsets = flat(batch.column("text"))
        keys = batch.column("key").to_numpy()
        for a, b in blocks(offsets):
            part = raw[offsets[a] : offsets[b]]
            found = phrases(part, offsets[a : b + 1] - offsets[a], SubstringHash(part))
            key = keys[a:b][found.row]
            order = np.lexsort((found.start, key, found.context, found.core))
            first = np.ones(len(order), bool)
            core, context = found.core[order], found.context[order]
            first[1:] = (core[1:] != core[:-1]) | (context[1:] != context[:-1])
            again = order[~first]
            known, runs = _merged(key[again], found.start[again], found.count[again])
            entry = order[first]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(signed(np.concatenate([found.core[entry], mix(known.view(np.uint64))]))),
                    pa.array(signed(np.concatenate([found.context[entry], np.zeros(len(known), np.uint64)]))),
                    pa.array(np.concatenate([key[entry], known])),
                    pa.array(np.concatenate([_run(found.start[entry], found.count[entry]), -runs])),
                ],
                ["core", "context", "key", "run"],
            )


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (core, context, key, run) as repeated runs (``core`` null) and edges.

    Only the last row, how many contexts of its core came before and its first
    entry, if that is still alone, are carried from batch to batch, so a core or an
    entry may have any number of places.
    """
    last_core = last_context = None
    contexts, alone = 0, None
    for batch in batches:
        core, context, key, run = (batch.column(i).to_numpy() for i in range(4))
        known = run < 0
        done_key, done_run = key[known], -run[known]
        core, context, key, run = core[~known], context[~known], key[~known], run[~known]
        edges = []
        if len(core):
            new_core, new_context = np.ones(len(core), bool), np.ones(len(core), bool)
            new_core[1:] = core[1:] != core[:-1]
            new_core[0] = last_core is None or core[0] != last_core
            new_context[1:] = context[1:] != context[:-1]
            new_context[0] = last_context is None or context[0] != last_context
            new_context |= new_core
            group = np.cumsum(new_core)  # 0 is the core that goes on from the last batch
            before = 0 if new_core[0] else contexts
            if new_core[0]:
                alone = None
            running = np.cumsum(new_context)
            begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            base = np.repeat(running[begin] - new_context[begin], np.diff(np.append(begin, len(core))))
            nth = running - base + np.where(group == 0, before, 0)  # contexts of the core so far
            total = nth[np.append(begin[1:], len(core)) - 1]
            several = np.repeat(total, np.diff(np.append(begin, len(core)))) > 1
            done_key = np.concatenate([done_key, key[~new_context]])
            done_run = np.concatenate([done_run, run[~new_context]])
            if alone is not None and group[0] == 0 and total[0] > 1:
                edges.append(alone)
                alone = None
            taken = np.flatnonzero(new_context & several)
            edges.append((core[taken], (nth[taken] - 1) // SHARE, key[taken], run[taken]))
            if total[-1] == 1 and (len(begin) > 1 or new_core[0]):
                at = begin[-1]
                alone = (core[at : at + 1], np.zeros(1, np.int64), key[at : at + 1], run[at : at + 1])
            elif total[-1] > 1:
                alone = None
            last_core, last_context, contexts = core[-1], context[-1], total[-1]
        parts = [np.concatenate(x) for x in zip(*edges)] if edges else [np.zeros(0, np.int64)] * 4
        none = np.zeros(len(done_key), np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([none, parts[0]]), mask=np.arange(len(none) + len(parts[0])) < len(none)),
                pa.array(np.concatenate([none, parts[1]])),
                pa.array(np.concatenate([done_key, parts[2]])),
                pa.array(np.concatenate([done_run, parts[3]])),
            ],
            ["core", "share", "key", "run"],
        )


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each edge with the bytes under its strings."""
    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        keys = batch.column("key").to_pylist()
        edges = batch.column("edges").to_pylist()
        for key, raw, wanted in zip(keys, unpacked(batch.column("packed")), edges):
            text = raw.tobytes()
            for edge in wanted:
                start, count = edge["run"] >> 32, edge["run"] & 0xFFFFFFFF
                row = (edge["core"], edge["share"], edge["split"], key, edge["run"], text[start : start + count - 1 + LENGTH])
                for column, value in zip(out, row):
                    column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.binary()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(out, kinds)], ["core", "share", "split", "key", "run", "context"]
        )


def suffix_ranks(raw: np.ndarray) -> np.ndarray:
    """Rank of every suffix of ``raw`` by its first LENGTH bytes, equal for equal strings.

    Ranks of 8 bytes come from the bytes read as one number; ranks of twice the
    length from pairs of ranks, until LENGTH is covered.
    """
    n = len(raw)
    eight = np.zeros(n, np.uint64)
    for i in range(8):
        eight[: n - i] |= raw[i:].astype(np.uint64) << np.uint64(56 - 8 * i)
    rank, depth = np.unique(eight, return_inverse=True)[1].astype(np.uint64), 8
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        later = np.zeros(n, np.uint64)
        later[: n - step] = rank[step:] + np.uint64(1)
        rank = np.unique(rank * np.uint64(n + 1) + later, return_inverse=True)[1].astype(np.uint64)
        depth += step
    return rank


def _ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated runs among the edges of each (core, share), and first places of cores in several shares.

    Rows sorted by core and share are cut into bundles at changes of (core, share).
    Rows of the output are ``string`` (a hash of the string, null for a repeated
    run), ``key, run``.
    """
    held: list[pa.RecordBatch] = []

    def bundle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        raw, offsets = flat(table.column("context"))
        key, run = table.column("key").to_numpy(), table.column("run").to_numpy()
        split = table.column("split").to_numpy()
        count = run & _LOW
        entry = np.repeat(np.arange(len(key)), count)
        within = np.arange(len(entry)) - np.repeat(np.cumsum(count) - count, count)
        at = offsets[:-1][entry] + within
        rank = suffix_ranks(raw)[at]
        place, start = key[entry], (run >> 32)[entry] + within
        order = np.lexsort((start, place, rank))  # the suffix array, equal strings in parse order
        first = np.ones(len(order), bool)
        first[1:] = rank[order][1:] != rank[order][:-1]
        again = order[~first]
        keys, runs = _merged(place[again], start[again], np.ones(len(again), np.int64))
        lead = order[first]
        lead = lead[split[entry[lead]]]
        strings = signed(SubstringHash(raw)(at[lead], at[lead] + LENGTH)) if len(lead) else np.zeros(0, np.int64)
        blank = np.arange(len(keys) + len(lead)) < len(keys)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.zeros(len(keys), np.int64), strings]), mask=blank),
                pa.array(np.concatenate([keys, place[lead]])),
                pa.array(np.concatenate([runs, _run(start[lead], np.ones(len(lead), np.int64))])),
            ],
            ["string", "key", "run"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.column("context").nbytes for b in held) < BUNDLE_BYTES:
            continue
        table = pa.Table.from_batches(held)
        core, share = table.column("core").to_numpy(), table.column("share").to_numpy()
        other = np.flatnonzero((core != core[-1]) | (share != share[-1]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield from bundle(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from bundle(pa.Table.from_batches(held))


def _later_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings sorted by (string, key, run): all but the first place of each are repeats."""
    last = None
    for batch in batches:
        string = batch.column("string").to_numpy()
        if not len(string):
            continue
        again = np.zeros(len(string), bool)
        again[1:] = string[1:] == string[:-1]
        again[0] = last is not None and string[0] == last
        last = string[-1]
        keep = pa.array(again)
        yield pa.RecordBatch.from_arrays([batch.column("key").filter(keep), batch.column("run").filter(keep)], ["key", "run"])


def _ordered(docs: DataFrame) -> DataFrame:
    """Documents with a unique ``key`` in corpus order: the id itself unless ids repeat or are null."""
    ids = docs.select(F.col("doc_id").cast("long").alias("key"))
    odd = ids.groupBy("key").count().where("key IS NULL OR count > 1")
    if odd.isEmpty():
        return docs.withColumn("key", F.col("doc_id").cast("long"))
    path = work_path(docs.sparkSession, "repeats-ordered")
    others = [F.col(c).asc_nulls_first() for c in ("doc_id", "text")]
    docs.sort(*others).withColumn("key", F.monotonically_increasing_id()).write.parquet(path)
    return docs.sparkSession.read.parquet(path)


def repeated_runs(docs: DataFrame) -> DataFrame:
    """``key, runs``: the repeated starts of each document that has any, as packed runs, unordered."""
    spark = docs.sparkSession

    def stored(df: DataFrame, name: str) -> DataFrame:
        path = work_path(spark, f"repeats-{name}")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    texts = docs.where(F.octet_length("text") >= LENGTH).select("key", "text")
    parsed = texts.mapInArrow(_parse, "core long, context long, key long, run long")
    parsed = parsed.repartition("core").sortWithinPartitions("core", "context", "key", "run")
    found = stored(parsed.mapInArrow(_matched, "core long, share long, key long, run long"), "found")

    edges = found.where("core IS NOT NULL")
    split = edges.where("share > 0").select("core").distinct().withColumn("split", F.lit(True))
    if split.isEmpty():  # no core is so common: nothing to mark, nothing to shuffle for it
        edges = edges.withColumn("split", F.lit(False))
    else:
        edges = edges.join(split, "core", "left").withColumn("split", F.coalesce("split", F.lit(False)))
    edges = edges.groupBy("key").agg(F.collect_list(F.struct("core", "share", "split", "run")).alias("edges"))
    cut = pack_texts(texts).join(edges, "key").select("key", "packed", "edges")
    cut = cut.mapInArrow(_contexts, "core long, share long, split boolean, key long, run long, context binary")
    cut = cut.repartition("core", "share").sortWithinPartitions("core", "share")
    ranked = stored(cut.mapInArrow(_ranked, "string long, key long, run long"), "ranked")

    shared = ranked.where("string IS NOT NULL").repartition("string").sortWithinPartitions("string", "key", "run")
    runs = (
        found.where("core IS NULL").select("key", "run")
        .unionByName(ranked.where("string IS NULL").select("key", "run"))
        .unionByName(shared.mapInArrow(_later_places, "key long, run long"))
    )
    return runs.groupBy("key").agg(F.collect_list("run").alias("runs"))


def removed_mask(n: int, runs: list[int] | None) -> np.ndarray:
    """Which of ``n`` bytes lie under a string that starts in one of the runs."""
    depth = np.zeros(n + 1, np.int64)
    if runs:
        packed = np.array(runs, np.int64)
        start = packed >> 32
        np.add.at(depth, start, 1)
        np.add.at(depth, start + (packed & _LOW) - 1 + LENGTH, -1)
    return np.cumsum(depth[:-1]) > 0


def _with_masks(docs: DataFrame, keep: list[str], run: Callable, schema: str) -> DataFrame:
    ordered = _ordered(docs)
    packed = pack_texts(ordered.select("key", *keep, "text"))
    return packed.join(repeated_runs(ordered), "key", "left").mapInArrow(run, schema)


def removed_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` of every document.

    ``spans`` are the removed byte ranges, end exclusive; ``kept_sha256`` is the
    digest of the remaining bytes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for raw, runs in zip(unpacked(batch.column("packed")), batch.column("runs").to_pylist()):
                gone = removed_mask(len(raw), runs)
                edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]])))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2])]
                kept = hashlib.sha256(raw[~gone].tobytes()).hexdigest()
                for column, value in zip(out, (len(raw), int(gone.sum()), len(spans), kept, spans)):
                    column.append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(out, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _with_masks(
        slim,
        ["doc_id"],
        run,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>",
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every document without its repeated strings, with all its columns; a null text stays null.

    A character goes only when all of its bytes go, so the text stays valid UTF-8.
    An ``n_chars`` column is brought up to date.
    """
    names = docs.columns
    hidden = {c: f"_{i}" for i, c in enumerate(names) if c != "text"}
    inner = docs.select("text", F.col("doc_id"), F.col("text").isNull().alias("_absent"), *(F.col(c).alias(h) for c, h in hidden.items()))
    keep = ["_absent", *hidden.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for raw, runs in zip(unpacked(batch.column("packed")), batch.column("runs").to_pylist()):
                gone = removed_mask(len(raw), runs)
                if gone.any():
                    lead = np.flatnonzero((raw & 0xC0) != 0x80)
                    whole = np.logical_and.reduceat(gone, lead)
                    gone = np.repeat(whole, np.diff(np.append(lead, len(raw))))
                    raw = raw[~gone]
                texts.append(raw.tobytes())
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), text], [*keep, "text"])

    kinds = ", ".join(f"{h} {docs.schema[c].dataType.simpleString()}" for c, h in hidden.items())
    trimmed = _with_masks(inner, keep, run, f"_absent boolean, {kinds}, text string")
    text = F.when(~F.col("_absent"), F.col("text"))
    out = trimmed.select(*(text.alias("text") if c == "text" else F.col(hidden[c]).alias(c) for c in names))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
