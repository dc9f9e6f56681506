"""Near-duplicate documents: banded MinHash, sequential Bayesian pruning, exact verification.

Every step is a table in the shared folder:

1. *Signatures*: the distinct word shingles of each whole text, one byte per
   MinHash value for comparison, one 64-bit key per band for lookup.
2. *Classes*: documents with equal shingle sets are one node from here on.
3. *Stars*: in every band bucket each class is compared with the smallest class.
   Signature bytes are compared batch by batch; after each batch a pair is dropped
   once the posterior chance that it reaches the limit falls below ``miss``.
   Survivors are verified on full shingle sets, and verified links merged.
4. *Rest*: buckets whose classes are still in several components are compared
   across components, in blocks, by the same pruning and verification.  Pairs live
   inside a task only; a group returns at most one link for each member.

Texts are compared in the few tasks that verify pairs: those of other documents are
left out before they are packed or moved.  Each work table goes when its successor is
written; the result reads two narrow ones.

Definitions: a null text or one without words has no shingles and links with
nothing.  Rows that share a ``doc_id`` are one document: each of their texts can
link it.  A row with null ``doc_id`` cannot be named and is linked with nothing.
Of a group the smallest id stays.  A text of any length is one row in every step.
An empty table has an empty result.  Other columns are ignored, or kept by
:func:`first_of_each_group`, whatever their names.  Words are told apart by 64-bit
hashes that mix eight bytes at a time.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.components import rooted
from lodestone.llm.membership import with_ids, without_ids
from lodestone.llm.packing import pack_texts, unpacked
from lodestone.llm.tables import WorkTables, in_few_files
from lodestone.llm.textbytes import LOWER, blocks, combine, flat, mix, signed, span_hashes, words


PAIRS = 200_000  # compared at once; bounds memory only


@dataclass(frozen=True)
class NearDupConfig:
    shingle: int = 5  # words
    percent: int = 80  # link when 100 * intersection >= percent * union
    bands: int = 32
    rows: int = 5  # MinHash values per band
    batch: int = 16  # signature bytes compared before each pruning decision
    miss: float = 1e-6  # chance, per decision, of dropping a pair at the limit
    block: int = 2048  # members of a bucket compared with each other at once
    center_share: int = 2000  # comparisons with one document per task group
    few_ids: int = 500_000  # ids sent whole to every task, at most; of more a bitmap of 4 MB is sent

    @property
    def values(self) -> int:
        return self.bands * self.rows


# --- signatures ----------------------------------------------------------------


@cache
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    factor = rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    return factor[:, None], rng.integers(0, 1 << 32, n, dtype=np.uint64).astype(np.uint32)[:, None]


def _minima(shingles: np.ndarray, n: int) -> np.ndarray:
    factor, shift = _permutations(n)
    short = (shingles >> np.uint64(32)).astype(np.uint32)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for a in range(0, len(short), 4096):
        np.minimum(out, (short[a : a + 4096] * factor + shift).min(axis=1), out=out)
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row of a block."""
    raw = LOWER[raw]
    starts, ends, first = words(raw, offsets)
    hashes = span_hashes(raw, starts, ends)
    count = len(hashes) - size + 1
    windows = combine([hashes[i : i + count] for i in range(size)]) if count > 0 else hashes[:0]
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(windows[a : b - size + 1])
        elif b > a:
            yield combine([hashes[i : i + 1] for i in range(a, b)])
        else:
            yield hashes[:0]


def _sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    raw, offsets = flat(column)
    for a, b in blocks(offsets):
        yield from shingle_sets(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], size)


def signatures(docs: DataFrame, config: NearDupConfig) -> DataFrame:
    """``doc_id, n_shingles, h1, h2, bands, sig``: the set's size, identity, band keys and comparison bytes."""
    n, rows = config.values, config.rows
    salt = mix(np.arange(1, config.bands + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, h1, h2, minima = [], [], [], []
            for shingles in _sets(batch.column("text"), config.shingle):
                size.append(len(shingles))
                h1.append(np.add.reduce(shingles))
                h2.append(np.bitwise_xor.reduce(mix(shingles + np.uint64(0x5851F42D4C957F2D))))
                minima.append(_minima(shingles, n))
            if not size:
                continue
            low = np.stack(minima)
            bands = [salt[None, :].repeat(len(low), 0)] + [low[:, i::rows].astype(np.uint64) for i in range(rows)]
            sig = ((low * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)
            keys = pa.array(signed(combine(bands).reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.array(size, np.int64)),
                    pa.array(signed(np.array(h1, np.uint64))),
                    pa.array(signed(np.array(h2, np.uint64))),
                    pa.ListArray.from_arrays(np.arange(0, len(keys) + 1, config.bands, dtype=np.int32), keys),
                    pa.array([row.tobytes() for row in sig], pa.binary()),
                ],
                ["doc_id", "n_shingles", "h1", "h2", "bands", "sig"],
            )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return slim.mapInArrow(run, "doc_id long, n_shingles long, h1 long, h2 long, bands array<long>, sig binary")


# --- Bayesian pruning ----------------------------------------------------------


@cache
def pruning_bounds(values: int, batch: int, limit: float, miss: float) -> np.ndarray:
    """Fewest matches to go on with, after each batch.

    A uniform prior on the similarity and m matches in n values give a beta
    posterior; its mass above the limit is the chance of at most m successes in
    n + 1 trials at the limit.  Bytes of different values agree once in 256.
    """
    p = limit + (1 - limit) / 256
    bounds = []
    for n in range(batch, values + 1, batch):
        tail, m = 0.0, -1
        while tail < miss:
            m += 1
            tail += math.exp(
                math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m)
                + m * math.log(p) + (n + 1 - m) * math.log1p(-p)
            )
        bounds.append(m)
    return np.array(bounds)


def surviving(left: np.ndarray, right: np.ndarray, i: np.ndarray, j: np.ndarray, config: NearDupConfig):
    """Which pairs (row i of left, row j of right) survive, and their matches over all values."""
    alive, matches = np.arange(len(i)), np.zeros(len(i), np.int64)
    for step, bound in enumerate(pruning_bounds(config.values, config.batch, config.percent / 100, config.miss)):
        part = slice(step * config.batch, (step + 1) * config.batch)
        same = left[i[alive], part] == right[j[alive], part]
        matches[alive] += same.sum(axis=1)
        alive = alive[matches[alive] >= bound]
        if not len(alive):
            break
    return alive, matches[alive]


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    raw, _ = flat(column)
    return raw.reshape(-1, width)


def _groups_of(table: pa.Table) -> np.ndarray:
    """Where each group (key, x, y) of a sorted table begins, and its end."""
    new = np.zeros(table.num_rows, bool)
    new[0] = True
    for c in ("key", "x", "y"):
        new[1:] |= np.diff(table.column(c).to_numpy()) != 0
    return np.append(np.flatnonzero(new), table.num_rows)


def _bundles(table: pa.Table) -> Iterator[pa.Table]:
    """Runs of whole groups with about ``PAIRS`` pairs in all."""
    bounds = _groups_of(table)
    pairs = np.cumsum(np.diff(bounds).astype(np.int64) ** 2)
    a = 0
    while a < len(pairs):
        b = int(np.searchsorted(pairs, (pairs[a - 1] if a else 0) + PAIRS, side="right"))
        b = max(b, a + 1)
        yield table.slice(bounds[a], bounds[b] - bounds[a])
        a = b


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by (key, x, y) in small tables that end where a group does."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        cut = int(_groups_of(table)[-2])
        if cut:
            yield from _bundles(table.slice(0, cut))
        held = table.slice(cut).to_batches()
    if held:
        yield from _bundles(pa.Table.from_batches(held).combine_chunks())


def _surviving_pairs(table: pa.Table, config: NearDupConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pairs of one group but different components that survive pruning, and each row's group."""
    number = {c: table.column(c).to_numpy() for c in ("x", "y", "own", "component", "n_shingles")}
    sig = _matrix(table.column("sig"), config.values)
    bounds = _groups_of(table)
    group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    ends = bounds[1:][group]
    later = ends - np.arange(len(sig)) - 1  # members after each row in its group
    left, right, a = [], [], 0
    while a < len(sig):
        b = max(int(np.searchsorted(np.cumsum(later[a:]), PAIRS, side="right")) + a, a + 1)
        i = np.repeat(np.arange(a, b), later[a:b])
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later[a:b]) - later[a:b], later[a:b])
        small = np.minimum(number["n_shingles"][i], number["n_shingles"][j])
        large = np.maximum(number["n_shingles"][i], number["n_shingles"][j])
        wanted = (number["x"][i] == number["y"][i]) | (number["own"][i] != number["own"][j])
        wanted &= (number["component"][i] != number["component"][j]) & (100 * small >= config.percent * large)
        i, j = i[wanted], j[wanted]
        alive, _ = surviving(sig, sig, i, j, config)
        left.append(i[alive])
        right.append(j[alive])
        a = b
    return np.concatenate(left), np.concatenate(right), group


def _connect(members: pa.Table, left: np.ndarray, right: np.ndarray, a: int, b: int, config: NearDupConfig):
    """Verified links of the group in rows a to b, as pairs of components, one for each join of two."""
    at = slice(*np.searchsorted(left, [a, b]))
    left, right = left[at] - a, right[at] - a
    if not len(left):
        return
    sets = [next(shingle_sets(raw, np.array([0, len(raw)]), config.shingle)) for raw in unpacked(members.column("packed").combine_chunks())]
    size = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), size)
    _, shingle = np.unique(np.concatenate(sets), return_inverse=True)
    posting = owner[np.argsort(shingle, kind="stable")]
    start = np.searchsorted(np.sort(shingle), np.arange(shingle.max() + 2))
    first = np.cumsum(size) - size
    parent = {c: c for c in set(members.column("component").to_pylist())}
    component = members.column("component").to_pylist()

    def root(c):
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    for i in np.unique(left).tolist():
        partners = right[slice(*np.searchsorted(left, [i, i + 1]))]
        if len({root(component[j]) for j in partners.tolist()} | {root(component[i])}) == 1:
            continue
        mine = shingle[first[i] : first[i] + size[i]]
        count = start[mine + 1] - start[mine]
        places = np.arange(count.sum()) + np.repeat(start[mine] - (np.cumsum(count) - count), count)
        both = np.bincount(posting[places], minlength=len(sets))[partners]
        linked = partners[100 * both >= config.percent * (size[i] + size[partners] - both)]
        for j in linked.tolist():
            x, y = root(component[i]), root(component[j])
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield component[i], component[j]


# --- steps ---------------------------------------------------------------------


class _Run:
    def __init__(self, docs: DataFrame, config: NearDupConfig) -> None:
        self.docs, self.config, self.spark = docs, config, docs.sparkSession
        self.tables = WorkTables(self.spark, "neardup")

    def shared_buckets(self, classes: DataFrame) -> DataFrame:
        """``key, node, head, n`` of every bucket with more than one class; ``head`` is its smallest."""
        buckets = classes.select("node", F.explode("bands").alias("key"))
        heads = buckets.groupBy("key").agg(F.min("node").alias("head"), F.count("*").alias("n")).where("n > 1")
        return buckets.join(heads, "key").select("key", "node", "head", "n")

    def star_pairs(self, buckets: DataFrame, classes: DataFrame) -> DataFrame:
        """Each class with the smallest class of each of its buckets, pruned by size and signature."""
        config = self.config
        pairs = buckets.where("node != head").select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()
        side = classes.select("node", "n_shingles", "sig")
        joined = pairs.join(side.toDF("a", "na", "sa"), "a").join(side.toDF("b", "nb", "sb"), "b")
        joined = joined.where(100 * F.least("na", "nb") >= config.percent * F.greatest("na", "nb"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                left, right = (_matrix(batch.column(c), config.values) for c in ("sa", "sb"))
                every = np.arange(len(left))
                alive, matches = surviving(left, right, every, every, config)
                taken = pa.array(alive)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("a").take(taken), batch.column("b").take(taken), pa.array(matches)], ["a", "b", "matches"]
                )

        return joined.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, matches long")

    def open_groups(self, buckets: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
        """Members of buckets that hold several components, in groups to be settled.

        A bucket of two was settled by its star.  Buckets with the same members
        are taken once.  A bucket above ``block`` members is cut into blocks, and
        each pair of blocks is a group of its own: no pair is left out, and a task
        holds two blocks at most.  Only members with a surviving pair across
        components are returned, never the pairs.
        """
        config = self.config
        known = buckets.where("n > 2").select("key", "node").join(labels.toDF("node", "component"), "node", "left")
        known = known.withColumn("component", F.coalesce("component", "node"))
        open_ = (
            known.groupBy("key")
            .agg(
                F.count("*").alias("n"),
                F.min("component").alias("low"),
                F.max("component").alias("high"),
                F.bit_xor(F.xxhash64("node")).alias("members"),
            )
            .where("low != high")
            .groupBy("members", "n")
            .agg(F.min("key").alias("key"))
            .select("key", F.ceil(F.col("n") / config.block).cast("int").alias("parts"))
        )
        own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
        rows = known.join(open_, "key").withColumn("own", own)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        rows = rows.select(
            "key", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "node", "component"
        )
        rows = rows.join(classes.select("node", "n_shingles", "sig"), "node")
        rows = rows.select("key", "x", "y", "own", "node", "component", "n_shingles", "sig")
        rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own", "node")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_groups(batches):
                left, right, _ = _surviving_pairs(table, config)
                used = np.zeros(table.num_rows, bool)
                used[left] = used[right] = True
                yield from table.filter(pa.array(used)).combine_chunks().to_batches()

        return rows.mapInArrow(run, rows.schema)

    def settled(self, groups: DataFrame) -> DataFrame:
        """Pairs of linked components inside each group, enough to connect what its pairs connect.

        The surviving pairs of a group are verified on full shingle sets, a member
        against all its partners at once through the group's postings.  Of the
        links between two components one is returned.
        """
        config = self.config
        texts = self.packed(groups.select(F.col("node").alias("id")))
        rows = groups.join(texts.withColumnRenamed("doc", "node"), "node")
        rows = rows.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y", "own", "node")
        rows = rows.select("key", "x", "y", "own", "node", "component", "n_shingles", "sig", "packed")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for table in _whole_groups(batches):
                left, right, group = _surviving_pairs(table, config)
                order = np.lexsort((right, left))
                left, right = left[order], right[order]
                bounds = np.flatnonzero(np.append(True, np.diff(group) != 0)).tolist() + [table.num_rows]
                links = [
                    link
                    for a, b in zip(bounds[:-1], bounds[1:])
                    for link in _connect(table.slice(a, b - a), left, right, a, b, config)
                ]
                x, y = zip(*links) if links else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

        return rows.mapInArrow(run, "a long, b long")

    def packed(self, wanted: DataFrame) -> DataFrame:
        """``doc, packed`` of the documents in ``wanted(id)``; the others are left out before anything moves."""
        ids = self.tables.write(in_few_files(wanted.distinct()), "wanted")
        texts = self.docs.select(F.col("doc_id").cast("long").alias("doc"), "text")
        texts = texts.where("doc IS NOT NULL AND text IS NOT NULL")
        return pack_texts(with_ids(texts, "doc", ids, self.config.few_ids))

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose full shingle sets reach the limit.

        A text travels compressed to the comparisons that need it.  Comparisons
        are grouped by ``b``; its text is repeated for every ``center_share`` of
        them, so a document with many partners is spread over tasks.
        """
        config = self.config
        shares = pairs.groupBy("b").agg(F.ceil(F.count("*") / config.center_share).cast("int").alias("shares"))
        shared = pairs.join(shares, "b").withColumn("share", F.pmod(F.xxhash64("a"), F.col("shares")).cast("int"))
        members = shared.select(F.col("a").alias("doc"), "b", "share", F.lit(1).alias("role"))
        centers = shares.select(
            F.col("b").alias("doc"), "b", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(0).alias("role")
        )

        placed = members.unionByName(centers)
        rows = self.packed(pairs.select(F.explode(F.array("a", "b")).alias("id"))).join(placed, "doc")
        rows = rows.repartition("b", "share").sortWithinPartitions("b", "share", "role")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            center, sets = None, []
            for batch in batches:
                docs, b, share, role = (batch.column(c).to_pylist() for c in ("doc", "b", "share", "role"))
                linked = []
                for k, raw in enumerate(unpacked(batch.column("packed"))):
                    mine = next(shingle_sets(raw, np.array([0, len(raw)]), config.shingle))
                    if center != (b[k], share[k]):
                        center, sets = (b[k], share[k]), []
                    if role[k] == 0:
                        sets.append(mine)
                        continue
                    for other in sets:
                        if not len(mine) or not len(other):
                            continue
                        small, large = (mine, other) if len(mine) < len(other) else (other, mine)
                        at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                        both = int((large[at] == small).sum())
                        if 100 * both >= config.percent * (len(mine) + len(other) - both):
                            linked.append((docs[k], b[k]))
                            break
                left, right = zip(*linked) if linked else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

        return rows.select("doc", "b", "share", "role", "packed").mapInArrow(run, "a long, b long")


def _grouped(docs: DataFrame, config: NearDupConfig) -> tuple[DataFrame, WorkTables]:
    """The rows of :func:`near_duplicates`, and the tables they are read from."""
    run = _Run(docs, config)
    tables = run.tables
    sigs = tables.write(signatures(docs, config), "signatures")
    same = ["h1", "h2", "n_shingles"]
    classes = (
        sigs.where("doc_id IS NOT NULL AND n_shingles > 0")
        .groupBy(*same)
        .agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    )
    classes = tables.write(in_few_files(classes), "classes")
    nodes = sigs.select("doc_id", *same).join(classes.select("node", *same), same, "left")
    nodes = nodes.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node"))
    members = tables.write(nodes, "members")
    tables.drop(sigs)

    # Rows that repeat an id tie the classes of their texts together.
    placed = members.where("node IS NOT NULL")
    ties = placed.groupBy("doc_id").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b != most")
    ties = placed.join(ties, "doc_id").where("node != b").select(F.col("node").alias("a"), "b")

    buckets = tables.write(run.shared_buckets(classes), "buckets")
    stars = tables.write(run.star_pairs(buckets, classes), "stars")
    labels = rooted(run.verified(stars).unionByName(ties))
    tables.drop_others(members, classes, buckets)

    open_ = tables.write(run.open_groups(buckets, classes, labels), "open")
    tables.drop(classes, buckets)
    merged = rooted(run.settled(open_))  # of the components so far, which the rest ties together
    tables.drop_others(members)

    named = placed.join(labels.toDF("node", "first"), "node", "left").withColumn("first", F.coalesce("first", "node"))
    named = named.join(merged.toDF("first", "last"), "first", "left")
    named = named.select("doc_id", F.coalesce("last", "first").alias("component"))
    named = named.groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = members.select("doc_id", "n_shingles").join(named, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept")), tables


def near_duplicates(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest ``doc_id`` reachable over links; ``kept`` marks
    the document of that id.  A null ``doc_id`` has a null component and is kept.
    """
    return _grouped(docs, config)[0]


def first_of_each_group(docs: DataFrame, config: NearDupConfig = NearDupConfig()) -> DataFrame:
    """The documents that :func:`near_duplicates` keeps, with all their columns.

    Only the ids that go are kept as a table, and only texts that may be among them
    are ever shuffled.
    """
    rows, tables = _grouped(docs, config)
    dropped = tables.write(rows.where("NOT kept").select(F.col("doc_id").alias("id")).distinct(), "dropped")
    tables.drop_others(dropped)
    return without_ids(docs, "doc_id", dropped, config.few_ids)
