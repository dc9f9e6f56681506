"""A prefix trie of conversations, rolled up in bands of depths.

A *turn* is a role and a text; every distinct sequence of the first ``d`` turns of a
conversation is a node of depth ``d`` below the textless root.  Only digests of turns
are shuffled: the key of a prefix is its depth and the exclusive or of its turns'
hashes, each mixed with its place (128 bits of hashes of a SHA-256), so a prefix needs
no earlier row of its conversation but a running total.

Sums over subtrees go by *bands* of ``height`` depths.  A node explodes to its
ancestors inside its band and the root of the band, ``height`` rows at most.  What
lies below the root of a band is then complete but for deeper bands; the roots of
bands form a trie of their own, ``height`` times less deep, that is rolled up in the
same way, and its totals go back to the ancestors inside the bands above.  Rounds
grow with the logarithm of the depth, rows with the height.

No step gathers a conversation, a node's members or its children in one task: turns
are numbered by ranges, prefixes close band by band, sums are combined before they
are shuffled, and the ids that end at a node are sorted by ranges into pieces, which
the digest reads one after the other.

Definitions: rows with a null ``conv_id`` belong to no conversation and are left out.
A null turn comes first; rows of one turn are ordered by role, the first 64 characters
of the text, and its digest, so repeated rows are turns of their own.  A null role or
text is empty.  Texts of any length are hashed whole.  Other columns are ignored,
whatever their names.  Without conversations there is no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.numbering import numbered
from lodestone.llm.tables import WorkTables

EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()
PIECE_IDS = 50_000  # ids joined into one piece of a node's list


@dataclass(frozen=True)
class TrieConfig:
    height: int = 16  # depths of a band


def numbered_turns(turns: DataFrame, tables: WorkTables) -> tuple[DataFrame, DataFrame]:
    """``conv, i, p, q, n_bytes`` with turns counted from 1, and ``conv, n``."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)
    slim = turns.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv"),
        F.col("turn"),
        role.alias("role"),
        F.substring(text, 1, 64).alias("head"),
        digest.alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "head", "digest")]
    rows, sizes = numbered(tables.write(slim, "turns"), F.col("conv"), order, tables, "ranged")
    halves = [F.conv(F.substring("digest", at, 15), 16, 10).cast("long").alias(c) for at, c in ((1, "p"), (16, "q"))]
    rows = rows.select("conv", (F.col("pos") + 1).alias("i"), *halves, "n_bytes")
    return tables.write(rows, "numbered"), tables.write(sizes.select(F.col("group").alias("conv"), "n"), "sizes")


def own_turns(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: ``conv, depth, p, q, n_bytes, last``, and ``conv, total``."""
    placed = rows.withColumnRenamed("i", "depth").join(sizes, "conv")
    return placed.withColumn("last", F.col("depth") == F.col("n")).drop("n"), sizes.withColumnRenamed("n", "total")


def prefix_of_first_in_five(rows: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations rebuilt: the first h turns of conversation c - c % 5, then c's turns after its first h.

    h is the checksum of the id modulo 9.  Of a shorter conversation all turns are
    taken, of an absent one none.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    convs = sizes.select("conv", "n", h.alias("h"), (F.col("conv") - F.col("conv") % 5).alias("first"))
    known = sizes.where("conv % 5 = 0").toDF("first", "n_first")
    convs = convs.join(known, "first", "left").withColumn("taken", F.least("h", F.coalesce("n_first", F.lit(0))))
    convs = convs.withColumn("total", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    slim = convs.select("conv", "h", "taken", "total")
    own = rows.join(slim, "conv").where("i > h").withColumn("depth", F.col("taken") + F.col("i") - F.col("h"))
    heads = rows.where("conv % 5 = 0 AND i <= 8").withColumnRenamed("conv", "first")
    shared = heads.join(convs.select("first", "conv", "h", "total"), "first").where("i <= h").withColumn("depth", F.col("i"))
    columns = ["conv", "depth", "p", "q", "n_bytes", (F.col("depth") == F.col("total")).alias("last")]
    return own.select(*columns).unionByName(shared.select(*columns)), convs.select("conv", "total")


# --- prefixes ---------------------------------------------------------------------


def _key(depth: Column | str, p: Column | str, q: Column | str) -> Column:
    as_long = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
    return F.struct(as_long(depth).alias("depth"), as_long(p).alias("p"), as_long(q).alias("q"))


def _root() -> Column:
    return _key(F.lit(0), F.lit(0), F.lit(0))


def _prefixes(placed: DataFrame, height: int, tables: WorkTables) -> tuple[DataFrame, DataFrame]:
    """``conv, n_bytes, last, key, parent, path`` of every prefix, and ``conv, step, key`` of the roots of bands.

    ``path`` holds the root of the band, then the prefixes of the band down to this one.
    """
    mixed = placed.select(
        "conv", "depth", "n_bytes", "last",
        F.xxhash64(F.lit(1), "depth", "p", "q").alias("own_p"),
        F.xxhash64(F.lit(2), "depth", "q", "p").alias("own_q"),
        F.floor((F.col("depth") - 1) / height).alias("band"),
    )
    mixed = tables.write(mixed, "placed")
    totals = mixed.groupBy("conv", "band").agg(F.bit_xor("own_p").alias("p"), F.bit_xor("own_q").alias("q"))
    before = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    root_of = [F.coalesce(F.bit_xor(c).over(before), F.lit(0).cast("long")).alias(f"root_{c}") for c in ("p", "q")]
    roots = tables.write(totals.select("conv", "band", *root_of), "roots")

    inside = Window.partitionBy("conv", "band").orderBy("depth").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = mixed.join(roots, ["conv", "band"])
    keys = [F.col(f"root_{c}").bitwiseXOR(F.bit_xor(f"own_{c}").over(inside)).alias(c) for c in ("p", "q")]
    rows = rows.select("*", *keys).withColumn("key", _key("depth", "p", "q"))
    root = _key(F.col("band") * height, "root_p", "root_q")
    parent = _key(F.col("depth") - 1, F.col("p").bitwiseXOR(F.col("own_p")), F.col("q").bitwiseXOR(F.col("own_q")))
    path = F.concat(F.array(root), F.collect_list("key").over(inside))
    rows = rows.select("conv", "n_bytes", "last", "key", parent.alias("parent"), path.alias("path"))
    steps = roots.where("band > 0").select("conv", F.col("band").alias("step"), _key(F.col("band") * height, "root_p", "root_q").alias("key"))
    return rows, steps


def _skeleton_paths(steps: DataFrame, height: int) -> DataFrame:
    """``key, path`` of the roots of bands, themselves in bands of ``height`` steps."""
    rows = steps.select("conv", "step", "key", F.floor((F.col("step") - 1) / height).alias("band"), F.lit(False).alias("head"))
    heads = steps.where(F.col("step") % height == 0)
    heads = heads.select("conv", "step", "key", F.floor(F.col("step") / height).alias("band"), F.lit(True).alias("head"))
    inside = Window.partitionBy("conv", "band").orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    listed = rows.unionByName(heads).withColumn("list", F.collect_list("key").over(inside)).where("NOT head")
    path = F.when(F.col("band") == 0, F.concat(F.array(_root()), F.col("list"))).otherwise(F.col("list"))
    return listed.withColumn("path", path).groupBy("key").agg(F.first("path").alias("path"))


# --- sums over subtrees ---------------------------------------------------------------


class _Rollup:
    def __init__(self, steps: DataFrame, measures: list[str], height: int, tables: WorkTables) -> None:
        self.steps, self.measures, self.height, self.tables = steps, measures, height, tables

    def _summed(self, rows: DataFrame, *by: str) -> DataFrame:
        return rows.groupBy(*by).agg(*[F.sum(m).alias(m) for m in self.measures])

    def totals(self, values: DataFrame, paths: DataFrame, deepest: int) -> DataFrame:
        """``key`` and its measures over the node's subtree, from each node's own ``values``."""
        listed = values.join(paths, "key").select(F.posexplode("path").alias("at", "to"), *self.measures)
        spread = self._summed(listed.select((F.col("at") == 0).alias("head"), F.col("to").alias("key"), *self.measures), "head", "key")
        spread = self.tables.write(spread, "spread")
        columns = ["key", *self.measures]
        below = spread.where("head").select(*columns)
        parts = [spread.where("NOT head").select(*columns), values.where("key.depth = 0").select(*columns)]
        if deepest > self.height:
            below = self.tables.write(self._of_roots(below, deepest), "below")
            down = below.where("key.depth > 0").join(paths, "key")
            down = down.select(F.explode(F.slice("path", F.lit(2), F.size("path"))).alias("key"), *self.measures)
            parts.append(self._summed(down, "key"))
        parts.append(below.where("key.depth = 0"))
        union = parts[0]
        for part in parts[1:]:
            union = union.unionByName(part)
        return self._summed(union, "key")

    def _of_roots(self, below: DataFrame, deepest: int) -> DataFrame:
        steps = self.steps
        paths = self.tables.write(_skeleton_paths(steps, self.height), "skeleton")
        above = steps.where(F.col("step") % self.height == 0).withColumn("step", (F.col("step") / self.height).cast("long"))
        return _Rollup(above, self.measures, self.height, self.tables).totals(below, paths, deepest // self.height)


# --- lists of ids -----------------------------------------------------------------------


def _id_pieces(ends: DataFrame) -> DataFrame:
    """``key, first, piece``: the ids that end at a node, joined in order, some thousands a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[int] = []
        holder = None

        def rows():
            nonlocal held, holder
            for batch in batches:
                for key, conv in zip(batch.column("key").to_pylist(), batch.column("conv").to_pylist()):
                    if held and (key != holder or len(held) == PIECE_IDS):
                        yield holder, held
                        held = []
                    holder = key
                    held.append(conv)
            if held:
                yield holder, held

        for key, ids in rows():
            piece = ",".join(map(str, ids))
            yield pa.RecordBatch.from_pylist([{"key": key, "first": ids[0], "piece": piece}], schema)

    kind = pa.struct([("depth", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])
    schema = pa.schema([("key", kind), ("first", pa.int64()), ("piece", pa.string())])
    ranged = ends.repartitionByRange("key", "conv").sortWithinPartitions("key", "conv")
    return ranged.mapInArrow(run, "key struct<depth: long, p: long, q: long>, first long, piece string")


def id_digests(ends: DataFrame) -> DataFrame:
    """``key, ends_sha256`` of the ascending, comma-joined ids of every key.

    The digest of one list is sequential by nature; it reads sorted pieces and
    holds one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holder, state = None, None
        for batch in batches:
            done = []
            for key, piece in zip(batch.column("key").to_pylist(), batch.column("piece").to_pylist()):
                if key == holder:
                    state.update(b",")
                else:
                    if state:
                        done.append({"key": holder, "ends_sha256": state.hexdigest()})
                    holder, state = key, hashlib.sha256()
                state.update(piece.encode())
            yield pa.RecordBatch.from_pylist(done, schema)
        if state:
            yield pa.RecordBatch.from_pylist([{"key": holder, "ends_sha256": state.hexdigest()}], schema)

    kind = pa.struct([("depth", pa.int64()), ("p", pa.int64()), ("q", pa.int64())])
    schema = pa.schema([("key", kind), ("ends_sha256", pa.string())])
    pieces = _id_pieces(ends).repartition("key").sortWithinPartitions("key", "first")
    return pieces.mapInArrow(run, "key struct<depth: long, p: long, q: long>, ends_sha256 string")


# --- nodes --------------------------------------------------------------------------------


def prefix_trie(
    turns: DataFrame,
    rebuild: Callable[[DataFrame, DataFrame], tuple[DataFrame, DataFrame]] = own_turns,
    config: TrieConfig = TrieConfig(),
) -> DataFrame:
    """One row per node: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``.

    ``conv_id`` is the smallest member; with ``depth`` it names the node.  ``rebuild``
    places the turns: :func:`own_turns`, or :func:`prefix_of_first_in_five`.
    ``n_leaves`` and ``saved_tokens`` (bytes that members after the first share) are
    sums over the subtree.
    """
    tables = WorkTables(turns.sparkSession, "trie")
    rows, sizes = numbered_turns(turns, tables)
    placed, totals = rebuild(rows, sizes)
    totals = tables.write(totals, "totals")
    prefixes, steps = _prefixes(placed, config.height, tables)
    prefixes = tables.write(prefixes, "prefixes")

    every = totals.select("conv", F.lit(0).cast("long").alias("n_bytes"), (F.col("total") == 0).alias("last"), _root().alias("key"))
    nodes = prefixes.groupBy("key").agg(
        F.min("conv").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.first("parent").alias("parent"),
        F.first("n_bytes").alias("n_bytes"),
        F.first("path").alias("path"),
    )
    root = every.groupBy("key").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"))
    nodes = tables.write(nodes.unionByName(root, allowMissingColumns=True), "nodes")

    children = tables.write(nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children")), "children")
    saved = (F.col("n_convs") - 1) * F.coalesce("n_bytes", F.lit(0).cast("long"))
    own = nodes.join(children, "key", "left").select(
        "key", F.col("n_children").isNull().cast("long").alias("n_leaves"), saved.alias("saved_tokens")
    )
    own = tables.write(own, "own")
    deepest = totals.agg(F.max("total")).first()[0] or 0
    paths = nodes.where("path IS NOT NULL").select("key", "path")
    sums = _Rollup(steps, ["n_leaves", "saved_tokens"], config.height, tables).totals(own, paths, deepest)

    ends = prefixes.where("last").select("key", "conv").unionByName(every.where("last").select("key", "conv"))
    digests = id_digests(tables.write(ends, "ends"))
    found = sums.unionByName(children, allowMissingColumns=True).unionByName(digests, allowMissingColumns=True)
    found = found.groupBy("key").agg(*[F.max(c).alias(c) for c in ("n_leaves", "saved_tokens", "n_children", "ends_sha256")])
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.select("key", "conv_id", "n_convs", "parent").join(found, "key").join(parents, "parent", "left")
    return out.select(
        "conv_id",
        F.col("key.depth").alias("depth"),
        "parent_conv_id",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA256)).alias("ends_sha256"),
    )
