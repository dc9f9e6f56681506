"""A Merkle manifest of a dataset, and versions of it made by path copying.

Every row is a leaf.  The leaves of a source form a tree in the order of their ids,
and the roots of the sources form one more tree.  A changed leaf makes a *version*:
its ancestors are copied with new digests, every other node is shared.

Trees are cut into aligned blocks of ``arity ** levels`` nodes.  A task holds one
block: going up it hashes the block's levels and hands on one digest; going down
it gets the siblings above its block once, and copies the ancestors of every changed
leaf, first inside the block, then through those siblings up to the root.  A source
of any size is spread over its blocks, and the steps grow with the logarithm of its
size to the base of a block.

Definitions: a null field is ``-`` in a leaf's input, an empty one ``0:``.  Null ids
come first in their source, rows of one id in the order of their leaves; repeated
rows are leaves of their own.  A text of any length is hashed whole in the JVM; only
digests are shuffled.  Other columns are ignored, whatever their names.  An empty
table has no rows and no root.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.numbering import numbered
from lodestone.llm.tables import WorkTables

Sides = list[tuple[str, str]]  # digests left and right of a node, level by level


@dataclass(frozen=True)
class MerkleConfig:
    arity: int = 16
    levels: int = 3  # levels of a block; it holds arity ** levels nodes

    @property
    def block(self) -> int:
        return self.arity**self.levels

    def height(self, n: Column) -> Column:
        """Levels above ``n`` nodes: how many powers of the arity are less than ``n``."""
        total, power = F.lit(0), 1
        while power < 1 << 62:
            total = total + (n > F.lit(power)).cast("int")
            power *= self.arity
        return total


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(*fields: Column) -> Column:
    """Lower-case hex SHA-256 of the fields, each with its length in bytes."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


# --- inside a block ---------------------------------------------------------------


def block_levels(digests: list[str], levels: int, arity: int) -> list[list[str]]:
    """The block's nodes, level by level; the last level has one node."""
    out = [digests]
    for _ in range(levels):
        below = out[-1]
        out.append([digest("".join(below[a : a + arity])) for a in range(0, len(below), arity)])
    return out


def node_sides(level: list[str], arity: int) -> Sides:
    """What stands left and right of every node in its run."""
    out = []
    for i in range(len(level)):
        a = i - i % arity
        out.append(("".join(level[a:i]), "".join(level[i + 1 : a + arity])))
    return out


def paths_in_block(levels: list[list[str]], above: Sides, arity: int) -> list[Sides]:
    """For every node of the lowest level, the sides on its way to the root."""
    if len(levels) == 1:
        return [above] * len(levels[0])
    higher = paths_in_block(levels[1:], above, arity)
    return [[sides, *higher[i // arity]] for i, sides in enumerate(node_sides(levels[0], arity))]


def copied_path(leaf: str, sides: Sides) -> list[str]:
    """The digests of a leaf's ancestors, copied anew for this leaf."""
    out = []
    for left, right in sides:
        leaf = digest(left + leaf + right)
        out.append(leaf)
    return out


# --- between blocks -----------------------------------------------------------------

NODE = "tree long, pos long, digest string, height int"
PATH = "tree long, block long, sides array<struct<left: string, right: string>>, subroot string, root string"


def _ordered(table: pa.Table) -> pa.Table:
    return table.sort_by("pos")


def _raised(nodes: DataFrame, config: MerkleConfig) -> DataFrame:
    """One node for each block of nodes; a finished tree stays as it is."""

    def run(table: pa.Table) -> pa.Table:
        table = _ordered(table)
        height = table.column("height")[0].as_py()
        levels = min(config.levels, height)
        top = block_levels(table.column("digest").to_pylist(), levels, config.arity)[-1]
        head = table.slice(0, 1)
        return pa.table(
            {"tree": head.column("tree"), "pos": head.column("block"), "digest": top, "height": pa.array([height - levels], pa.int32())}
        )

    blocked = nodes.withColumn("block", F.floor(F.col("pos") / config.block))
    return blocked.groupBy("tree", "block").applyInArrow(run, NODE)


def _sides(table: pa.Table) -> Sides:
    return [(s["left"], s["right"]) for s in table.column("sides")[0].as_py()]


def _lowered(nodes: DataFrame, paths: DataFrame, config: MerkleConfig) -> DataFrame:
    """The path of every node, from the path of its block."""

    def run(table: pa.Table, path: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in zip(names, kinds)})
        table = _ordered(table)
        levels = block_levels(table.column("digest").to_pylist(), min(config.levels, table.column("height")[0].as_py()), config.arity)
        sides = paths_in_block(levels, _sides(path), config.arity)
        n = table.num_rows
        values = [
            table.column("tree").combine_chunks(),
            table.column("pos").combine_chunks(),
            pa.array([[{"left": a, "right": b} for a, b in s] for s in sides], kinds[2]),
            pa.array(path.column("subroot").to_pylist() * n, pa.string()),
            pa.array(path.column("root").to_pylist() * n, pa.string()),
        ]
        return pa.table(dict(zip(names, values)))

    names = ["tree", "block", "sides", "subroot", "root"]
    side = pa.struct([("left", pa.string()), ("right", pa.string())])
    kinds = [pa.int64(), pa.int64(), pa.list_(side), pa.string(), pa.string()]
    blocked = nodes.withColumn("block", F.floor(F.col("pos") / config.block))
    return blocked.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(run, PATH)


class _Forest:
    """Trees over numbered nodes: ``stages[0]`` are the leaves, each next stage one node for each block."""

    def __init__(self, nodes: DataFrame, config: MerkleConfig, tables: WorkTables, name: str) -> None:
        self.config, self.tables, self.name = config, tables, name
        self.stages = [nodes]
        tallest = nodes.agg(F.max("height")).first()[0] or 0
        while len(self.stages) == 1 or tallest > 0:
            self.stages.append(tables.write(_raised(self.stages[-1].select("tree", "pos", "digest", "height"), config), f"{name}-nodes"))
            tallest -= config.levels

    @property
    def tops(self) -> DataFrame:
        """``tree, pos, digest, height``: the one node of every tree."""
        return self.stages[-1]

    def block_paths(self, starts: DataFrame) -> DataFrame:
        """The paths of the blocks of ``stages[0]``, from the paths of the tops."""
        paths = starts
        for stage in reversed(self.stages[1:-1]):
            paths = self.tables.write(_lowered(stage, paths, self.config), f"{self.name}-paths")
        return paths


def versions(
    docs: DataFrame, tampered: Column, changed: Column, config: MerkleConfig = MerkleConfig()
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, leaf, subroot, root, proof_sha256, copies, folded_root, verified``.

    Where ``tampered`` holds, ``changed`` takes the place of the text.  ``copies``
    are the new digests of that version's copied ancestors from the leaf's parent to
    the root, empty where the leaf is the same: such a version shares every node.
    ``proof_sha256`` is the digest of all siblings on the way up; ``folded_root`` is
    what they and the leaf give, and ``verified`` says that it is the root.
    """
    spark = docs.sparkSession
    tables = WorkTables(spark, "merkle")
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars")]
    leaf = leaf_digest(*fields, F.col("text"))
    other = F.when(F.coalesce(tampered, F.lit(False)), leaf_digest(*fields, changed))
    leaves = docs.select("doc_id", F.col("source").cast("string").alias("source"), leaf.alias("digest"), other.alias("other"))
    leaves = leaves.withColumn("other", F.when(F.col("other") != F.col("digest"), F.col("other")))
    leaves = tables.write(leaves.withColumn("row", F.monotonically_increasing_id()), "leaves")
    order = [F.col(c).asc_nulls_first() for c in ("doc_id", "digest", "row")]
    rows, sizes = numbered(leaves, F.col("source"), order, tables, "ranged")

    sizes = tables.write(sizes.select(F.col("group").alias("source"), "n"), "sizes")
    sources, _ = numbered(sizes, F.lit(0), [F.col("source").asc_nulls_first()], tables, "sources")
    sources = tables.write(sources.select("source", "n", F.col("pos").alias("tree")), "trees")
    named = sources.select(F.col("source").alias("_source"), "tree", config.height(F.col("n")).alias("height"))
    rows = rows.join(named, F.col("group").eqNullSafe(F.col("_source")))
    nodes = tables.write(rows.select("tree", "pos", "digest", "height", "doc_id", "other"), "nodes")

    by_source = _Forest(nodes, config, tables, "source")
    n_sources = sources.count()
    height = config.height(F.lit(n_sources))
    subroots = by_source.tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), "digest", height.alias("height"))
    overall = _Forest(tables.write(subroots, "subroots"), config, tables, "overall")
    top = overall.tops.select("tree", F.col("pos").alias("block"), F.expr("array()").cast("array<struct<left: string, right: string>>").alias("sides"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    upper = tables.write(_lowered(overall.stages[0], overall.block_paths(top), config), "upper")
    starts = upper.join(by_source.tops.select("tree", "digest").toDF("t", "d"), F.col("block") == F.col("t"))
    starts = starts.select(F.col("t").alias("tree"), F.lit(0).cast("long").alias("block"), "sides", F.col("d").alias("subroot"), "root")
    return _versions_of_leaves(nodes, by_source.block_paths(tables.write(starts, "starts")), config)


VERSION = (
    "doc_id {id}, leaf string, subroot string, root string, proof_sha256 string, copies array<string>,"
    " folded_root string, verified boolean"
)


def _versions_of_leaves(nodes: DataFrame, paths: DataFrame, config: MerkleConfig) -> DataFrame:
    def run(table: pa.Table, path: pa.Table) -> pa.Table:
        if not table.num_rows:
            return pa.table({c: pa.array([], t) for c, t in kinds.items()}).append_column("doc_id", table.column("doc_id"))
        table = _ordered(table)
        leaves = table.column("digest").to_pylist()
        levels = block_levels(leaves, min(config.levels, table.column("height")[0].as_py()), config.arity)
        subroot, root = path.column("subroot")[0].as_py(), path.column("root")[0].as_py()
        proofs, copies, folded = [], [], []
        others, every = table.column("other").to_pylist(), paths_in_block(levels, _sides(path), config.arity)
        for leaf, other, sides in zip(leaves, others, every):
            way = copied_path(other or leaf, sides)
            proofs.append(digest("".join(left + right for left, right in sides)))
            copies.append(way if other else [])
            folded.append(way[-1] if way else other or leaf)
        n = len(leaves)
        values = [leaves, [subroot] * n, [root] * n, proofs, copies, folded, [f == root for f in folded]]
        out = {c: pa.array(v, t) for (c, t), v in zip(kinds.items(), values)}
        return pa.table({"doc_id": table.column("doc_id"), **out})

    text = pa.string()
    names = ["leaf", "subroot", "root", "proof_sha256", "copies", "folded_root", "verified"]
    kinds = dict(zip(names, [text, text, text, text, pa.list_(text), text, pa.bool_()]))
    blocked = nodes.withColumn("block", F.floor(F.col("pos") / config.block))
    schema = VERSION.format(id=nodes.schema["doc_id"].dataType.simpleString())
    return blocked.groupBy("tree", "block").cogroup(paths.groupBy("tree", "block")).applyInArrow(run, schema)


def lower_cased(text: Column) -> Column:
    """A-Z in lower case, nothing else."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, letters, letters.lower())


def marked_for_tampering(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
