"""Connected components of a link table, entirely in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.tables import in_few_files
from lodestone.session import work_path
from lodestone.sources import files


def _stored(edges: DataFrame) -> tuple[DataFrame, str]:
    path = work_path(edges.sparkSession, "links")
    edges.write.parquet(path)
    return edges.sparkSession.read.parquet(path), path


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands its larger neighbours to the smallest node it knows; a link becomes one link."""
    seen = F.explode(F.array(F.struct(F.col("u").alias("n"), F.col("v").alias("o")), F.struct(F.col("v").alias("n"), F.col("u").alias("o"))))
    least = edges.select(seen.alias("s")).select("s.*").groupBy("n").agg(F.least(F.col("n"), F.min("o")).alias("m"))
    return edges.join(least, F.col("v") == F.col("n")).select("u", F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node ties itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v"))))
    moved = edges.join(least, "u").select(tied.alias("s")).select("s.*")
    return moved.where(F.col("u") != F.col("v")).distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one smaller neighbour, a root."""
    ends = F.explode(F.array(F.struct(F.col("u").alias("n"), "v"), F.struct(F.col("v").alias("n"), "v")))
    roots = edges.select(ends.alias("s")).select("s.*").groupBy("n").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return roots.where("low != high").isEmpty()


def rooted(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)`` but the smallest of its component, which names it.

    Alternates the large-star and small-star steps until the links are stars, which
    one grouping tells without a further round.  Minima are combined before they are
    shuffled, and a hub's links are spread by the adaptive join.  Each round is a
    table in the shared folder, so a lost executor never restarts the iteration; only
    one answer per round reaches the driver.  The result is the last of these tables.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, path = _stored(edges.where(F.col("u") != F.col("v")))
    stars, repeated = _are_stars(edges), True  # links may be given twice; a round leaves each once
    while repeated or not stars:
        edges_next, path_next = _stored(in_few_files(edges.distinct() if stars else _small_star(_large_star(edges))))
        files.delete(edges.sparkSession, path)
        edges, path, repeated = edges_next, path_next, False
        stars = stars or _are_stars(edges)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node."""
    others = rooted(links)
    roots = others.select(F.col("component").alias("node"), "component").distinct()
    return others.unionByName(roots)
