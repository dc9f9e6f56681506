"""Exact nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.vectors import l2_distance_to, similarity_from_distance
from lodestone.operators.ranking import top_per_group
from lodestone.session import work_path

# A query block is held by every task: its size in float64 values is bounded.
BLOCK_VALUES = 1_000_000
# Results one task keeps for a block of queries.
BLOCK_RESULTS = 500_000
# Distances held at once by one matrix product.
TILE_VALUES = 4_000_000
# Vectors a task holds of a cell, as float64 values.
GROUP_VALUES = 32_000_000


def knn(
    chunks: DataFrame,
    query: Sequence[float],
    k: int,
    where: Column | None = None,
    id_col: str = "id",
    vector_col: str = "vector",
) -> DataFrame:
    """The ``k`` nearest rows to one vector, ties by id; the filter runs first.

    A row without a whole vector (NULL, a NULL element, another length) is no neighbour.

    A map-only distance followed by a per-task top-k: nothing is shuffled but
    ``k`` rows per task.
    """
    rows = chunks if where is None else chunks.where(where)
    scored = rows.withColumn("vector_distance", l2_distance_to(F.col(vector_col), query))
    nearest = scored.orderBy(F.col("vector_distance").asc_nulls_last(), id_col).limit(k)
    nearest = nearest.where(F.col("vector_distance").isNotNull())
    return nearest.withColumn("vector_similarity", similarity_from_distance(F.col("vector_distance")))


def knn_batch(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    dim: int,
    id_col: str = "id",
    vector_col: str = "vector",
    query_id: str = "query_id",
    query_vector: str = "query_vector",
) -> DataFrame:
    """The ``k`` nearest ids for each row of ``queries``; rows without a whole vector take no part.

    Each task scores its vectors against a block of queries with one matrix
    product and keeps ``k`` per query, so pairs are never materialised.  While
    the queries fit one block they travel with the task; beyond that they meet
    the vectors in cells, and skip those that cannot hold a neighbour.
    """
    whole = F.size("vector") == dim  # a NULL element is NaN in numpy, and its row is left out there
    pairs = chunks.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(whole)
    asked = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("vector")).where(whole)
    block_rows = max(min(BLOCK_VALUES // dim, BLOCK_RESULTS // k), 1)
    schema = T.StructType(
        [
            T.StructField("query_id", asked.schema["query_id"].dataType),
            T.StructField("id", pairs.schema["id"].dataType),
            T.StructField("vector_distance", T.DoubleType()),
        ]
    )
    block = asked.limit(block_rows + 1).toPandas()
    block = block[[not np.isnan(np.asarray(v, float)).any() for v in block["vector"]]]
    if len(block) <= block_rows:
        partial = _against_block(pairs, block, k, schema)
    else:
        partial = CellJoin(pairs, asked, k, dim, schema).result()
    ranked = top_per_group(partial, ["query_id"], [F.col("vector_distance"), F.col("id")], k)
    return ranked.withColumn("vector_similarity", similarity_from_distance(F.col("vector_distance")))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _without_gaps(ids: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows that have all their elements."""
    good = ~np.isnan(m).any(axis=1)
    return (ids, m) if good.all() else (ids[good], m[good])


def _nearest(query_ids, q: np.ndarray, ids, v: np.ndarray, k: int) -> pd.DataFrame:
    """The k nearest of ``v`` for each row of ``q``, ties by id; rows with gaps take no part."""
    (query_ids, q), (ids, v) = _without_gaps(np.asarray(query_ids), q), _without_gaps(np.asarray(ids), v)
    if not len(q) or not len(v):
        return pd.DataFrame({"query_id": query_ids[:0], "id": ids[:0], "vector_distance": np.zeros(0)})
    by_id = np.argsort(ids, kind="stable")
    ids, v = np.asarray(ids)[by_id], v[by_id]
    v_norm, q_norm = (v * v).sum(1), (q * q).sum(1)
    found: list[pd.DataFrame] = []
    tile = max(TILE_VALUES // max(len(ids), 1), 1)
    for at in range(0, len(q), tile):
        block, norm = q[at : at + tile], q_norm[at : at + tile, None]
        squared = norm + v_norm[None, :] - 2.0 * (block @ v.T)
        near = np.ones(squared.shape, dtype=bool)
        if len(ids) > k:
            # The product form loses digits: keep all within rounding of the cut.
            cut = np.partition(squared, k - 1, axis=1)[:, k - 1 : k]
            near = squared <= cut + 1e-9 * (1.0 + norm + v_norm.max())
        qi, vi = np.nonzero(near)
        exact = np.empty(len(qi))
        step = max(TILE_VALUES // v.shape[1], 1)
        for i in range(0, len(qi), step):
            gap = v[vi[i : i + step]] - block[qi[i : i + step]]
            exact[i : i + step] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
        order = np.lexsort((vi, exact, qi))
        qi, vi, exact = qi[order], vi[order], exact[order]
        best = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        found.append(
            pd.DataFrame({"query_id": query_ids[at + qi[best]], "id": ids[vi[best]], "vector_distance": exact[best]})
        )
    return pd.concat(found, ignore_index=True)


def _keep_nearest(found: list[pd.DataFrame], k: int) -> pd.DataFrame:
    rows = pd.concat(found, ignore_index=True).sort_values(["query_id", "vector_distance", "id"])
    return rows.groupby("query_id", sort=False).head(k)


def _against_block(pairs: DataFrame, block: pd.DataFrame, k: int, schema) -> DataFrame:
    if block.empty:
        return pairs.sparkSession.createDataFrame([], schema)
    query_ids, q = block["query_id"].to_numpy(), _matrix(block["vector"])

    def score(batches):
        found: list[pd.DataFrame] = []
        for batch in batches:
            if len(batch):
                found.append(_nearest(query_ids, q, batch["id"].to_numpy(), _matrix(batch["vector"]), k))
            if len(found) > 8:
                found = [_keep_nearest(found, k)]
        if found:
            yield _keep_nearest(found, k)

    return pairs.mapInPandas(score, schema)


PIVOTS = 128  # cells that vectors are dealt to, at most


class CellJoin:
    """Exact neighbours of many queries through cells around pivots.

    Vectors are stored once, in the cell of their nearest pivot; a crowded cell is
    cut into shares that one task can hold.  No neighbour of a query is nearer than
    its pivot less the cell's radius.  So a query first goes to its nearest cells
    with ``k`` vectors in all, and then to those others only that could improve on the
    k-th distance found there.  Queries travel to vectors, in a stream behind them,
    and no vector is copied.
    """

    def __init__(self, pairs: DataFrame, asked: DataFrame, k: int, dim: int, schema: T.StructType) -> None:
        self.pairs, self.asked, self.k, self.dim, self.schema = pairs, asked, k, dim, schema
        self.spark = pairs.sparkSession
        chosen = pairs.orderBy(F.xxhash64("id"), "id").limit(PIVOTS).toPandas()
        points = _matrix(chosen["vector"]) if len(chosen) else np.zeros((0, dim))
        self.pivots = np.unique(points[~np.isnan(points).any(axis=1)], axis=0)

    def result(self) -> DataFrame:
        if not len(self.pivots):
            return self.spark.createDataFrame([], self.schema)
        self._deal()
        first = self._stored(self._nearest_of(self._sent(None)), "knn-first")
        ranked = top_per_group(first, ["query_id"], [F.col("vector_distance"), F.col("id")], self.k).groupBy("query_id")
        known = ranked.agg(F.count("*").alias("n"), F.max("vector_distance").alias("most"))
        limit = known.select("query_id", F.when(F.col("n") == self.k, F.col("most")).alias("limit"))
        self.second = self._stored(self._sent(limit), "knn-second")
        return first.unionByName(self._nearest_of(self.second))

    def pruned(self) -> float:
        """The share of (query, cell) pairs that were never compared; after :meth:`result`."""
        sent = self.second.select("query_id", "cell").distinct().count() + self._sent(None).select("query_id", "cell").distinct().count()
        return 1 - sent / max(self.asked.count() * len(self.radius), 1)

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        path = work_path(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _deal(self) -> None:
        """Put every vector into a cell, and learn the cells' radii and sizes."""
        pivots = self.pivots

        def place(batches):
            for batch in batches:
                ids, v = _without_gaps(batch["id"].to_numpy(), _matrix(batch["vector"]) if len(batch) else np.zeros((0, pivots.shape[1])))
                for at in range(0, len(ids), 4096):
                    far = _distances(v[at : at + 4096], pivots)
                    cell = far.argmin(axis=1)
                    held = {"id": ids[at : at + 4096], "vector": list(v[at : at + 4096].astype(np.float32)), "cell": cell, "far": far[np.arange(len(cell)), cell]}
                    yield pd.DataFrame(held)

        kind = self.pairs.schema["id"].dataType.simpleString()
        dealt = self._stored(self.pairs.mapInPandas(place, f"id {kind}, vector array<float>, cell int, far double"), "knn-cells")
        cells = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # one row per pivot
        self.radius = np.full(len(pivots), -np.inf)
        self.counts = np.zeros(len(pivots), np.int64)
        for r in cells:
            self.radius[r.cell], self.counts[r.cell] = r.radius, r.n
        room = max(GROUP_VALUES // self.dim, 1)
        self.shares = -(-self.counts // room)
        many = F.element_at(F.array(*[F.lit(int(max(n, 1))) for n in self.shares]), F.col("cell") + 1)
        share = F.pmod(F.xxhash64("id"), many).cast("int")
        self.dealt = dealt.select("cell", share.alias("share"), "id", "vector")

    def _sent(self, limit: DataFrame | None) -> DataFrame:
        """``cell, share, query_id, vector``: where queries go; at first, or once the k-th distance is known."""
        pivots, radius, counts, shares, k = self.pivots, self.radius, self.counts, self.shares, self.k
        later = limit is not None
        rows = self.asked.join(limit, "query_id", "left") if later else self.asked.withColumn("limit", F.lit(None).cast("double"))

        def send(batches):
            for batch in batches:
                if not len(batch):
                    continue
                batch, q = batch.reset_index(drop=True), _matrix(batch["vector"])
                good = np.flatnonzero(~np.isnan(q).any(axis=1))
                least = np.where(counts > 0, np.maximum(_distances(q[good], pivots) - radius, 0.0), np.inf)
                order = np.argsort(least, axis=1, kind="stable")
                before = np.cumsum(counts[order], axis=1) - counts[order]
                wanted = (before < k) & (counts[order] > 0)
                if later:
                    most = batch["limit"].to_numpy(float)[good][:, None]
                    near = np.take_along_axis(least, order, axis=1)
                    # Distances to pivots lose digits in their product form: a cell within rounding is asked too.
                    slack = 1e-6 * (1 + np.linalg.norm(q[good], axis=1)[:, None] + np.linalg.norm(pivots, axis=1).max())
                    wanted = ~wanted & (counts[order] > 0) & (np.isnan(most) | (near <= most + slack))
                row, rank = np.nonzero(wanted)
                cell = order[row, rank]
                times = shares[cell]
                where = np.repeat(np.arange(len(cell)), times)
                share = np.arange(len(where)) - np.repeat(np.cumsum(times) - times, times)
                asked = batch.iloc[good[row[where]]]
                yield pd.DataFrame({"cell": cell[where], "share": share, "query_id": asked["query_id"].to_numpy(), "vector": asked["vector"].to_numpy()})

        kind = self.asked.schema["query_id"].dataType.simpleString()
        return rows.select("query_id", "vector", "limit").mapInPandas(send, f"cell int, share int, query_id {kind}, vector array<float>")

    def _nearest_of(self, sent: DataFrame) -> DataFrame:
        k, schema = self.k, self.schema
        none = lambda name, df: F.lit(None).cast(df.schema[name].dataType).alias(name)
        vectors = self.dealt.select("cell", "share", F.lit(0).alias("role"), "id", none("query_id", sent), "vector")
        queries = sent.select("cell", "share", F.lit(1).alias("role"), none("id", self.dealt), "query_id", "vector")
        wanted = vectors.join(sent.select("cell", "share").distinct(), ["cell", "share"], "left_semi").select(*vectors.columns)
        rows = wanted.unionByName(queries).repartition("cell", "share").sortWithinPartitions("cell", "share", "role")

        def score(batches):
            place, ids, held = None, [], []
            for batch in batches:
                for (cell, share, role), part in batch.groupby(["cell", "share", "role"], sort=True):
                    if (cell, share) != place:
                        place, ids, held = (cell, share), [], []
                    if role == 0:
                        ids.append(part["id"].to_numpy())
                        held.append(_matrix(part["vector"]))
                    elif held:
                        ids, held = [np.concatenate(ids)], [np.concatenate(held)]
                        yield _nearest(part["query_id"].to_numpy(), _matrix(part["vector"]), ids[0], held[0], k)[schema.fieldNames()]

        return rows.mapInPandas(score, schema)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squared = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squared, 0.0))
