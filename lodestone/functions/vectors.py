"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.binding import let

# Up to this width the distance is unrolled into plain arithmetic, which Spark
# compiles; wider vectors go to numpy in Arrow batches so that the generated
# method stays below the JIT's size limit.
UNROLL_LIMIT = 256


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def l2_normalize(v: Column) -> Column:
    """Unit-length copy; the zero vector is returned unchanged."""
    norm = F.sqrt(squared_norm(v)).cast("float")
    return let(norm, lambda n: F.when(n == 0, v).otherwise(F.transform(v, lambda x: (x / n).cast("float"))))


def l2_distance_to(v: Column, query: Sequence[float]) -> Column:
    """Euclidean distance from each row's vector to one query vector.

    NULL where the vector is NULL, has a NULL element or another length.
    """
    q = [float(x) for x in query]
    if len(q) > UNROLL_LIMIT:
        return _numpy_distance(q)(v)
    total = F.lit(0.0)
    for i, x in enumerate(q):
        delta = F.get(v, F.lit(i)).cast("double") - F.lit(x)
        total = total + delta * delta
    return F.when(F.size(v) == len(q), F.sqrt(total))


def _numpy_distance(q: list[float]):
    query = np.asarray(q, dtype=np.float64)

    @F.arrow_udf("double")
    def distance(batch: pa.Array) -> pa.Array:
        whole = np.asarray(pc.fill_null(pc.equal(pc.list_value_length(batch), len(query)), False))
        kept = batch.filter(pa.array(whole)).flatten().cast(pa.float64())
        delta = kept.to_numpy(zero_copy_only=False).reshape(-1, len(query)) - query
        found = np.full(len(batch), np.nan)
        found[whole] = np.sqrt(np.einsum("ij,ij->i", delta, delta))
        return pa.array(found, mask=np.isnan(found))

    return distance


def l2_distance(a: Column, b: Column) -> Column:
    """Distance between two vector columns of one row."""
    gaps = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda acc, d: acc + d * d))


def similarity_from_distance(distance: Column) -> Column:
    """Cosine of unit vectors from their distance, clamped at 0, as a percentage."""
    return F.greatest(F.lit(1.0) - distance * distance / F.lit(2.0), F.lit(0.0)) * F.lit(100.0)
