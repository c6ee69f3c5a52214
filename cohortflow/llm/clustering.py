"""Centroid clustering of integer vectors with exact assignments, pruned by Ptolemaic lower bounds.

Every vector keeps its distances to a few fixed pivots.  For pivots p, s Ptolemy's inequality of
Euclidean space gives

    d(x, c) >= |d(x, p) d(c, s) - d(x, s) d(c, p)| / d(p, s),

so a round needs only the pivot distances of the centroids to rule most of them out; centroids that
might still be nearest are compared exactly in 64-bit integers.  The vectors stay where they are: a
round sends one partial sum per task and centroid, and the driver holds the centroids alone.

Defined results: vectors that are null, have another number of components, or hold null or
non-finite components are left out.  A component beyond ``LARGEST`` in size counts as ``LARGEST``,
because squared distances are longs.  Repeated rows count as often as they stand there.  With fewer
vectors than centroids every vector starts one; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortflow.llm.common import bounded, released, staged

#: size of a component from which on it counts as this: 64 squared differences of it fit a long
LARGEST = 1 << 27
#: vectors of one numpy pass
BLOCK = 2_048
#: relative slack of the bounds, far above the rounding of a few float64 operations
SLACK = 1e-12


def integers(vectors: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors with ``dims`` finite components; ``v`` is floor(scale * x) of each."""
    x = F.col(vector_col)
    whole = (F.size(x) == dims) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(
        F.col(id_col).alias("vec_id"),
        F.transform(x, lambda c: F.floor(F.greatest(F.least(c.cast("double") * scale, F.lit(float(LARGEST))), F.lit(float(-LARGEST)))).cast("int")).alias("v"))


def matrix(column) -> np.ndarray:
    """An Arrow column of equally long lists as one array, without a Python object per number."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances between rows of two integer arrays of the same shape."""
    d = a.astype(np.int64) - b
    return np.einsum("ij,ij->i", d, d)


def pivot_distances(v: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances (rows of ``v``, pivots), each the rounded root of an exact square."""
    out = np.empty((len(v), len(pivots)))
    for j, p in enumerate(pivots):
        out[:, j] = np.sqrt(squares(v, np.broadcast_to(p, v.shape)).astype(np.float64))
    return out


@dataclass
class Pruner:
    """Centroids of a round with what the bounds need: pivot pairs and the centroids' pivot distances."""

    centroids: np.ndarray
    pivots: np.ndarray

    def __post_init__(self):
        self.to_pivot = pivot_distances(self.centroids, self.pivots)                   # (K, P)
        between = pivot_distances(self.pivots, self.pivots)
        self.pairs = [(i, j, between[i, j]) for i in range(len(self.pivots)) for j in range(i) if between[i, j] > 0]

    def lower(self, x: np.ndarray) -> np.ndarray:
        """Lower bounds (rows, K) from cached pivot distances ``x`` (rows, P), never above the true distance."""
        low = np.zeros((len(x), len(self.centroids)))
        for i, j, apart in self.pairs:
            one, two = x[:, i, None] * self.to_pivot[None, :, j], x[:, j, None] * self.to_pivot[None, :, i]
            np.maximum(low, (np.abs(one - two) - SLACK * (one + two)) / apart, out=low)
        if not self.pairs and len(self.pivots):                                          # one place only: the triangle
            near, far = x[:, :1], self.to_pivot[None, :, 0]
            np.maximum(low, np.abs(near - far) - SLACK * (near + far), out=low)
        return low * (1 - SLACK)

    def assign(self, v: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance, exact comparisons) of rows ``v`` with pivot distances ``x``; ties go to the smaller number."""
        low = self.lower(x)
        cluster = low.argmin(axis=1)
        best = squares(v, self.centroids[cluster])
        row, other = np.nonzero(low <= (np.sqrt(best.astype(np.float64)) * (1 + SLACK))[:, None])
        exact = squares(v[row], self.centroids[other])
        order = np.lexsort((other, exact, row))
        first = order[np.r_[True, row[order][1:] != row[order][:-1]]] if len(order) else order
        return other[first], exact[first], len(row) + len(v)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` of ``points``, each as far as possible from those before it."""
    chosen, near = [0], np.full(len(points), np.iinfo(np.int64).max)
    while True:
        near = np.minimum(near, squares(points, np.broadcast_to(points[chosen[-1]], points.shape)))
        if len(chosen) == min(n, len(points)) or near.max() == 0:
            return points[chosen]
        chosen.append(int(near.argmax()))


def starts(ints: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors with the least sha256 of ``salt:<vec_id>``, in that order (copies of an id by components)."""
    name = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = ints.select(name.alias("name"), "v").orderBy("name", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], dtype=np.int64)


def with_pivots(ints: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``ints`` with ``to_pivot``, the distances to all pivots, computed once for all rounds."""
    def run(batches):
        for batch in batches:
            v = matrix(batch.column("v"))
            x = pivot_distances(v, pivots)
            lists = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), lists], ["vec_id", "v", "to_pivot"])

    kind = ints.schema["vec_id"].dataType.simpleString()
    return bounded(ints).mapInArrow(released(run), f"vec_id {kind}, v array<int>, to_pivot array<double>")


def blocks(batches):
    """(batch, vectors, pivot distances) of at most ``BLOCK`` rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK):
            batch = whole.slice(at, BLOCK)
            yield batch, matrix(batch.column("v")), matrix(batch.column("to_pivot"))


def next_centroids(points: DataFrame, pruner: Pruner) -> np.ndarray:
    """One round: the exact floor of every cluster's mean; an empty cluster keeps its centroid."""
    k, dims = pruner.centroids.shape

    def run(batches):
        total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for _, v, x in blocks(batches):
            cluster, _, _ = pruner.assign(v, x)
            by = np.argsort(cluster, kind="stable")
            at = np.flatnonzero(np.r_[True, np.diff(cluster[by]) > 0])
            total[cluster[by][at]] += np.add.reduceat(v[by].astype(np.int64), at, axis=0)
            count += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(used, dims + 1), pa.int32()), pa.array(np.tile(np.arange(dims + 1), len(used)), pa.int32()),
             pa.array(np.column_stack([total[used], count[used]]).ravel(), pa.int64())], ["cluster", "place", "part"])

    parts = points.mapInArrow(released(run), "cluster int, place int, part bigint")
    sums = {(r["cluster"], r["place"]): int(r["whole"]) for r in       # k * (dims + 1) rows at most
            parts.groupBy("cluster", "place").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("whole")).collect()}
    return np.array([[sums[c, d] // sums[c, dims] for d in range(dims)] if (c, dims) in sums else pruner.centroids[c] for c in range(k)], dtype=np.int64)


def assigned(points: DataFrame, pruner: Pruner) -> DataFrame:
    """(vec_id, cluster, distance, compared) of every vector; ``compared`` counts the centroids compared exactly in its block, shared evenly."""
    def run(batches):
        for batch, v, x in blocks(batches):
            cluster, distance, compared = pruner.assign(v, x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64()), pa.array(np.full(len(v), compared / len(v)))],
                ["vec_id", "cluster", "distance", "compared"])

    kind = points.schema["vec_id"].dataType.simpleString()
    return points.mapInArrow(released(run), f"vec_id {kind}, cluster int, distance bigint, compared double")


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", dims: int = 64, scale: int = 256, n_pivots: int = 8,
            id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, compared), one row per vector kept."""
    ints = integers(vectors, dims, scale, id_col, vector_col)
    centroids = starts(ints, k, salt)
    names = "cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not len(centroids):
        empty = ints.select("vec_id", *[F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "bigint"))])
        return empty.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (x.split() for x in names.split(", "))], F.lit(0.0).alias("compared")).limit(0)
    pivots = far_apart(centroids, n_pivots)
    points = staged(with_pivots(ints, pivots), "cluster-points")
    for _ in range(rounds):
        centroids = next_centroids(points, Pruner(centroids, pivots))
    rows = staged(assigned(points, Pruner(centroids, pivots)), "cluster-rows")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    whole = sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    report = vectors.sparkSession.createDataFrame([(c, int(s), int(whole), digest[c]) for c, s in sorted(sums.items())], f"cluster int, {names}")
    return rows.join(F.broadcast(report), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256", "compared")
