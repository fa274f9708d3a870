"""Centroid clustering of integer vectors, exact at any magnitude.

Squared distances come from |x|^2 - 2 x.c + |c|^2, the middle term as a blocked matrix
product in float64. All parts are whole numbers, so the product is exact as long as no
partial sum reaches 2^53; a bound on the magnitudes decides that for each block, and a
block beyond it is computed in integers. Partitions add up their vectors by cluster,
and a tree of tasks combines these sums, so the driver gets one sum per centroid.
"""

from __future__ import annotations

import hashlib
import math
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Vectors in one matrix product.
BLOCK = 4096
#: Whole numbers up to here are exact in float64, and in a long.
EXACT, LONG = 1 << 53, 1 << 63

Centroids = list[list[int]]


def _largest(x: np.ndarray) -> int:
    return int(np.abs(x).max()) if x.size else 0


def squared_distances(x: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Of every row of ``x``, whole numbers as float64, to every centroid; int64 where they fit, else Python integers.

    A distance is at most dims * (|x| + |c|)^2, and so is each partial sum of its expansion.
    """
    dims = x.shape[1]
    bound = dims * (_largest(x) + max((abs(v) for c in centroids for v in c), default=0)) ** 2
    if bound < EXACT:
        c = np.array(centroids, np.float64)
        return ((x * x).sum(1)[:, None] - 2.0 * (x @ c.T) + (c * c).sum(1)).astype(np.int64)
    kind = np.int64 if bound < LONG else object
    whole = x.astype(np.int64) if bound < LONG else np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)
    c = np.array(centroids, kind)
    return np.stack([((whole - row) ** 2).sum(1) for row in c], axis=1)


def nearest(x: np.ndarray, centroids: Centroids) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of every row, the smaller number on ties, and its squared distance."""
    d = squared_distances(x, centroids)
    cluster = d.argmin(1)
    return cluster, d[np.arange(len(x)), cluster]


def exact_sums(x: np.ndarray, cluster: np.ndarray, k: int) -> np.ndarray:
    """Sums of the rows of each cluster, as Python integers."""
    out = np.zeros((k, x.shape[1]), object)
    small = _largest(x) * max(1, len(x)) < EXACT
    for c in np.unique(cluster).tolist():
        rows = x[cluster == c]
        out[c] += np.array([int(v) for v in rows.sum(0)] if small else [sum(map(int, column)) for column in rows.T.tolist()], object)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], scale: int, dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            yield part.column(0), np.floor(part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims) * scale)


def _partial(scale: int, dims: int, centroids: Centroids):
    """Of a partition, one row: counts, sums and inertia of its vectors by cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(centroids)
        count, sums, inertia = np.zeros(k, object), np.zeros((k, dims), object), np.zeros(k, object)
        for _, x in _blocks(batches, scale, dims):
            cluster, distance = nearest(x, centroids)
            count += np.array([int(v) for v in np.bincount(cluster, minlength=k)], object)
            sums += exact_sums(x, cluster, k)
            for c in np.unique(cluster).tolist():
                inertia[c] += sum(map(int, distance[cluster == c].tolist()))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((count, sums, inertia))], pa.binary())], names=["sums"])

    return run


def long_or_none(v: int) -> int | None:
    return v if v < LONG else None


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _label(scale: int, dims: int, centroids: Centroids, inertia: list[int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = pa.array([digest(c) for c in centroids], pa.string())
        of_cluster = pa.array([long_or_none(v) for v in inertia], pa.int64())
        total = long_or_none(sum(inertia))
        for ids, x in _blocks(batches, scale, dims):
            cluster, distance = nearest(x, centroids)
            at = pa.array(cluster)
            far = pa.array([long_or_none(int(v)) for v in distance.tolist()], pa.int64())
            columns = [ids, at.cast(pa.int32()), far, of_cluster.take(at), pa.array([total] * len(x), pa.int64()), digests.take(at)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return run


Sums = tuple[np.ndarray, np.ndarray, np.ndarray]


def _add(a: Sums, b: Sums) -> Sums:
    return a[0] + b[0], a[1] + b[1], a[2] + b[2]


@dataclass(frozen=True)
class VectorClusters:
    """Lloyd's rounds over vectors of ``dims`` components, each made a whole number by floor(scale * x).

    ``k`` and ``dims`` bound what reaches the driver: one sum of k * dims numbers per round.
    """

    k: int = 40
    dims: int = 64
    rounds: int = 5
    scale: int = 256
    seed: int = 2

    def kept(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """``(vec_id, x)`` of the vectors with ``dims`` components, all of them finite, and finite when scaled."""
        rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
        finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * self.scale < float("inf")))
        return rows.filter((F.size("x") == self.dims) & F.coalesce(finite, F.lit(False)))

    def start(self, kept: DataFrame) -> Centroids:
        """The vectors with the smallest hashes of seed and id; a vector without an id has the hash of an empty one, ties go by components."""
        key = F.sha2(F.concat(F.lit(f"{self.seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
        rows = kept.withColumn("key", key).orderBy("key", "x").limit(self.k).select("x").collect()  # k vectors
        return [[math.floor(self.scale * v) for v in r.x] for r in rows]

    def sums(self, kept: DataFrame, centroids: Centroids) -> Sums:
        """Counts, sums and inertia by cluster over all vectors, combined by a tree of tasks."""
        parts = kept.mapInArrow(K.released(_partial(self.scale, self.dims, centroids)), "sums binary").rdd.map(lambda r: pickle.loads(r.sums))
        n = len(centroids)
        zero = np.zeros(n, object), np.zeros((n, self.dims), object), np.zeros(n, object)
        depth = 2 if parts.getNumPartitions() < 10_000 else 3
        return parts.treeAggregate(zero, _add, _add, depth)

    def fit(self, kept: DataFrame, on_round: Callable[[int, int], None] | None = None) -> Centroids:
        """Centroids after all rounds; each is the floor of its vectors' mean, one without vectors stays."""
        centroids = self.start(kept)
        for number in range(self.rounds if centroids else 0):
            count, sums, inertia = self.sums(kept, centroids)
            centroids = [[v // n for v in row] if n else old for n, row, old in zip(count.tolist(), sums.tolist(), centroids)]
            if on_round:
                on_round(number, sum(inertia.tolist()))
        return centroids

    def clusters(self, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
        """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of every kept vector.

        Vectors of other lengths, null ones and those with a null or non-finite component have
        no row. Vectors with equal ids or components have one each; with fewer than ``k`` of them
        there are fewer centroids; an empty table gives no rows. Distances and sums that a long
        cannot hold are null, their clusters still exact. Other columns are ignored.
        """
        kept = self.kept(vectors, id_col, vector_col)
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        centroids = self.fit(kept)
        if not centroids:
            return vectors.sparkSession.createDataFrame([], schema)
        inertia = self.sums(kept, centroids)[2].tolist()
        return kept.mapInArrow(K.released(_label(self.scale, self.dims, centroids, inertia)), schema)
