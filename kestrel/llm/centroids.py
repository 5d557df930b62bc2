"""Operator 12: centroid clustering with a LAESA pivot table.

Method.  The start centroids serve as fixed pivots.  Every vector's squared distances to all
pivots are computed once and stored with it.  In a round, the centroids' distances to the pivots
are taken, and by the triangle inequality |d(vector, pivot) - d(centroid, pivot)| bounds the
distance of vector and centroid from below, for every centroid, without looking at the vector.
The centroid of the least bound is compared exactly first; only centroids whose bound does not
exceed that distance receive an exact integer distance.  Bounds are lowered by far more than
rounding can add, so every centroid that could win or tie survives and the result equals a
full search.  Sums and counts of a round are exact integers, pre-aggregated by task; the driver
sees centroids only.

Defined results: vectors that are null, of another length than ``dims``, or that hold null or
non-finite components, or components of 2^27 or more after scaling, take no part.  Rows without
id take part but start no centroid before rows with one; repeated ids are separate rows, started
in order of their vectors.  With fewer rows than centroids, there are as many centroids as rows.
An empty table gives an empty result.  Only id and vector are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kestrel.llm.common import list_array, stash
from kestrel.llm.integer_vectors import each_slice, summed, whole_vectors
from kestrel.llm.vector_blocks import matrix


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of ``a`` to all rows of the few of ``b``."""
    return np.stack([((a - row) ** 2).sum(axis=1) for row in b], axis=1) if len(b) else np.zeros((len(a), 0), np.int64)


def assign(vectors: np.ndarray, to_pivots: np.ndarray, centroids: np.ndarray, between: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nearest centroid of each vector (ties: smaller number), squared distance, exact distances taken.

    ``to_pivots``: stored squared distances of the vectors; ``between``: squared distances of centroids and pivots.
    """
    near, far = np.sqrt(to_pivots.astype(np.float64)), np.sqrt(between.astype(np.float64))
    bound = np.zeros((len(vectors), len(centroids)))
    for p in range(near.shape[1]):
        np.maximum(bound, np.abs(near[:, p: p + 1] - far[:, p]), out=bound)
    # Square roots of numbers below 2^62 err by less than 1e-6; squares by a relative 1e-15.
    least = np.maximum(bound - 1e-5, 0) ** 2 * (1 - 1e-9)
    rows = np.arange(len(vectors))
    first = bound.argmin(axis=1)
    found = np.full(bound.shape, np.iinfo(np.int64).max)
    found[rows, first] = ((vectors - centroids[first]) ** 2).sum(axis=1)
    left = least <= found[rows, first][:, None]
    left[rows, first] = False
    row, centroid = np.nonzero(left)
    found[row, centroid] = ((vectors[row] - centroids[centroid]) ** 2).sum(axis=1)
    best = found.argmin(axis=1)
    return best, found[rows, best], 1 + left.sum(axis=1)


def with_pivot_table(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Rows with their squared distances to the pivots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, vectors in each_slice(batches):
            table = distances(vectors, pivots)
            starts = np.arange(len(vectors) + 1) * table.shape[1]
            yield pa.record_batch({"vec_id": part.column("vec_id"), "v": part.column("v"), "pivots": list_array(pa.array(table.ravel(), pa.int64()), starts)})

    return rows.mapInArrow(run, "vec_id long, v array<int>, pivots array<long>")


def _stored(part: pa.RecordBatch) -> np.ndarray:
    return matrix(pa.chunked_array([part.column("pivots")])).astype(np.int64)


def _update(rows: DataFrame, centroids: np.ndarray, between: np.ndarray) -> np.ndarray:
    """Centroids after one round over all rows; an empty one stays."""
    k, dims = centroids.shape

    def add(totals: np.ndarray, part: pa.RecordBatch, vectors: np.ndarray) -> None:
        best, _, _ = assign(vectors, _stored(part), centroids, between)
        np.add.at(totals.reshape(k, dims + 1), best, np.concatenate([vectors, np.ones((len(vectors), 1), np.int64)], axis=1))

    totals = summed(rows, k * (dims + 1), add).reshape(k, dims + 1)
    count = totals[:, -1:]
    return np.where(count > 0, totals[:, :-1] // np.maximum(count, 1), centroids)


def cluster(vectors: DataFrame, dims: int = 64, centroids: int = 16, rounds: int = 3, scale: int = 64, seed: int = 1) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, evaluated) of every vector, in the scratch folder, and the centroids.

    Start centroids are the vectors with the smallest hex sha256 of ``<seed>:<vec_id>``.
    """
    source = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = whole_vectors(source, scale, dims, "vec_id")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    starts = rows.orderBy(order, "v").limit(centroids).collect()
    pivots = np.array([r["v"] for r in starts], np.int64).reshape(-1, dims)
    rows = stash(with_pivot_table(rows, pivots), "op12-pivots")
    now = pivots
    if len(now):
        for _ in range(rounds):
            now = _update(rows, now, distances(now, pivots))

    def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
        between = distances(now, pivots)
        for part, block in each_slice(batches):
            best, distance, taken = assign(block, _stored(part), now, between)
            yield pa.record_batch({"vec_id": part.column("vec_id"), "cluster": pa.array(best, pa.int32()),
                                   "distance": pa.array(distance, pa.int64()), "evaluated": pa.array(taken, pa.int64())})

    return stash(rows.mapInArrow(run, "vec_id long, cluster int, distance long, evaluated long"), "op12-clusters"), now


def clustered_with_inertia(vectors: DataFrame, **how) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, evaluated) of every vector that takes part."""
    found, centroids = cluster(vectors, **how)
    own = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    facts = F.lit(None).cast("struct<a:bigint,b:string>")
    for j, centroid in enumerate(centroids):                # at most ``centroids`` of them
        digest = hashlib.sha256(",".join(map(str, centroid.tolist())).encode()).hexdigest()
        facts = F.when(F.col("cluster") == j, F.struct(F.lit(own.get(j, 0)).cast("long").alias("a"), F.lit(digest).alias("b"))).otherwise(facts)
    return found.withColumn("facts", facts).select(
        "vec_id", "cluster", "distance", F.col("facts.a").alias("cluster_inertia"),
        F.lit(sum(own.values())).cast("long").alias("inertia"), F.col("facts.b").alias("centroid_sha256"), "evaluated")
