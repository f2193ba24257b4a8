"""Clustering around centroids with a table of pivot distances (LAESA), exact in integers.

The distance of every vector to a few fixed pivots is computed once and stored
beside it. In each round the triangle inequality gives, from the pivot
distances of a vector and of a centroid, a lower bound of the distance between
them; only centroids whose bound does not exceed the best distance found get
their exact integer distance.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import discard, staged

DIMENSIONS = 64
SCALE = 256
CENTROIDS = 40
ROUNDS = 5
PIVOTS = 12
SEED = 2
#: Components beyond this have no squared distance that surely fits a long.
LARGEST = 1 << 27


def integer_vectors(vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """``key`` and ``v``: each component x as floor(scale * x), x as double.

    Rows are kept if they have exactly ``dimensions`` components, none null or
    not finite. A component beyond 2^27 after scaling ends the job: its squared
    distances do not fit a long, and a wrong cluster is worse than none.
    """

    def unusable(x: Column) -> Column:
        return x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    own = vectors.select(F.col(key), F.col(vector).cast("array<double>").alias("v")).where((F.size("v") == dimensions) & ~F.exists("v", unusable))
    large = F.raise_error(F.lit(f"a component of {vector} exceeds 2^27 after scaling"))
    return own.select(key, F.transform("v", lambda x: F.when(F.abs(x * scale) <= LARGEST, F.floor(x * scale)).otherwise(large.cast("long"))).alias("v"))


def first_centroids(own: DataFrame, key: str, count: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The ``count`` vectors whose keys have the smallest SHA-256 of ``seed:key``, ties by vector, null keys last."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)
    chosen = own.orderBy(order.asc_nulls_last(), "v").limit(count).select("v").collect()
    return np.array([row["v"] for row in chosen], np.int64)


def choose_pivots(points: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Points far from each other: each next one has the greatest sum of distances to those before."""
    at, total = 0, np.zeros(len(points))
    chosen: list[int] = []
    while len(chosen) < min(count, len(points)):
        chosen.append(at)
        total = total + np.sqrt(squared(points, points[at]))
        at = int(np.where(np.isin(np.arange(len(points)), chosen), -1.0, total).argmax())
    return points[chosen]


def squared(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one point, or row by row to as many."""
    apart = rows - point
    return np.einsum("ij,ij->i", apart, apart)


def pivot_distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of each row to each pivot."""
    return np.sqrt(np.stack([squared(rows, p) for p in pivots], axis=1).astype(np.float64))


def nearest(rows: np.ndarray, table: np.ndarray, centroids: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Nearest centroid of each row (ties: the smaller number), its squared distance, and how many exact distances that took.

    ``table`` and ``marks`` are the pivot distances of the rows and the centroids.
    """
    bound = np.zeros((len(rows), len(centroids)))
    for p in range(table.shape[1]):
        np.maximum(bound, np.abs(table[:, p, None] - marks[None, :, p]), out=bound)
    # Distances are rounded doubles: the bound gives way by more than their error.
    bound = np.maximum(bound - 1e-9 * (1.0 + table.max(axis=1, initial=0.0)[:, None] + marks.max(initial=0.0)), 0.0) ** 2
    cluster = bound.argmin(axis=1)
    best = squared(rows, centroids[cluster])
    asked, first = len(rows), cluster.copy()
    for c in range(len(centroids)):
        at = np.flatnonzero((bound[:, c] <= best) & (first != c))
        if len(at):
            asked += len(at)
            exact = squared(rows[at], centroids[c])
            better = (exact < best[at]) | ((exact == best[at]) & (c < cluster[at]))
            best[at[better]], cluster[at[better]] = exact[better], c
    return cluster, best, asked


def _matrix(column, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def with_pivots(own: DataFrame, key: str, pivots: np.ndarray) -> DataFrame:
    """The table that all rounds read: ``key``, ``v`` and ``d``, the pivot distances."""

    def run(batches):
        for batch in batches:
            if len(batch):
                d = pivot_distances(_matrix(batch.column(1), np.int64), pivots)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(list(d), pa.list_(pa.float64()))], [key, "v", "d"])

    return own.select(key, "v").mapInArrow(run, f"`{key}` {own.schema[key].dataType.simpleString()}, v array<bigint>, d array<double>")


def next_centroids(table: DataFrame, centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Componentwise exact floor of the mean of each centroid's vectors; one without vectors stays.

    A task adds up its vectors and passes on one row a centroid.
    """
    marks = pivot_distances(centroids, pivots)
    width = centroids.shape[1]

    def run(batches):
        sums, counts = np.zeros(centroids.shape, np.int64), np.zeros(len(centroids), np.int64)
        for batch in batches:
            if len(batch):
                rows = _matrix(batch.column(0), np.int64)
                cluster, _, _ = nearest(rows, _matrix(batch.column(1), np.float64), centroids, marks)
                order = np.argsort(cluster, kind="stable")
                found, starts = np.unique(cluster[order], return_index=True)
                sums[found] += np.add.reduceat(rows[order], starts, axis=0)
                counts += np.bincount(cluster, minlength=len(centroids))
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts[held]), pa.array(list(sums[held]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    parts = table.select("v", "d").mapInArrow(run, "cluster long, n long, sums array<bigint>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"))
    moved = centroids.copy()
    # A row a centroid.
    for row in total.collect():
        moved[row["cluster"]] = [s // row["n"] for s in row["sums"]]
    return moved


def assign(table: DataFrame, key: str, centroids: np.ndarray, pivots: np.ndarray) -> DataFrame:
    """``key``, cluster, distance (squared) and ``asked``, the exact distances computed, in the first row of each batch."""
    marks = pivot_distances(centroids, pivots)

    def run(batches):
        for batch in batches:
            if len(batch):
                cluster, best, asked = nearest(_matrix(batch.column(1), np.int64), _matrix(batch.column(2), np.float64), centroids, marks)
                told = np.zeros(len(batch), np.int64)
                told[0] = asked
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), pa.array(best), pa.array(told)], [key, "cluster", "distance", "asked"])

    return table.select(key, "v", "d").mapInArrow(run, f"`{key}` {table.schema[key].dataType.simpleString()}, cluster int, distance long, asked long")


def cluster_vectors(
    vectors: DataFrame, key: str, vector: str, dimensions: int = DIMENSIONS, scale: int = SCALE, count: int = CENTROIDS, rounds: int = ROUNDS, pivots: int = PIVOTS, seed: int = SEED
) -> tuple[DataFrame, np.ndarray]:
    """Clusters of the usable rows of ``vectors`` after ``rounds`` rounds, and the final centroids.

    Returns (``key``, cluster, distance, asked) and a row of components a
    centroid. Rows whose vector is null, of another length, or holds a null or
    a value that is not finite are left out; equal vectors, repeated rows and
    null keys are rows like others; fewer vectors than ``count`` give as many
    centroids, and none gives none. Other columns are not read.

    The table of vectors and pivot distances is written once and read every
    round; the driver sees ``count`` rows a round.
    """
    own = integer_vectors(vectors, key, vector, dimensions, scale)
    centroids = first_centroids(own, key, count, seed)
    if not len(centroids):
        none = own.select(key, F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance"), F.lit(0).cast("long").alias("asked")).limit(0)
        return none, centroids
    fixed = choose_pivots(centroids, pivots)
    table = staged(with_pivots(own, key, fixed), "pivot-table")
    for _ in range(rounds):
        centroids = next_centroids(table, centroids, fixed)
    found = staged(assign(table, key, centroids, fixed), "clusters")
    discard(table)
    return found, centroids


def digest_clusters(found: DataFrame, centroids: np.ndarray, key: str) -> DataFrame:
    """``key``, cluster, distance, inertia of its cluster and of all, SHA-256 of its centroid."""
    # A row a centroid.
    sums = {row["cluster"]: row["s"] for row in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    rows = [(c, s, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in sorted(sums.items())]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.select(key, "cluster", "distance").join(F.broadcast(told), "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
