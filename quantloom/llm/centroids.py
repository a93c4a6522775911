"""Exact clustering of integer vectors around centroids, screened with float32 products and rounding-error bounds."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import free_name, materialize

#: Components are at most this large, so that squared distances of up to 2^13 components fit in 64 bits.
LARGEST = 2**23


def grid_vector(vector: Column, dim: int, scale: int) -> Column:
    """The components times ``scale``, rounded down, as longs; null unless the vector has exactly ``dim``
    components, all finite and not beyond ``LARGEST`` then."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float(LARGEST))
    good = (F.size(vector) == dim) & F.forall(vector, fits)
    return F.when(good, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


@dataclass(frozen=True)
class Screen:
    """Centroids with what the bounds on float32 products need.

    The squared distance less that of the vector itself is |c|^2 - 2 x.c. A float32 product of d components, summed in
    any order, differs from x.c by at most g |x| |c| with g = m u / (1 - m u), m = d + 2 roundings (the two of making
    the components float32 included) and u = 2^-24; norms and the rest are taken in float64 and rounded up."""

    exact: np.ndarray
    single: np.ndarray
    square: np.ndarray
    norm: np.ndarray

    @classmethod
    def of(cls, centroids: list[list[int]]) -> "Screen":
        exact = np.array(centroids, np.int64)
        square = (exact * exact).sum(1)
        return cls(exact, exact.astype(np.float32).T.copy(), square.astype(np.float64), np.sqrt(square.astype(np.float64)) * (1 + 1e-12))

    def intervals(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds below and above |c|^2 - 2 x.c for each vector and centroid."""
        m = (x.shape[1] + 2) * 2.0**-24
        length = np.sqrt((x.astype(np.float64) ** 2).sum(1)) * (1 + 1e-12)
        about = self.square - 2 * (x.astype(np.float32) @ self.single).astype(np.float64)
        error = 2 * m / (1 - m) * length[:, None] * self.norm + 1e-14 * (self.square + np.abs(about)) + 2.0**-100
        return about - error, about + error

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The centroid nearest to each vector, the lowest of equally near ones, and the squared distance. One whose
        interval lies below all others is nearest for sure; where intervals overlap, those are computed exactly."""
        low, high = self.intervals(x)
        near = low <= high.min(1, keepdims=True)
        cluster = near.argmax(1)
        unsure = np.flatnonzero(near.sum(1) > 1)
        row, c = np.nonzero(near[unsure])
        gap = x[unsure[row]] - self.exact[c]
        distance = np.full((len(unsure), len(self.exact)), np.iinfo(np.int64).max)
        distance[row, c] = (gap * gap).sum(1)
        cluster[unsure] = distance.argmin(1)
        gap = x - self.exact[cluster]
        return cluster, (gap * gap).sum(1)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> list:
    """(cluster, n, sums) of each cluster that has vectors: a row a task and cluster, added up by Spark."""
    dim, k = len(centroids[0]), len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, n, sums = Screen.of(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            for at in range(0, len(batch), 8192):
                x = _matrix(batch.column("vector").slice(at, 8192), dim)
                cluster = screen.nearest(x)[0]
                order = np.argsort(cluster, kind="stable")
                there, first = np.unique(cluster[order], return_index=True)
                n += np.bincount(cluster, minlength=k)
                sums[there] += np.add.reduceat(x[order], first, axis=0)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some], pa.int64()), "sums": pa.array(sums[some].tolist(), pa.list_(pa.int64()))})

    parts = vectors.select("vector").mapInArrow(add, "cluster int, n long, sums array<long>")
    total = [F.sum(F.element_at("sums", i + 1).cast("decimal(38,0)")).alias(f"s{i}") for i in range(dim)]
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*total).alias("sums")).collect()


def exact_clusters(vectors: DataFrame, clusters: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, salt: str = "1:") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of the vectors of ``vectors`` (vec_id,
    embedding) that have exactly ``dim`` components, none null or non-finite, each times ``scale`` and rounded down.

    The first centroids are the ``clusters`` vectors with the smallest sha256 of ``salt`` and vec_id, all of them if
    there are fewer; equal ids go by their components, null ids come last. ``rounds`` times each vector goes to its
    nearest centroid by squared distance (the lower number of equally near ones), and each centroid that has vectors
    to the componentwise floor of their mean; then vectors are assigned once more. All results are exact integers.

    Vectors with a component of ``LARGEST`` or more after scaling are left out, as their distances could pass 64
    bits; an inertia beyond 64 bits is null. Rows with equal ids are vectors of their own, and null ids come back
    null. Without a vector that can be used there are no rows. Other columns are not read. The driver holds the
    centroids only.
    """
    rows = vectors.select(F.col("vec_id").alias("vec_id"), grid_vector(F.col("embedding"), dim, scale).alias("vector")).where("vector is not null")
    named = rows.withColumn("name", F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256))
    first = named.orderBy(F.asc_nulls_last("name"), "vector").limit(clusters).collect()
    spark = vectors.sparkSession
    if not first:
        empty = f"vec_id {vectors.schema['vec_id'].dataType.simpleString()}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return spark.createDataFrame([], empty)
    centroids = [list(r["vector"]) for r in first]
    for _ in range(rounds):
        for r in _sums(rows, centroids):
            centroids[r["cluster"]] = [int(s) // r["n"] for s in r["sums"]]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen.of(centroids)
        for batch in batches:
            for at in range(0, len(batch), 8192):
                some = batch.slice(at, 8192)
                cluster, distance = screen.nearest(_matrix(some.column("vector"), dim))
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=["vec_id", "cluster", "distance"])

    out = f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, cluster int, distance long"
    assigned = materialize(rows.mapInArrow(assign, out), "assigned")
    sums = {r["cluster"]: int(r["inertia"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia")).collect()}
    told = lambda n: n if n < 2**63 else None
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(c, told(n), told(sum(sums.values())), sha[c]) for c, n in sums.items()]
    number = free_name("cluster_", assigned.columns)
    table = spark.createDataFrame(facts, f"{number} int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(table), F.col("cluster") == F.col(number)).drop(number)
