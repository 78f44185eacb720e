"""Centroid clustering (Lloyd's rounds on whole numbers) with annulus search for the nearest centroid.

By the triangle inequality a centroid nearer than ``u`` to a vector has a norm within ``u`` of the vector's. Centroids are sorted by
norm. For each vector, the one whose norm is next to its own gives the upper bound ``u``; a binary search finds the
centroids with norms in the annulus of that half-width, a rounding margin wider, so that ties at the boundary are among
them; these alone are compared, by exact integer distances, ties to the smaller number.

Vectors are read once, turned to whole numbers and written; each round is one pass over that table, in which a
task sends a count and a sum per cluster and component (combined before the shuffle). The driver holds the centroids only: k times the
dimensions, both parameters, whatever the number of vectors. Nothing is shuffled by vector or cluster, so no cluster's size matters.

Rows with a null vector, another length, a null or non-finite component are left out; a null id is hashed as the empty
text and returned as null. Repeated rows are vectors of their own; equal hashes are ordered by components. With fewer than k
vectors there are as many centroids as vectors; without any the result is empty. Components of 2**24 or more in size after scaling
raise an error, as their squared distances might leave 64 bits. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

K, ROUNDS, DIMENSIONS, SCALE, SEED = 16, 3, 64, 64, 1
LARGEST = 1 << 24
_ROWS = 4096  # vectors that are compared at once


def whole_vectors(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that are complete and finite, their components times ``scale`` rounded down."""
    x = F.transform(F.col(vector), lambda e: e.cast("double") * F.lit(float(scale)))
    finite = F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    small = F.forall("x", lambda e: F.abs(e) < LARGEST)
    checked = F.when(small, F.transform("x", lambda e: F.floor(e).cast("int"))).otherwise(F.raise_error(F.lit(f"a component is {LARGEST} or more after scaling")).cast("array<int>"))
    kept = vectors.select(F.col(id_).cast("long").alias("id"), x.alias("x")).where((F.size("x") == dimensions) & finite)
    return kept.select("id", checked.alias("v"))


def first_centroids(kept: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors with the smallest hashes of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.orderBy(digest, "v").limit(k).select("v").collect()
    return np.array([r.v for r in rows], np.int64)


class Annuli:
    """Centroids in order of their norms."""

    def __init__(self, centroids: np.ndarray) -> None:
        self.order = np.argsort((centroids.astype(np.float64) ** 2).sum(1), kind="stable")
        self.centroids = centroids[self.order]
        self.norms = np.sqrt((self.centroids.astype(np.float64) ** 2).sum(1))

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(cluster, squared distance) of each row of ``v``, and how many distances were taken."""
        norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
        right = np.clip(np.searchsorted(self.norms, norm), 1, max(1, len(self.norms) - 1))
        left = right - 1
        right = np.minimum(right, len(self.norms) - 1)
        guess = np.where(norm - self.norms[left] <= self.norms[right] - norm, left, right)
        best = ((v - self.centroids[guess]) ** 2).sum(1)
        number, taken = self.order[guess], len(v)
        reach = np.sqrt(best.astype(np.float64))
        reach += 1e-9 * (reach + norm + 1)
        low, high = np.searchsorted(self.norms, norm - reach), np.searchsorted(self.norms, norm + reach, "right")
        for at in range(len(self.norms)):
            inside = np.flatnonzero((low <= at) & (at < high) & (guess != at))
            if not len(inside):
                continue
            far, own = ((v[inside] - self.centroids[at]) ** 2).sum(1), self.order[at]
            closer = (far < best[inside]) | ((far == best[inside]) & (own < number[inside]))
            best[inside[closer]], number[inside[closer]] = far[closer], own
            taken += len(inside)
        return number, best, taken


def _pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for low in range(0, batch.num_rows, _ROWS):
        part = batch.slice(low, _ROWS)
        yield part, np.asarray(part.column(1).flatten()).astype(np.int64).reshape(part.num_rows, -1)


def _summer(centroids: np.ndarray):
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per cluster: (cluster, n, inertia, components' sums) of a task's (id, v) rows."""
        annuli, k = Annuli(centroids), len(centroids)
        n, inertia, total = np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros(centroids.shape, np.int64)
        for batch in batches:
            for _, v in _pieces(batch):
                cluster, distance, _ = annuli.nearest(v)
                n += np.bincount(cluster, minlength=k)
                np.add.at(inertia, cluster, distance)
                np.add.at(total, cluster, v)
        some = np.flatnonzero(n)
        columns = [pa.array(some), pa.array(n[some]), pa.array(inertia[some]), pa.array(list(total[some]), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "inertia", "total"])

    return sums


def _summed(kept: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each cluster: size, inertia, sums of the components."""
    parts = kept.mapInArrow(_summer(centroids), "cluster long, n long, inertia long, total array<long>")
    totals = [F.sum(F.col("total")[i]).alias(f"t{i}") for i in range(centroids.shape[1])]
    n, inertia, total = np.zeros(len(centroids), np.int64), np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
    for cluster, size, own, *sums in parts.groupBy("cluster").agg(F.sum("n"), F.sum("inertia"), *totals).collect():
        n[cluster], inertia[cluster], total[cluster] = size, own, sums
    return n, inertia, total


def _placer(centroids: np.ndarray, inertia: np.ndarray):
    digests = np.array([hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, whole = Annuli(centroids), int(inertia.sum())
        for batch in batches:
            for part, v in _pieces(batch):
                cluster, distance, taken = annuli.nearest(v)
                columns = [part.column(0), pa.array(cluster.astype(np.int32)), pa.array(distance), pa.array(inertia[cluster])]
                columns += [pa.array(np.full(len(v), whole)), pa.array(digests[cluster].tolist(), pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return place


_OUT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dimensions: int = DIMENSIONS, scale: int = SCALE, seed: int = SEED) -> DataFrame:
    """Per complete vector of ``vectors`` (vec_id, embedding): vec_id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    A round assigns all vectors, then moves each centroid that has any to the rounded-down mean of its vectors.
    """
    kept = Scratch(vectors.sparkSession, "annulus").write(whole_vectors(vectors, dimensions=dimensions, scale=scale), "vectors")
    centroids = first_centroids(kept, k, seed)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], _OUT)
    for _ in range(rounds):
        n, _, total = _summed(kept, centroids)
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
    return kept.mapInArrow(_placer(centroids, _summed(kept, centroids)[1]), _OUT)
