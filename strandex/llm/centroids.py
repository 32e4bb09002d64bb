"""Centroid clustering of vectors in whole numbers, with Fagin's threshold algorithm for the nearest centroid.

For each dimension the centroids are sorted by their component. A vector enters each list at its own component and walks outward, nearest entry first; a centroid that a list
shows for the first time gets its exact distance. No centroid that hasn't been shown yet is nearer than the sum of the squared gaps to the lists' next entries (the frontier), so the walk stops when
that sum strictly exceeds the best distance; at equality a centroid of a smaller number may still come. Vectors of a batch walk side by side in numpy.

Tasks add up their vectors per centroid before anything is shuffled; the driver sees the k centroids and their sums only.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

LARGEST = 1 << 27  # components up to here keep squared distances of 64 dimensions inside 64 bits
SMALL = 1 << 22  # squared distances of 64 such components stay below 2**53
BATCH = 512  # vectors that walk at once
FAR = np.iinfo(np.int64).max // 256


class Lists:
    """Sorted lists of the centroids (k x d whole numbers), one for each dimension."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.order = np.argsort(centroids, 0, kind="stable").T.copy()  # d x k: centroid numbers by component
        self.values = np.take_along_axis(centroids.T, self.order, 1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row of x the nearest centroid (ties: the smaller number) and its squared distance; and how many distances were computed."""
        (k, d), n = self.centroids.shape, len(x)
        best, who = np.full(n, FAR * 255, np.int64), np.zeros(n, np.int64)
        seen = np.zeros((n, k), bool)
        high = np.stack([np.searchsorted(self.values[j], x[:, j]) for j in range(d)], 1)  # next entry above in each list
        low = high - 1
        live, dims, computed = np.arange(n), np.arange(d), 0
        # Floats hold small whole numbers and their sums exactly, and are faster.
        small = max(np.abs(x).max(initial=0), np.abs(self.centroids).max(initial=0)) <= SMALL and d <= 64
        exact, means = (x.astype(float), self.centroids.astype(float)) if small else (x, self.centroids)
        while len(live):
            v, lo, hi = x[live], low[live], high[live]
            below = np.where(lo >= 0, v - self.values[dims, np.maximum(lo, 0)], FAR)
            above = np.where(hi < k, self.values[dims, np.minimum(hi, k - 1)] - v, FAR)
            down = below <= above
            shown = np.where(down, self.order[dims, np.maximum(lo, 0)], self.order[dims, np.minimum(hi, k - 1)])
            fresh = np.zeros((len(live), k), bool)
            fresh[np.arange(len(live))[:, None], shown] = True
            fresh &= ~seen[live]
            seen[live] |= fresh
            distance = np.full((len(live), k), FAR * 255, np.int64)
            for c in np.flatnonzero(fresh.any(0)).tolist():
                i = np.flatnonzero(fresh[:, c])
                gap = exact[live[i]] - means[c]
                distance[i, c] = np.einsum("ij,ij->i", gap, gap)
                computed += len(i)
            near = distance.argmin(1)  # the first of equals
            dist = distance[np.arange(len(live)), near]
            better = (dist < best[live]) | ((dist == best[live]) & (near < who[live]))
            best[live[better]], who[live[better]] = dist[better], near[better]
            low[live], high[live] = lo - down, hi + ~down
            lo, hi = low[live], high[live]
            frontier = np.minimum(np.where(lo >= 0, v - self.values[dims, np.maximum(lo, 0)], FAR), np.where(hi < k, self.values[dims, np.minimum(hi, k - 1)] - v, FAR))
            over = seen[live].all(1) | (frontier == FAR).any(1)  # all centroids have been shown
            bound = np.where(over, 0, (np.where(over[:, None], 0, frontier) ** 2).sum(1))
            live = live[~over & (bound <= best[live])]
        return who, best, computed


def _whole(it, d: int):
    """vec_id and v (whole numbers as bytes) of vectors with d finite components."""
    for batch in it:
        lists = batch.column(1)
        if isinstance(lists, pa.ChunkedArray):
            lists = lists.combine_chunks()
        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        right = np.flatnonzero(size == d)  # null lists have no length
        x = lists.take(pa.array(right)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)  # null components become nan
        ok = np.isfinite(x).all(1)
        q = np.floor(256 * x[ok])
        if len(q) and np.abs(q).max() > LARGEST:
            raise ValueError("a component is too large for squared distances of 64 bits")
        kept = batch.column(0).take(pa.array(right[ok]))
        yield pa.RecordBatch.from_arrays([kept, pa.array([r.tobytes() for r in q.astype("<i4")], pa.binary())], ["vec_id", "v"])


def _rows(it, d: int):
    """ids and whole-number matrices, BATCH rows at a time."""
    for batch in it:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            x = np.frombuffer(b"".join(part.column(1).to_pylist()), "<i4").reshape(-1, d).astype(np.int64)
            yield part.column(0), x


def _sums(it, centroids: np.ndarray):
    """A row for each centroid that a task's vectors chose: cluster, n, sums."""
    lists, (k, d) = Lists(centroids), centroids.shape
    n, sums = np.zeros(k, np.int64), np.zeros((k, d), np.int64)
    for _, x in _rows(it, d):
        who = lists.nearest(x)[0]
        n += np.bincount(who, minlength=k)
        np.add.at(sums, who, x)
    at = np.flatnonzero(n)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at]), pa.array(list(sums[at]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])


def _chosen(it, centroids: np.ndarray):
    lists = Lists(centroids)
    for ids, x in _rows(it, centroids.shape[1]):
        who, best, _ = lists.nearest(x)
        yield pa.RecordBatch.from_arrays([ids, pa.array(who, pa.int32()), pa.array(best)], ["vec_id", "cluster", "distance"])


def whole_vectors(vectors: DataFrame, d: int = 64) -> DataFrame:
    """vec_id, v: rows of vectors (vec_id, embedding) with exactly d components, none null or not finite; v holds floor(256 * x) of each as bytes. Others go.
    A component of 2**19 or more is an error."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(partial(_whole, d=d), "vec_id long, v binary")


def clusters(vectors: DataFrame, k: int = 40, rounds: int = 5, seed: str = "2", d: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each row kept by whole_vectors().

    The first centroids are the k vectors with the smallest sha256 of "seed:vec_id", in that order (rows that repeat a vec_id: by their components, so equal
    centroids can occur; the smaller number wins ties). Rows with a null vec_id are clustered but never a first centroid. With fewer than k such rows there
    are fewer centroids; without any, or from an empty table, the result is empty. Means are exact, rounded down; empty clusters keep their centroid.
    """
    spark = vectors.sparkSession
    kept = stored(whole_vectors(vectors, d), "vectors")
    named = kept.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"), "v")
    first = [bytes(r.v) for r in named.orderBy("h", "v").limit(k).collect()]
    out = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], out + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.frombuffer(b"".join(first), "<i4").reshape(-1, d).astype(np.int64)
    for _ in range(rounds):
        parts = kept.mapInArrow(partial(_sums, centroids=centroids), "cluster int, n long, sums array<long>")
        total = parts.select("cluster", "n", F.posexplode("sums").alias("dim", "s")).groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        centroids = centroids.copy()
        for r in total.collect():  # k * d rows at most
            centroids[r.cluster, r.dim] = r.s // r.n
    chosen = stored(kept.mapInArrow(partial(_chosen, centroids=centroids), out), "clusters")
    inertia = {r.cluster: r.s for r in chosen.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    rows = [(c, s, sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, s in inertia.items()]
    about = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return chosen.join(about, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
