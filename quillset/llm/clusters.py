"""k-means over whole numbers, with the nearest centroid found by the threshold algorithm (Fagin, Lotem and Naor, 2001).

Each dimension keeps the centroids in order of their value. From a vector's own value, every dimension is walked outward, nearest value first, all
dimensions in step; a centroid met in any dimension gets its exact distance. No centroid unmet so far can be nearer than the sum of
the squared frontier distances, so a vector is settled once that sum is strictly greater than its best exact distance (at equality an unmet
centroid with a smaller number could tie).

Vectors become integers floor(1024 x), so that sums, means and distances are exact and the same however Spark deals the rows. A round reads the stored
vectors once and adds up one row of sums per batch and cluster; only ``clusters`` rows reach the driver, whatever the number of vectors.

Defined results: rows whose vector is null, has another number of components than ``dims``, or holds null or non-finite components are left out, as are
components of magnitude 2^17 or more, whose squared distances would not fit 64 bits. A null vec_id is clustered but never starts a centroid; rows that repeat an id start
at most one centroid (with the smallest vector). With fewer ids than clusters there are as many centroids as ids; with null ids only, one,
the smallest vector; without usable vectors, no rows.
Ties go to the smaller centroid number; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillset.llm.shared import Scratch, own_columns

SCALE, LARGEST, ROWS_AT_ONCE = 1024, 2.0**17, 4096


class SortedCentroids:
    """Per dimension, the centroids' values in order, with the walk that finds each vector's nearest centroid."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        order = np.argsort(centroids, axis=0, kind="stable")
        self.number = order.T.copy()  # dims x k: which centroid stands at a place
        self.value = np.take_along_axis(centroids, order, axis=0).T.copy()

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid number, squared distance) of each vector."""
        n, dims = vectors.shape
        k = len(self.centroids)
        best, at = np.full(n, np.iinfo(np.int64).max), np.full(n, k, dtype=np.int64)
        met = np.zeros((n, k), dtype=bool)
        right = np.stack([np.searchsorted(self.value[d], vectors[:, d]) for d in range(dims)], axis=1)
        left, open_, dim = right - 1, np.arange(n), np.arange(dims)[None, :]
        far = np.iinfo(np.int64).max
        for _ in range(k):
            x, lo, hi = vectors[open_], left[open_], right[open_]
            below = np.where(lo >= 0, x - self.value[dim, np.maximum(lo, 0)], far)
            above = np.where(hi < k, self.value[dim, np.minimum(hi, k - 1)] - x, far)
            down = below <= above
            place = np.where(down, lo, hi)
            left[open_], right[open_] = lo - down, hi + ~down
            new = np.zeros((len(open_), k), dtype=bool)
            new[np.arange(len(open_))[:, None], self.number[dim, place]] = True
            new &= ~met[open_]
            met[open_] |= new
            for c in range(k):
                rows = np.flatnonzero(new[:, c])
                if len(rows):
                    away = x[rows] - self.centroids[c]
                    distance, who = np.einsum("ij,ij->i", away, away), open_[rows]
                    better = (distance < best[who]) | ((distance == best[who]) & (c < at[who]))
                    best[who[better]], at[who[better]] = distance[better], c
            frontier = np.where(down, below, above)
            unsettled = np.einsum("ij,ij->i", frontier, frontier) <= best[open_]
            open_ = open_[unsettled & ~met[open_].all(axis=1)]
            if not len(open_):
                break
        return at, best


def _vectors(batch: pa.RecordBatch, dims: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        part = batch.slice(at, ROWS_AT_ONCE)
        yield part, part.column("v").flatten().to_numpy().reshape(-1, dims).astype(np.int64)


def _whole_numbers(rows: DataFrame, vec_id: str, embedding: str, dims: int) -> DataFrame:
    raw = own_columns(rows, vec_id=vec_id, x=embedding).select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("x").cast("array<double>").alias("x"))
    sound = (F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST))
    return raw.filter(F.coalesce(sound, F.lit(False))).select("vec_id", F.transform("x", lambda c: F.floor(c * SCALE).cast("int")).alias("v"))


def _round_sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n, sums: one row per batch and cluster."""
    dims = centroids.shape[1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedCentroids(centroids)
        for batch in batches:
            sums, counts = np.zeros_like(centroids), np.zeros(len(centroids), dtype=np.int64)
            for _, v in _vectors(batch, dims):
                at, _ = lists.nearest(v)
                np.add.at(sums, at, v)
                counts += np.bincount(at, minlength=len(centroids))
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(counts[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return vectors.select("v").mapInArrow(work, "cluster int, n bigint, sums array<bigint>")


def fit_centroids(vectors: DataFrame, clusters: int, rounds: int) -> np.ndarray:
    """Centroids after ``rounds`` rounds, from the ids with the smallest hashes; fewer rounds when one changes nothing."""
    starts = vectors.filter("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("v").alias("v"))
    named = starts.select(F.sha2(F.concat(F.lit("3:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v")
    centroids = np.array([r.v for r in named.orderBy("h").limit(clusters).collect()], dtype=np.int64)
    if not len(centroids):
        return centroids
    dims = centroids.shape[1]
    for _ in range(rounds):
        total = [F.sum(F.col("sums")[d].cast("decimal(38,0)")).alias(f"s{d}") for d in range(dims)]
        moved = centroids.copy()
        for r in _round_sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():  # one row per cluster
            moved[r.cluster] = [int(r[f"s{d}"]) // r.n for d in range(dims)]
        if (moved == centroids).all():
            break
        centroids = moved
    return centroids


def cluster_vectors(rows: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid (its components): one row per usable vector."""
    spark = rows.sparkSession
    scratch = Scratch(spark, "clusters")
    vectors = scratch.store(_whole_numbers(rows, vec_id, embedding, dims), "vectors")
    centroids = fit_centroids(vectors, clusters, rounds)
    if not len(centroids):  # no ids, or no vectors at all
        centroids = np.array([vectors.agg(F.min("v")).first()[0] or [0] * dims], dtype=np.int64)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists = SortedCentroids(centroids)
        for batch in batches:
            for part, v in _vectors(batch, dims):
                at, distance = lists.nearest(v)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(at.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    placed = scratch.store(vectors.mapInArrow(work, "vec_id bigint, cluster int, distance bigint"), "placed")
    per_cluster = {r.cluster: int(r.s) for r in placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # one row per cluster
    facts = [(c, per_cluster.get(c, 0), sum(per_cluster.values()), [int(x) for x in centroid]) for c, centroid in enumerate(centroids)]
    table = spark.createDataFrame(facts, "cluster int, cluster_inertia bigint, inertia bigint, centroid array<bigint>")
    return placed.join(F.broadcast(table), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")
