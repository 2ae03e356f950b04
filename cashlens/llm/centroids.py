"""Centroid clustering: Lloyd's rounds in whole numbers, each vector finding its nearest centroid by Orchard's search.

Every centroid has a list of the others, nearest first. A vector starts at centroid 0 and walks its list; a closer
centroid takes over with its own list from the front, seen centroids are marked and not measured again, and the walk
ends at the first neighbour strictly beyond twice the current distance: no later one can be closer, nor as close. So
the result is exact, ties go to the smaller number, and all rows of an Arrow batch walk at once.

A round reads the table once and shuffles nothing but sums: a task emits one row per centroid. Centroids and their
lists are ``k`` rows whatever the input, so they travel in the task's closure. Only the last assignment is written
(id, cluster, distance), because the inertia of its clusters goes back to each of its rows.

Defined cases: vectors that are null, of other length or hold null or non-finite components are left out; a row
without id takes part, but starts no centroid while there are rows with one; repeated ids are rows of their own, in
order of their vectors where they start centroids; fewer rows than ``k`` give as many centroids; an empty table gives
no rows; components beyond ``vectors.magnitude`` (at 64 components about 190 million after scaling) stand at that bound,
inertia ends at the largest long; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cashlens.llm.common import scratch_dir, written
from cashlens.llm.vectors import LONG_MAX, finite_vectors, floored_means, whole


class Orchard:
    """Exact nearest centroids by sorted neighbour lists."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        k = len(centroids)
        gaps = ((centroids[:, None] - centroids[None]) ** 2).sum(-1)
        lists = [sorted((j for j in range(k) if j != i), key=lambda j: (gaps[i, j], j)) for i in range(k)]  # noqa: B023
        self.lists = np.array(lists, np.int64).reshape(k, k - 1)
        # gap > 4 * d, kept as (gap - 1) // 4 >= d, which no long overflows
        self.reach = (np.take_along_axis(gaps, self.lists, 1) - 1) // 4

    def distances(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((x - self.centroids[which]) ** 2).sum(1)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid and its squared distance, per row of ``x``."""
        n, k = len(x), len(self.centroids)
        best, at = np.zeros(n, np.int64), np.zeros(n, np.int64)
        distance = self.distances(x, best)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        walking = np.arange(n if k > 1 else 0)
        while len(walking):
            walking = walking[self.reach[best[walking], at[walking]] < distance[walking]]
            other = self.lists[best[walking], at[walking]]
            at[walking] += 1
            new = ~seen[walking, other]
            row, other = walking[new], other[new]
            seen[row, other] = True
            d = self.distances(x[row], other)
            closer = (d < distance[row]) | ((d == distance[row]) & (other < best[row]))
            row = row[closer]
            best[row], distance[row], at[row] = other[closer], d[closer], 0
            walking = walking[at[walking] < k - 1]
        return best, distance


def first_centroids(vectors: DataFrame, k: int, scale: int, dims: int) -> np.ndarray:
    """The ``k`` kept vectors whose ids have the smallest digests, in that order."""
    kept = vectors.where(F.size("embedding") == dims).where(
        F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    )
    key = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.select(key.alias("key"), "embedding").orderBy(F.col("key").asc_nulls_last(), "embedding").limit(k).collect()
    return whole(np.array([r["embedding"] for r in rows], np.float64).reshape(len(rows), dims), scale)


def updated(vectors: DataFrame, centroids: np.ndarray, scale: int) -> np.ndarray:
    """One round: assign every vector, and take the floored mean of each centroid's members."""
    k, dims = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, sums, counts = Orchard(centroids), np.zeros((k, dims), np.int64), np.zeros(k, np.int64)
        for batch in batches:
            x = whole(finite_vectors(batch.column(0), dims)[1], scale)
            cluster, _ = search.nearest(x)
            np.add.at(sums, cluster, x)
            counts += np.bincount(cluster, minlength=k)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(counts[used]), pa.array(sums[used].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"]
            )

    parts = vectors.select("embedding").mapInArrow(run, "cluster int, n bigint, sums array<bigint>")
    totals = parts.select("cluster", "n", F.posexplode("sums").alias("at", "value")).groupBy("cluster", "at")
    rows = totals.agg(F.sum("n").alias("n"), F.sum(F.col("value").cast("decimal(38,0)")).alias("total")).collect()
    sums, counts = np.zeros((k, dims), object), [0] * k
    for r in rows:  # k times dims at most
        sums[r["cluster"], r["at"]], counts[r["cluster"]] = int(r["total"]), r["n"]
    return floored_means(sums, counts, centroids)


def assigned(vectors: DataFrame, centroids: np.ndarray, scale: int) -> DataFrame:
    """vec_id, cluster and squared distance of every kept vector."""
    dims = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Orchard(centroids)
        for batch in batches:
            rows, x = finite_vectors(batch.column(1), dims)
            cluster, distance = search.nearest(whole(x, scale))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(cluster.astype(np.int32)), pa.array(distance)], names=["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.select("vec_id", "embedding").mapInArrow(run, f"vec_id {kind}, cluster int, distance bigint")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dims: int = 64) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept row of vec_id, embedding."""
    spark = vectors.sparkSession
    centroids = first_centroids(vectors, k, scale, dims)
    if not len(centroids):
        return vectors.limit(0).selectExpr(
            "vec_id", "0 as cluster", "0L as distance", "0L as cluster_inertia", "0L as inertia", "'' as centroid_sha256"
        )
    for _ in range(rounds):
        centroids = updated(vectors, centroids, scale)
    rows = written(assigned(vectors, centroids, scale), scratch_dir(spark), "assigned")
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()
    inertia = {r["cluster"]: int(r["total"]) for r in sums}
    total = min(sum(inertia.values()), LONG_MAX)
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in centroids]
    of = spark.createDataFrame(
        [(c, min(v, LONG_MAX), total, digests[c]) for c, v in sorted(inertia.items())],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    # at most k rows
    return rows.join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
