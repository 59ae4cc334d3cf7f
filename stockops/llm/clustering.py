"""Centroid clustering with integer arithmetic and bounds that skip most distances.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the distance to
any other one. When centroids have moved, the upper bound grows by the drift of its own centroid. The
lower bound shrinks by less than the greatest drift: the vectors of a cluster lie in a sphere about
their old centroid, and seen from a centroid that moves, the sphere fills a cone. The distance to that
centroid can shrink at most by the drift times the cosine of the angle between the drift and the nearest
edge of the cone, which is a matter of the plane through the three centres. The drift is walked in a few
steps, each with its own cone. Vectors whose bounds cross are ambiguous and scanned exactly.

A round writes the vectors with their cluster and bounds as a table; sums over clusters are exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import forget
from .common import ship, written

ship(__name__)

#: Integers beyond this size are exact in 64-bit arithmetic only, up to the greatest one that is kept.
EXACT_IN_DOUBLES, GREATEST = 1 << 22, 1 << 27

STATE = "vec_id long, v array<int>, cluster int, upper double, lower double"


def integer_vectors(vectors: DataFrame, dims: int = 64, scale: int = 256) -> DataFrame:
    """vec_id, v: floor(scale * x) of vectors with exactly ``dims`` components, none null or non-finite.

    Components of 2^27 or more after scaling are left out with their vectors: squared distances would not
    fit a long.
    """
    x = F.col("embedding").cast("array<double>")
    fine = lambda c: F.coalesce(F.abs(F.floor(c * scale)) < GREATEST, F.lit(False)) & ~F.isnan(c)
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).where((F.size("x") == dims) & F.forall("x", lambda c: c.isNotNull() & (F.abs(c) < float("inf"))))
    return kept.where(F.forall("x", fine)).select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def seeds(vectors: DataFrame, k: int, salt: str = "2:") -> np.ndarray:
    """The k vectors of the smallest SHA-256 of salt and vec_id, in that order; fewer if there are fewer.
    Vectors without an id are never seeds."""
    digest = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.where("vec_id is not null").orderBy(digest, "v").select("v").limit(k).collect()
    return np.array([r.v for r in rows], np.int64)


def squared_distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as int64."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) <= EXACT_IN_DOUBLES:
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    x, c = x.astype(np.int64), centroids.astype(np.int64)
    return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray, steps: int = 4) -> np.ndarray:
    """By how much the lower bounds of each cluster's vectors loosen when centroids move from old to new.

    ``radius``: of the sphere about the old centroid that holds the cluster's vectors. Never more than the
    greatest drift of another centroid.
    """
    old, move = old.astype(np.float64), (new - old).astype(np.float64)
    drift = np.sqrt((move**2).sum(1))
    least = np.zeros((len(old), len(old)))
    for s in range(steps):
        at = old + move * (s / steps)  # cosines shrink along the way, so a step's first place bounds it
        apart = old[:, None, :] - at[None, :, :]
        far = np.sqrt((apart**2).sum(2))
        with np.errstate(invalid="ignore", divide="ignore"):
            cosine = np.clip((apart * move[None, :, :]).sum(2) / (far * drift), -1, 1)
            edge = np.maximum(0.0, np.arccos(cosine) - np.arcsin(np.minimum(1.0, radius[:, None] / far)))
            shrink = np.where(far > radius[:, None], np.cos(edge), 1.0)
        least += np.where(drift > 0, drift / steps * shrink, 0.0)
    np.fill_diagonal(least, -np.inf)
    return np.minimum(least.max(1, initial=-np.inf), drift.max(initial=0.0)) if len(old) > 1 else np.zeros(1)


def assign(x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest centroids (the smaller number of equally near ones) given bounds: cluster, upper, lower and how
    many rows were scanned. Rows whose bounds are apart keep their cluster."""
    cluster, upper, lower = cluster.copy(), upper.copy(), lower.copy()
    crossed = lambda rows: rows[upper[rows] * (1 + 1e-9) + 1e-6 >= lower[rows]]
    rows = crossed(np.arange(len(x)))
    own = rows[cluster[rows] >= 0]
    upper[own] = np.sqrt(((x[own].astype(np.int64) - centroids[cluster[own]]) ** 2).sum(1).astype(np.float64))
    rows = crossed(rows)
    if len(rows):
        d = squared_distances(x[rows], centroids)
        cluster[rows] = d.argmin(1)
        near = np.partition(d, min(1, d.shape[1] - 1), axis=1)
        upper[rows] = np.sqrt(near[:, 0].astype(np.float64))
        lower[rows] = np.sqrt(near[:, 1].astype(np.float64)) if d.shape[1] > 1 else np.inf
    return cluster, upper, lower, len(rows)


def matrix(column: pa.ListArray | pa.ChunkedArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0), np.int32)


def assigned(state: DataFrame, centroids: np.ndarray, drift: np.ndarray, loose: np.ndarray) -> DataFrame:
    """One assignment of all vectors; bounds of the last one are moved along first."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            cluster, upper, lower = (b.column(i).to_numpy() for i in (2, 3, 4))
            cluster, upper, lower, _ = assign(matrix(b.column(1)), cluster, upper + drift[cluster], lower - loose[cluster], centroids)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower)], ["vec_id", "v", "cluster", "upper", "lower"])

    return state.mapInArrow(batches, STATE)


def cluster_sums(state: DataFrame) -> list:
    """cluster, n, sums (exact), radius: one row a cluster; tasks add up their own vectors first."""

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if not b.num_rows:
                continue
            cluster, x = b.column(1).to_numpy(), matrix(b.column(0)).astype(np.int64)
            ids, row = np.unique(cluster, return_inverse=True)
            sums, radius = np.zeros((len(ids), x.shape[1]), np.int64), np.zeros(len(ids))
            np.add.at(sums, row, x)
            np.maximum.at(radius, row, b.column(2).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.bincount(row)), pa.array(list(sums), pa.list_(pa.int64())), pa.array(radius)], ["cluster", "n", "sums", "radius"])

    parts = state.select("v", "cluster", "upper").mapInArrow(batches, "cluster int, n long, sums array<long>, radius double")
    spread = parts.select("cluster", "n", "radius", F.posexplode("sums").alias("i", "s"))
    sums = spread.groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("s").alias("s"))
    return sums.groupBy("cluster").agg(F.first("n").alias("n"), F.first("radius").alias("radius"), F.array_sort(F.collect_list(F.struct("i", "s")))["s"].alias("sums")).collect()


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """Vectors (vec_id, v, cluster, distance: squared, to the cluster's centroid) and the centroids.

    ``vectors``: vec_id, embedding; kept as ``integer_vectors`` does. Each round assigns every vector to the
    nearest centroid (ties: the smaller number) and moves non-empty centroids to the componentwise floor of
    their vectors' mean; after the last round vectors are assigned once more. Repeated rows each count; rows
    without vec_id are clustered too. Fewer vectors than ``k`` make fewer centroids, no vectors none.
    Only ``k`` rows of sums ever reach the driver.
    """
    unassigned = [F.lit(-1).cast("int").alias("cluster"), F.lit(float("inf")).alias("upper"), F.lit(float("-inf")).alias("lower")]
    state = written(integer_vectors(vectors, dims, scale).select("vec_id", "v", *unassigned), "vectors")
    centroids = seeds(state, k)
    if not len(centroids):
        return state.where("false").select("vec_id", "v", "cluster", F.lit(0).cast("long").alias("distance")), centroids
    drift = loose = np.zeros(len(centroids))
    for r in range(rounds + 1):
        before, state = state, written(assigned(state, centroids, drift, loose), "clusters")
        forget(before)
        if r == rounds:
            break
        old, radius, centroids = centroids, np.zeros(len(centroids)), centroids.copy()
        for row in cluster_sums(state):
            centroids[row.cluster] = [s // row.n for s in row.sums]
            radius[row.cluster] = row.radius
        drift = np.sqrt(((centroids - old) ** 2).sum(1).astype(np.float64))
        loose = loosening(old, centroids, radius)

    final = centroids

    def distances(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x, mine = matrix(b.column(1)).astype(np.int64), b.column(2).to_numpy()
            d = ((x - final[mine]) ** 2).sum(1) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(d)], ["vec_id", "v", "cluster", "distance"])

    return state.select("vec_id", "v", "cluster").mapInArrow(distances, "vec_id long, v array<int>, cluster int, distance long"), centroids


def with_inertia(found: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256. Only one row a cluster is gathered."""
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    digest = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    rows = [(i, s, sum(sums.values()), digest(centroids[i].tolist())) for i, s in sums.items()]
    told = found.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
