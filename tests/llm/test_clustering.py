"""Centroid clustering against plain integer arithmetic."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from stockops.llm import clustering as cl


def plain(rows, k, rounds, dims, scale=256):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == dims and all(x is not None and math.isfinite(x) and abs(math.floor(x * scale)) < cl.GREATEST for x in e):
            kept.append((i, [math.floor(scale * x) for x in e]))
    order = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((dist(v, c), j) for j, c in enumerate(centroids))
    if not centroids:
        return [], centroids
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, g in groups.items():
            centroids[j] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    return sorted(((i if i is not None else -1, nearest(v)[1], nearest(v)[0]) for i, v in kept)), centroids


def vectors(rng, n, dims, spread=1.0):
    middles = [[rng.gauss(0, spread) for _ in range(dims)] for _ in range(6)]
    return [(i, [m + rng.gauss(0, 0.2) for m in rng.choice(middles)]) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("x") for c in ("cluster", "v", "upper", "lower", "distance", "x")})


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(4)
    odd = [(900, None), (901, [1.0] * 3), (902, [None, 1.0, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf")] * 4), (905, [0.0] * 4), (906, [-0.001] * 4), (907, [1e300] * 4), (908, [40_000.5, -40_000.25, 0.1, 0.0]), (None, [0.5] * 4), (None, [0.5] * 4)]
    rows = vectors(rng, 150, 4) + odd + [(910 + i, [1.0, -1.0, 0.5, 0.25]) for i in range(60)] + [(3, [0.5, 0.5, 0.5, 0.5]), (3, [0.25] * 4)]
    for k, rounds in ((7, 5), (1, 2), (40, 3)):
        got, centroids = cl.cluster(frame(spark, rows), k, rounds, dims=4)
        want, means = plain(rows, k, rounds, 4)
        assert sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in got.collect()) == want and centroids.tolist() == means
        told = cl.with_inertia(got, centroids).collect()
        assert len(told) == len(want) and {r.inertia for r in told} == {sum(d for _, _, d in want)}
        for r in told:
            assert r.cluster_inertia == sum(d for _, c, d in want if c == r.cluster) and r.centroid_sha256 == hashlib.sha256(",".join(map(str, means[r.cluster])).encode()).hexdigest()


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.5, 0.5]), (2, [0.5, 0.5]), (3, [9.0, 9.0])]
    got, centroids = cl.cluster(frame(spark, rows), 40, 5, dims=2)
    want, means = plain(rows, 40, 5, 2)
    assert sorted((r.vec_id, r.cluster, r.distance) for r in got.collect()) == want and centroids.tolist() == means
    for rows in ([], [(1, None)], [(None, [1.0, 1.0])]):
        got, centroids = cl.cluster(frame(spark, rows), 40, 5, dims=2)
        assert cl.with_inertia(got, centroids).isEmpty()


def test_loosening_is_safe_and_less_than_drift():
    rng = np.random.default_rng(5)
    saved = 0.0
    for _ in range(60):
        k, dims = rng.integers(2, 8), rng.integers(2, 6)
        old = rng.integers(-300, 300, (k, dims))
        new = old + (rng.integers(-40, 40, (k, dims)) if rng.random() < 0.9 else 0)
        x = rng.integers(-400, 400, (400, dims))
        d = np.sqrt(cl.squared_distances(x, old))
        mine = d.argmin(1)
        radius = np.array([d[mine == i, i].max(initial=0) for i in range(k)])
        loose = cl.loosening(old, new, radius)
        after = np.sqrt(cl.squared_distances(x, new))
        for i in range(k):
            other = np.arange(k) != i
            lower = d[mine == i][:, other].min(1, initial=np.inf) - loose[i]
            assert (after[mine == i][:, other].min(1, initial=np.inf) >= lower - 1e-6).all()
        drift = np.sqrt(((new - old) ** 2).sum(1)).max()
        assert (loose <= drift + 1e-9).all()
        saved += float((drift - loose).mean())
    assert saved > 60


def test_bounds_skip_rows_of_settled_clusters():
    rng = random.Random(6)
    x = np.array([[math.floor(256 * c) for c in e] for _, e in vectors(rng, 2_000, 8, 4.0)])
    centroids, n = x[[0, 50, 100, 150, 200, 250]], []
    cluster, upper, lower = np.full(len(x), -1, np.int32), np.full(len(x), np.inf), np.full(len(x), -np.inf)
    drift = loose = np.zeros(6)
    for _ in range(6):
        cluster, upper, lower, scanned = cl.assign(x, cluster, upper + drift[cluster], lower - loose[cluster], centroids)
        assert (cluster == cl.squared_distances(x, centroids).argmin(1)).all()
        n.append(scanned)
        old, radius = centroids, np.array([upper[cluster == i].max(initial=0) for i in range(6)])
        centroids = np.array([x[cluster == i].sum(0) // max(1, (cluster == i).sum()) if (cluster == i).any() else centroids[i] for i in range(6)])
        drift, loose = np.sqrt(((centroids - old) ** 2).sum(1)), cl.loosening(old, centroids, radius)
    assert n[0] == len(x) and n[-1] < len(x) / 2, n


def test_large_integers_are_exact():
    x, c = np.array([[cl.GREATEST - 1, -cl.GREATEST + 1]]), np.array([[-cl.GREATEST + 2, cl.GREATEST - 1]])
    assert cl.squared_distances(x, c)[0, 0] == (2 * cl.GREATEST - 3) ** 2 + (2 * cl.GREATEST - 2) ** 2
