"""NN-descent near-duplicates against all pairs."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from stockops.llm import neighbours as nb

import helpers as h

VEC = "vec_id long, embedding array<double>"


def all_links(rows, threshold):
    """n_links and component by all pairs; vectors that cannot link have none."""
    good = [e is not None and len(e) > 0 and all(x is not None and math.isfinite(x) for x in e) and any(e) for _, e in rows]
    unit = [np.array(e) / np.abs(e).max() if g else None for (_, e), g in zip(rows, good, strict=True)]
    unit = [u / math.sqrt(u @ u) if u is not None else None for u in unit]
    linked = lambda i, j: good[i] and good[j] and len(unit[i]) == len(unit[j]) and (rows[i][1] == rows[j][1] or float(unit[i] @ unit[j]) >= threshold)
    n = [sum(linked(i, j) for j in range(len(rows)) if j != i) for i in range(len(rows))]
    root = h.components(len(rows), linked)
    smallest = {}
    for i, r in enumerate(root):
        if rows[i][0] is not None:
            smallest[r] = min(smallest.get(r, rows[i][0]), rows[i][0])
    return [(i, n[k], smallest.get(root[k])) for k, (i, _) in enumerate(rows)]


def found(spark, rows, **options):
    d = spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e]) for i, e in rows], VEC).withColumns({c: F.lit("x") for c in ("node", "n", "unit", "x", "h1", "src", "kept", "least")})
    got = nb.near_duplicates(d, **options).collect()
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)
    return [(r.vec_id, r.n_links, r.component_id) for r in got]


def by_id(rows):
    return sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]))


def group(rng, middle, n, noise):
    return [(middle + noise * rng.standard_normal(len(middle)) / math.sqrt(len(middle))).tolist() for _ in range(n)]


def test_links_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    vectors = [rng.standard_normal(24).tolist() for _ in range(150)]
    for size, noise in ((2, 0.5), (3, 0.45), (2, 0.65), (12, 0.4), (40, 0.5)):
        middle = rng.standard_normal(24)
        vectors += group(rng, middle / np.linalg.norm(middle), size, noise)
    chain = np.eye(24)[:2]
    vectors += [(math.cos(0.3 * k) * chain[0] + math.sin(0.3 * k) * chain[1]).tolist() for k in range(9)]  # neighbours link, others do not
    vectors += [[0.5] * 24] * 30 + [[1.0] * 24, [-1.0] * 24]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(vectors)), vectors, strict=True)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] * 24), (904, [None] + [1.0] * 23), (905, [float("inf")] * 24), (906, [1e300] * 24), (907, [1e-300] * 24), (908, [0.5] * 3), (909, [0.5] * 3), (None, [0.5] * 3), (None, None), (5, [0.25] * 3), (5, [-0.25] * 3)]
    assert by_id(found(spark, rows, bucket=32, most=16, least=6, probes=200, recall=1.0)) == by_id(all_links(rows, 0.9))
    assert found(spark, []) == [] and found(spark, [(1, None), (None, [0.0])]) == [(1, 0, 1), (None, 0, None)]


def test_crowds_are_counted_exactly(spark):
    """Sub-crowds that are closer than a list is long still belong together."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v)
    top = unit(rng.standard_normal(16))
    vectors = [v for k in range(6) for v in group(rng, unit(top + 0.3 * unit(rng.standard_normal(16))), 60, 0.02 + 0.1 * (k % 3))]
    vectors += group(rng, top, 40, 0.7) + group(rng, unit(rng.standard_normal(16)), 200, 0.05)
    rows = [(k, v) for k, v in enumerate(vectors)]
    want = by_id(all_links(rows, 0.9))
    assert by_id(found(spark, rows, bucket=64, most=12, least=4, block=16)) == want


def test_counts_within_a_crowd(spark):
    rng = np.random.default_rng(3)
    for spread in (0.1, 0.4, 1.0, 3.0):
        x = rng.standard_normal(8) + spread * rng.standard_normal((300, 8))
        x /= np.linalg.norm(x, axis=1)[:, None]
        n, crowd = rng.integers(1, 5, 300), rng.integers(0, 2, 300)
        rows = [(int(crowd[i]), 8, i, int(n[i]), x[i].tobytes()) for i in range(300)]
        df = spark.createDataFrame(rows, "crowd long, dims int, node long, n long, unit binary")
        near = (x @ x.T >= 0.9) & (crowd[:, None] == crowd)
        np.fill_diagonal(near, False)
        for block, hot in ((7, 50), (64, 1 << 20)):
            got = {r.node: r.weight for r in nb.counted(df, 0.9, block, hot).collect()}
            assert [got.get(i, 0) for i in range(300)] == (near @ n).tolist()


def test_recall_among_many_vectors(spark):
    """Pairs just above the threshold among thousands of others: nine in ten at least, and none below it."""
    rng = np.random.default_rng(4)
    vectors = [rng.standard_normal(32) for _ in range(4_000)]
    for v in vectors[:300]:
        w = rng.standard_normal(32)
        w -= (w @ v) / (v @ v) * v
        c = rng.uniform(0.88, 0.97)
        vectors.append(c * v / np.linalg.norm(v) + math.sqrt(1 - c * c) * w / np.linalg.norm(w))
    x = np.array([v / np.linalg.norm(v) for v in vectors])
    near = x @ x.T >= 0.9
    np.fill_diagonal(near, False)
    got = {i: n for i, n, _ in found(spark, [(i, v.tolist()) for i, v in enumerate(vectors)])}
    want = near.sum(1)
    assert all(got[i] <= want[i] for i in got) and sum(got.values()) >= 0.95 * want.sum() > 300
