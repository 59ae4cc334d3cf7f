"""Frontiers of large groups against comparison of all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd

from stockops.operators import decisions, skyline

SCHEMA = "k string, action_id long, score double, a double, b double, c double"


def test_large_groups_equal_all_pairs(spark):
    rng = np.random.default_rng(1)
    rows = []
    for k, n in (("large", 700), ("small", 40), (None, 400)):
        x = np.round(rng.random((n, 3)), 2)
        rows += [(k, i, float(np.round(x[i] @ [0.5, 0.3, 0.2] + rng.normal(0, 0.02), 3)), *map(float, x[i])) for i in range(n)]
    rows += [("large", 9000, 0.5, None, 0.9, 0.9), ("large", 9001, None, 0.9, 0.9, 0.9)]
    df = spark.createDataFrame(rows, SCHEMA)
    whole = sorted(map(str, decisions.pareto_frontier(df, ["k"], ["a", "b", "c"]).collect()))
    parts = decisions.pareto_frontier(df, ["k"], ["a", "b", "c"], block=100, split=64)
    assert sorted(map(str, parts.collect())) == whole and "dominated=True, near_dominated=False" in "".join(whole)


def test_frontier_of_a_hundred_thousand_options(spark):
    n = 100_000
    rng = np.random.default_rng(2)
    x = rng.random((n, 3))
    score = x @ [0.5, 0.3, 0.2]
    df = spark.createDataFrame(pd.DataFrame({"k": "one", "action_id": np.arange(n), "score": score, "a": x[:, 0], "b": x[:, 1], "c": x[:, 2]}))
    got = decisions.pareto_frontier(df, ["k"], ["a", "b", "c"]).select("action_id", "dominated", "near_dominated", "reduction").toPandas().sort_values("action_id")
    front = np.flatnonzero(~got.dominated.to_numpy())
    assert len(got) == n and abs(got.reduction.iloc[0] - got.dominated.mean()) < 1e-12 and not skyline.beaten(x[front], x).any()
    for i in rng.choice(n, 300, replace=False):
        assert got.dominated.iloc[i] == ((x >= x[i]).all(1) & (x > x[i]).any(1)).any() and got.near_dominated.iloc[i] == ((x >= x[i] - 0.05).all(1) & (score > score[i])).any()
