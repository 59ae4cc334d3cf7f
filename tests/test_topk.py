"""Vector search in cells against plain sorting."""

from __future__ import annotations

import numpy as np

from stockops.operators.retrieval import vector_topk


def test_cells_equal_plain_sorting(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(300, 5)), 1)  # rounded: many ties
    x[7] = 0
    rows = [(i, x[i].tolist()) for i in range(300)] + [(900, None), (901, [1.0] * 3), (None, [1.0] * 5)]
    asks = [(i, x[i].tolist()) for i in range(0, 300, 7)] + [(500, [1.0, 0.0, 0.0]), (501, None)]
    v, q = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), spark.createDataFrame(asks, "query_id long, embedding array<double>")
    norm = np.linalg.norm(x, axis=1)
    unit = np.divide(x, norm[:, None], out=np.zeros_like(x), where=norm[:, None] > 0)
    want = {}
    for i in range(0, 300, 7):
        sims = np.round(unit @ unit[i], 9)
        want[i] = sorted(((-s, j) for j, s in enumerate(sims)))[:6]
    for options in ({}, {"query_rows": 10, "vector_rows": 40, "chunk": 7}, {"chunk": 3}):
        got = {}
        for r in vector_topk(v, q, 6, **options).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.similarity, r.vec_id)
        assert set(got) == {*want, 500} and got[500] == {1: (np.round(1 / np.sqrt(3), 9), 901)}
        for i, best in want.items():
            assert [got[i][r][1] for r in range(1, 7)] == [j for _, j in best] and all(abs(got[i][r][0] + s) < 2e-9 for r, (s, _) in enumerate(best, 1))
    assert vector_topk(v.where("false"), q, 3).isEmpty() and vector_topk(v, q.where("false"), 3).isEmpty()
    assert vector_topk(v, q, 1_000).where("query_id = 0").count() == 300
