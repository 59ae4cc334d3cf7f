"""Dominated and nearly dominated options of large groups, by skylines of splits.

What dominates an option is itself dominated by nothing, or by something that dominates the option too: so
options need to meet the skyline only. The score is one more attribute of it, so that near-dominance,
which asks for a higher score, can be judged by it as well. Splits of a group find their own skylines, which are
merged in rounds; no task ever holds more than a few splits.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.durable import forget, written
from ..functions.python import ship

ship(__name__)


def undominated(points: np.ndarray, chunk: int = 256) -> np.ndarray:
    """Rows (a mask) that no other row equals or beats everywhere and beats somewhere; of equal rows all stay.

    Points come in order of their sum, so none is dominated by a later one.
    """
    order = np.argsort(-points.sum(1), kind="stable")
    keep = np.zeros(len(points), bool)
    front = np.empty((0, points.shape[1]))
    for at in range(0, len(order), chunk):
        rows = order[at : at + chunk]
        rows = rows[~beaten(points[rows], front)]
        rows = rows[~beaten(points[rows], points[rows])]
        keep[rows] = True
        front = np.concatenate([front, points[rows]])
    return keep


def beaten(x: np.ndarray, front: np.ndarray) -> np.ndarray:
    """Rows of x that some row of front dominates."""
    out = np.zeros(len(x), bool)
    for at in range(0, len(front), 4096):
        part = front[at : at + 4096]
        no_worse, better = np.ones((len(x), len(part)), bool), np.zeros((len(x), len(part)), bool)
        for c in range(x.shape[1]):
            no_worse &= part[:, c] >= x[:, c, None]
            better |= part[:, c] > x[:, c, None]
        out |= (no_worse & better).any(1)
    return out


def marks(x: np.ndarray, score: np.ndarray, front: np.ndarray, front_score: np.ndarray, near: float, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(dominated, nearly dominated) of rows by the rows of a front."""
    dominated, close = np.zeros(len(x), bool), np.zeros(len(x), bool)
    for at in range(0, len(x), chunk):
        part = slice(at, at + chunk)
        dominated[part] = beaten(x[part], front)
        alike = np.ones((len(x[part]), len(front)), bool)
        for c in range(x.shape[1]):
            alike &= front[:, c] >= x[part, c, None] - near
        close[part] = (alike & (front_score > score[part, None])).any(1)
    return dominated, close


def matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.array(pdf["x"].tolist(), np.float64).reshape(len(pdf), -1)


def mark_large(rows: DataFrame, near: float, split: int = 4096, fan_in: int = 8) -> DataFrame:
    """(g, id, n, x, score): group, row, size of the group, attributes, score -> (id, dominated, near_dominated).

    Splits hold some ``split`` rows. Rounds of merging ``fan_in`` splits end when a group has one, or when merging
    leaves most of them: a front of several splits only means more comparisons. Attributes that are null
    neither dominate nor are dominated.
    """
    rows = rows.withColumn("parts", F.ceil(F.col("n") / split).cast("int")).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    front = written(rows.where("score is not null and forall(x, v -> v is not null)").select("g", "parts", "part", "x", "score"), "front")

    def local(pdf: pd.DataFrame) -> pd.DataFrame:
        points = np.column_stack([matrix(pdf), pdf["score"]])
        rows = np.flatnonzero(undominated(points))
        return pdf.iloc[rows[np.unique(points[rows], axis=0, return_index=True)[1]]]  # equal ones are one

    before = None
    while True:
        after = written(front.groupBy("g", "part").applyInPandas(local, front.schema), "front")
        forget(front)
        size, most = after.agg(F.count(F.lit(1)), F.max("parts")).head()
        front = after
        if (most or 1) == 1 or (before is not None and size > 0.9 * before):
            break
        before = size
        front = front.withColumn("parts", F.ceil(F.col("parts") / fan_in).cast("int")).withColumn("part", F.pmod("part", "parts"))
    front = written(front.groupBy("g", "part").agg(F.collect_list("x").alias("front"), F.collect_list("score").alias("front_score")), "fronts")  # a split each

    # every split of rows meets every split of the front of its group
    dealt = rows.select("g", F.col("part").alias("mine"), "id", F.col("x"), "score")
    asked = dealt.join(front.select("g", "part"), "g")
    held = front.select(F.col("g").alias("g2"), F.col("part").alias("part2"), "front", "front_score").join(dealt.select(F.col("g").alias("g2"), F.col("mine").alias("mine2")).distinct(), "g2")
    met = asked.groupBy("g", "mine", "part").cogroup(held.groupBy("g2", "mine2", "part2"))

    def compare(own: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(own) or not len(held):
            return pd.DataFrame({"id": own["id"], "dominated": False, "near_dominated": False})
        f, fs = np.array(held["front"].iloc[0].tolist(), np.float64), np.asarray(held["front_score"].iloc[0], np.float64)
        x = np.array([[np.nan if v is None else v for v in r] for r in own["x"]], np.float64)
        dominated, close = marks(x, own["score"].to_numpy(np.float64), f, fs, near)
        return pd.DataFrame({"id": own["id"], "dominated": dominated, "near_dominated": close})

    found = met.applyInPandas(compare, "id long, dominated boolean, near_dominated boolean")
    return found.groupBy("id").agg(F.max("dominated").alias("dominated"), F.max("near_dominated").alias("near_dominated"))
