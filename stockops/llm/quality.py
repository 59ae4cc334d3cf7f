"""Document quality by co-training of a text view and a metadata view.

Each view has a logistic classifier. From labelled rows both start; in every round each view scores
all unlabelled documents and hands its most confident ones, with the labels it believes in, to the other
view's training set. In the end each view is calibrated (Platt scaling) on labelled rows kept back for
that, and the calibrated log-odds are combined to score every document.

The text is read once: both views of every row are kept as a table, and every step of a fit is one
pass over it that adds up gradients and Hessians.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ship, written

ship(__name__)

TOKEN = re.compile(r"\S+")
N_META_HASH = 16


def content_view(text: str) -> list[float]:
    """What the text itself says: signs, repetition, word shapes. Reads the whole text."""
    n = len(text)
    words = text.split()
    m = len(words)
    if not m:
        return [0.0] * 13
    counts = Counter(words)
    letters = sum(map(str.isalpha, text)) if not text.isascii() else len(re.findall("[A-Za-z]", text))
    spaces = text.count(" ") + text.count("\n") + text.count("\t")
    digits = len(re.findall("[0-9]", text))
    lines = text.split("\n")
    marks = sum(text.count(c) for c in ".,;:!?'\"-")
    odd = sum(text.count(c) for c in "#$%&*|<>{}[]\\/^~=+_@")
    return [
        letters / n,
        digits / n,
        spaces / n,
        marks / n,
        min(1.0, 5 * odd / n),
        sum(map(len, words)) / m / 10,
        len(counts) / m,
        counts.most_common(1)[0][1] / m,
        1 - len(set(lines)) / len(lines),
        sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:!?\"')") / m,
        sum(1 for w in words if w[:1].isupper()) / m,
        min(3.0, m / len(lines) / 30),
        1.0 if words[-1][-1] in ".!?\"')" else 0.0,
    ]


def metadata_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """What is known about the page without its text: language, source and declared size."""
    out = [0.0] * (2 * N_META_HASH)
    out[zlib.crc32((lang or "").encode()) % N_META_HASH] = 1.0
    out[N_META_HASH + zlib.crc32((source or "").encode()) % N_META_HASH] = 1.0
    x = math.log1p(max(0, n_chars or 0)) / 10
    return [*out, x, x * x, 1.0 if n_chars is None else 0.0, 1.0 if n_chars is not None and n_chars < 200 else 0.0]


@dataclass
class Model:
    """Coefficients of both views, their Platt scalings (a, b) and the weights of the calibrated views."""

    views: tuple[np.ndarray, np.ndarray]
    platt: tuple[np.ndarray, np.ndarray]
    combine: np.ndarray

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        z = calibrated(self.views, self.platt, a, b)
        return 1 / (1 + np.exp(-np.clip(self.combine[0] + z @ self.combine[1:], -30, 30)))


def log_odds(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(w[0] + x @ w[1:], -30, 30)


def calibrated(views: Sequence[np.ndarray], platt: Sequence[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.column_stack([c[0] + c[1] * log_odds(w, x) for w, c, x in zip(views, platt, (a, b), strict=True)])


@dataclass
class Round:
    """What one round has decided: both models and, for each, the log-odds below and above which it is sure."""

    views: tuple[np.ndarray, np.ndarray]
    sure: tuple[tuple[float, float], tuple[float, float]]


def told(rounds: Sequence[Round], a: np.ndarray, b: np.ndarray, free: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Labels that rows were told, for each view by the other one (-1: none), and rows that are still free.

    They follow from the rounds so far, so no state of the pool is ever kept."""
    labels = [np.full(len(a), -1.0), np.full(len(a), -1.0)]
    free = free.copy()
    for r in rounds:
        picked = np.zeros(len(a), bool)
        for k, x in enumerate((a, b)):
            z = log_odds(r.views[k], x)
            low, high = free & (z <= r.sure[k][0]), free & (z >= r.sure[k][1])
            labels[1 - k][low], labels[1 - k][high] = 0.0, 1.0
            picked |= low | high
        free &= ~picked
    return labels, free


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """y (-1: not labelled, -2: held out), fold, and both views of a batch."""
    n = batch.num_rows
    flat = lambda c: batch.column(c).flatten().to_numpy().reshape(n, -1)
    return batch.column("y").to_numpy(), batch.column("fold").to_numpy(), flat("a"), flat("b")


def fitted(rows: DataFrame, designs: Callable, starts: Sequence[np.ndarray], ridge: float, steps: int) -> list[np.ndarray]:
    """Several ridge logistic regressions by Newton's method, each step one pass over ``rows``.

    ``designs(y, fold, a, b)`` gives (features, targets) for each regression. Tasks add up gradients and
    Hessians, Spark adds up those of all tasks, and only the sums reach the driver.
    """
    ws = [np.array(w, float) for w in starts]
    sizes = [len(w) for w in ws]
    for _ in range(steps):

        def add(it, ws=ws):
            sums = [np.zeros(n + n * n) for n in sizes]
            for batch in it:
                if batch.num_rows:
                    for total, w, (x, y) in zip(sums, ws, designs(*arrays(batch)), strict=True):
                        x = np.column_stack([np.ones(len(x)), x])
                        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                        total += np.concatenate([x.T @ (y - p), ((x * (p * (1 - p))[:, None]).T @ x).ravel()])
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(sums)], pa.list_(pa.float64()))], ["sums"])

        added = rows.mapInArrow(add, "sums array<double>").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x"))
        found = np.zeros(sum(n + n * n for n in sizes))
        for at, x in added.collect():
            found[at] = x
        ahead, moved, at = [], 0.0, 0
        for w, n in zip(ws, sizes, strict=True):
            penalty = np.full(n, ridge)
            penalty[0] = 1e-4
            g, h = found[at : at + n] - penalty * w, found[at + n : at + n + n * n].reshape(n, n) + np.diag(penalty + 1e-6)
            step = np.linalg.solve(h, g)
            ahead.append(w + step)
            moved, at = max(moved, float(np.abs(step).max())), at + n + n * n
        ws = ahead
        if moved < 1e-6:
            break
    return ws


def views(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000) -> DataFrame:
    """Both views of every row, read once and kept as a table: doc_id, y, fold, a, b.

    ``y``: the label of at most ``max_labelled`` rows, chosen by id hash; -1 without one, -2 for rows whose
    labels are held out. Null texts count as empty; metadata that is missing counts as unknown.
    """
    named = labels.where("quality in (0, 1) and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    have = docs.select(*[(F.col(c) if c in docs.columns else F.lit(None)).cast(t).alias(c) for c, t in (("doc_id", "long"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "long"))])
    y = F.when(held_out(F.col("doc_id")), -2.0).otherwise(F.coalesce("y", F.lit(-1.0)))
    rows = have.join(F.broadcast(chosen), "doc_id", "left").select("doc_id", y.alias("y"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).cast("int").alias("fold"), "text", "lang", "source", "n_chars")

    def measure(it):
        for batch in it:
            content = [content_view(t.as_py() or "") for t in batch.column(3)]
            metadata = [metadata_view(*x) for x in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6)), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(content, pa.list_(pa.float64())), pa.array(metadata, pa.list_(pa.float64()))], ["doc_id", "y", "fold", "a", "b"])

    return written(rows.mapInArrow(measure, "doc_id long, y double, fold int, a array<double>, b array<double>"), "views")


def learn(rows: DataFrame, rounds: int = 4, share: float = 0.05, sure: float = 1.5, steps: int = 12) -> Model | None:
    """Co-train on the rows of ``views``: all rows that are neither labelled nor held out are the pool.

    In every round each view hands its most confident ``share`` of the free pool to the other one, if its
    log-odds are at least ``sure`` away from those of the labels, so that a view that knows nothing tells
    nothing. A fifth of the labelled rows calibrates. Only sums and quantiles reach the driver. None
    without labels of both kinds.
    """
    counts = {(r.back, int(r.y)): r["count"] for r in rows.where("y >= 0").groupBy((F.col("fold") == 4).alias("back"), "y").count().collect()}
    n = lambda y, back=(False, True): sum(counts.get((b, y), 0) for b in back)
    if not n(0) or not n(1) or n(0) + n(1) < 8:
        return None
    apart = all(counts.get((b, y)) for b in (False, True) for y in (0, 1))  # else all labelled rows fit and calibrate
    positive = n(1) / (n(0) + n(1))
    width = rows.select(F.size("a"), F.size("b")).head()
    ws, done = [np.zeros(width[0] + 1), np.zeros(width[1] + 1)], []

    def designs(done):
        def of(y, fold, a, b):
            own = (y >= 0) & ((fold < 4) | (not apart))
            labels, _ = told(done, a, b, y == -1)
            out = []
            for k, x in enumerate((a, b)):
                use = own | (labels[k] >= 0)
                out.append((x[use], np.where(own, y, labels[k])[use]))
            return out

        return of

    ws = fitted(rows, designs([]), ws, 0.1, steps)
    for _ in range(rounds):

        def free_odds(it, ws=tuple(ws), done=tuple(done)):
            for batch in it:
                if batch.num_rows:
                    y, _, a, b = arrays(batch)
                    _, free = told(done, a, b, y == -1)
                    yield pa.RecordBatch.from_arrays([pa.array(log_odds(ws[0], a[free])), pa.array(log_odds(ws[1], b[free]))], ["a", "b"])

        odds = rows.mapInArrow(free_odds, "a double, b double")
        limits = odds.approxQuantile(["a", "b"], [share * (1 - positive), 1 - share * positive], 0.001)
        if not all(limits):
            break
        prior = math.log(positive / (1 - positive))
        done.append(Round(tuple(ws), tuple((min(low, prior - sure), max(high, prior + sure)) for low, high in limits)))
        ws = fitted(rows, designs(list(done)), ws, 0.1, 3)

    def back(y, fold):
        return (y >= 0) & ((fold == 4) | (not apart))

    both = tuple(ws)
    platt = fitted(rows, lambda y, fold, a, b: [(log_odds(w, x)[back(y, fold), None], y[back(y, fold)]) for w, x in zip(both, (a, b), strict=True)], [np.zeros(2), np.zeros(2)], 1e-2, steps)
    scales = tuple(platt)
    (combine,) = fitted(rows, lambda y, fold, a, b: [(calibrated(both, scales, a, b)[back(y, fold)], y[back(y, fold)])], [np.zeros(3)], 1e-1, steps)
    return Model(both, scales, combine)


def score(rows: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """One row for each row of ``views``: doc_id, held_out, score (1: good), predicted, kept.

    Without a model (no labels of both kinds) every score is 0.5. Repeated rows each get a row; an empty
    table gives an empty table.
    """

    def batches(it):
        for batch in it:
            if batch.num_rows:
                _, _, a, b = arrays(batch)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(a), 0.5) if model is None else model.scores(a, b))], ["doc_id", "score"])

    out = rows.mapInArrow(batches, "doc_id long, score double")
    good = F.col("score") >= threshold
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(good, 1).otherwise(0).alias("predicted"), good.alias("kept"))
