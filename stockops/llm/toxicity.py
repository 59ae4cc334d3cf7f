"""Toxicity: a weighted lexicon matched by Aho-Corasick over folded text.

Folding undoes disguises: compatibility forms, invisible characters, homoglyphs, digits and symbols
that stand for letters, and stretched letters. The lexicon (whole words and word beginnings with
log-odds weights) and the exception phrases (a lexicon word next to a word with which it is mostly
harmless) are learnt from labelled documents. A document is described by its hits, normalised by its
length, and a logistic curve turns that into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ship, written

ship(__name__)

#: Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
#: Digits and symbols written for letters. l and i share a class because 1 stands for both.
STAND_INS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "l": "i"}
SYMBOLS = {"@": "a", "$": "s", "!": "i", "|": "i"}
LETTERS = str.maketrans({**HOMOGLYPHS, **STAND_INS})
HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff\u0300-\u036f]")
BETWEEN = re.compile(r"(?<=[^\W_])[@$!|](?=[^\W_])")
STRETCHED = re.compile(r"([^\W\d_])\1{2,}")
TOKEN = re.compile(r"[^\W_]+")


def fold(text: str | None) -> list[str]:
    """Folded words of a whole text."""
    t = (text or "").lower()
    if not t.isascii():
        t = HIDDEN.sub("", unicodedata.normalize("NFKC", t))
    if any(c in t for c in SYMBOLS):
        t = BETWEEN.sub(lambda m: SYMBOLS[m[0]], t)
    return TOKEN.findall(STRETCHED.sub(r"\1", t.translate(LETTERS)))


def entries(word: str, shortest: int = 3, longest: int = 8) -> list[str]:
    """Lexicon entries a word can match: itself between blanks, and its beginnings after a blank."""
    return [f" {word} ", *(f" {word[:k]}" for k in range(shortest, min(longest, len(word)) + 1))]


@dataclass
class Lexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: set[tuple[str, str]] = field(default_factory=set)
    curve: tuple[float, ...] = (-8.0, 0.0, 0.0, 0.0)

    def automaton(self):
        machine = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            machine.add_word(entry, (len(entry), weight))
        if self.weights:
            machine.make_automaton()
        return machine


def hits(words: list[str], machine) -> dict[int, float]:
    """Word number -> greatest weight of an entry that matches there."""
    if not words or not len(machine):
        return {}
    line = " " + " ".join(words) + " "
    found: dict[int, float] = {}
    for end, (size, weight) in machine.iter(line):
        at = end - size + 1
        found[at] = max(weight, found.get(at, 0.0))
    if not found:
        return {}
    # character offset of the blank before each word -> word number
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    begin = np.cumsum(sizes) - sizes
    return {int(np.searchsorted(begin, at)): w for at, w in found.items()}


def describe(words: list[str], machine, exceptions: set[tuple[str, str]]) -> list[float]:
    """Greatest weight, weight a hundred words, and logarithm of the number of hits."""
    found = hits(words, machine)
    if exceptions and found:
        pad = ["", *words, ""]
        found = {i: w for i, w in found.items() if (pad[i], words[i]) not in exceptions and (words[i], pad[i + 2]) not in exceptions}
    if not found:
        return [0.0, 0.0, 0.0]
    return [max(found.values()), min(10.0, sum(found.values()) / math.sqrt(len(words) + 10)), math.log1p(len(found))]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; the first coefficient is the intercept."""
    a = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(a.shape[1])
    penalty = np.full(a.shape[1], ridge)
    penalty[0] = 1e-4
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (p * (1 - p) + 1e-6)[:, None]).T @ a + np.diag(penalty)
        step = np.linalg.solve(h, a.T @ (y - p) - penalty * b)
        b += step
        if np.abs(step).max() < 1e-6:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, min_toxic: int = 3, min_weight: float = 3.0, min_harmless: int = 2) -> Lexicon:
    """Fit lexicon, exceptions and curve on at most ``max_rows`` labelled rows, chosen by id hash.

    The rows are read and folded once and kept as a table. Counts of entries are gathered by Spark; all
    entries above the thresholds reach the driver, as many as that bounded number of rows holds. A lexicon
    word with a neighbour is an exception if at least ``min_harmless`` clean texts hold the pair and the
    pair itself is no more likely in toxic texts than in clean ones. Of rows that repeat a doc_id one text counts. Null texts and null ids are not learnt
    from. Without two classes of labels the lexicon is empty.
    """
    chosen = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")).where("text is not null").join(F.broadcast(chosen), "doc_id")

    def folded(it):
        for batch in it:
            yield pa.RecordBatch.from_arrays([pa.array([" ".join(fold(t.as_py())) for t in batch.column(0)], pa.string()), batch.column(1)], ["words", "toxic"])

    train = written(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(folded, "words string, toxic int"), "training")

    def count(it):
        for batch in it:
            tally: dict[str, list[int]] = {}
            for words, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for e in {e for w in set(words.split(" ")) if w for e in entries(w)}:
                    tally.setdefault(e, [0, 0])[toxic] += 1
            names = list(tally)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([tally[e][1] for e in names], pa.int64()), pa.array([tally[e][0] for e in names], pa.int64())], ["entry", "n_toxic", "n_clean"])

    sizes = dict(train.groupBy("toxic").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return Lexicon()
    weight = F.log((F.col("n_toxic") + 0.1) / (toxic + 0.2)) - F.log((F.col("n_clean") + 0.1) / (clean + 0.2))
    found = (
        train.mapInArrow(count, "entry string, n_toxic long, n_clean long")
        .groupBy("entry")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .where(F.col("n_toxic") >= min_toxic)
        .withColumn("weight", weight)
        .where(F.col("weight") >= min_weight)
    )
    lexicon = Lexicon({r["entry"]: float(r["weight"]) for r in found.collect()})
    if not lexicon.weights:
        return lexicon
    weights = lexicon.weights

    def neighbours(it):
        machine = Lexicon(weights).automaton()
        for batch in it:
            tally: dict[tuple[str, str], list[int]] = {}
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = text.split()
                pad = ["", *words, ""]
                for pair in {p for i in hits(words, machine) for p in ((pad[i], words[i]), (words[i], pad[i + 2])) if all(p)}:
                    tally.setdefault(pair, [0, 0])[label] += 1
            names = list(tally)
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in names], pa.string()), pa.array([b for _, b in names], pa.string()), pa.array([tally[p][1] for p in names], pa.int64()), pa.array([tally[p][0] for p in names], pa.int64())], ["a", "b", "n_toxic", "n_clean"])

    harmless = (
        train.mapInArrow(neighbours, "a string, b string, n_toxic long, n_clean long")
        .groupBy("a", "b")
        .agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n_clean").alias("n_clean"))
        .where(F.col("n_clean") >= min_harmless)
        .where(weight <= 0)
    )
    lexicon.exceptions = {(r["a"], r["b"]) for r in harmless.collect()}
    exceptions = lexicon.exceptions

    def measure(it):
        machine = Lexicon(weights).automaton()
        for batch in it:
            rows = np.array([describe(t.split(), machine, exceptions) for t in batch.column(0).to_pylist()]).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(1).cast(pa.int64()), *(pa.array(rows[:, k]) for k in range(3))], ["toxic", "a", "b", "c"])

    sample = np.array([tuple(r) for r in train.mapInArrow(measure, "toxic long, a double, b double, c double").collect()], float)
    sample = sample[np.lexsort(sample.T)]  # sums of doubles depend on their order
    lexicon.curve = tuple(logistic(sample[:, 1:], sample[:, 0]))
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """One row for each row of ``docs``: doc_id, score (0 to 1), predicted (1 if score >= threshold).

    Null and empty texts have no hits and get the score of a clean text. Repeated rows each get a
    row; an empty table gives an empty table; columns other than doc_id and text are not read.
    """
    weights, exceptions, curve = lexicon.weights, lexicon.exceptions, np.array(lexicon.curve)

    def batches(it):
        machine = Lexicon(weights).automaton()
        for batch in it:
            rows = np.array([describe(fold(t.as_py()), machine, exceptions) for t in batch.column(1)]).reshape(-1, 3)
            z = np.clip(curve[0] + rows @ curve[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-z)))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, score double")
    return scored.select("doc_id", "score", F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"))


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold, in one pass and without a shuffle.

    Rows are judged by their own text; null and empty texts and rows without doc_id are judged alike, and
    stay if clean texts do. Repeated rows share their fate; an empty table stays empty; other columns are
    kept as they are.
    """
    weights, exceptions, curve = lexicon.weights, lexicon.exceptions, np.array(lexicon.curve)

    def batches(it):
        machine = Lexicon(weights).automaton()
        for batch in it:
            rows = np.array([describe(fold(t.as_py()), machine, exceptions) for t in batch.column("text")]).reshape(-1, 3)
            z = np.clip(curve[0] + rows @ curve[1:], -30, 30)
            yield batch.filter(pa.array(1 / (1 + np.exp(-z)) < threshold))

    return docs.mapInArrow(batches, docs.schema)
