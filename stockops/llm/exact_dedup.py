"""Exact duplicates: tree-merge of sorted digest runs in binomial rounds.

The rows of one task form a run: their digests, sorted, with equal ones folded to one entry (digest,
length, second hash, extreme id, count). In round ``k`` groups of ``fan_in`` runs exchange entries:
digit ``k`` of the run number is replaced by digit ``k`` of the digest, so each of them receives one
share of the digest space from all of them. A run is one partition; Spark's sort merges the sorted
pieces that arrive, spilling if it must, and one pass folds neighbours that are verified to be equal.
After the last round a digest lives in one run only. A text held by a third of all rows is one entry
of each run at the start, and ``fan_in`` of them meet in a round; no task ever meets all its rows.

An entry is verified before it folds: digest, byte length and a second, independent hash must agree.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ship, shuffle_width, written

ship(__name__)

KEY = ["digest", "n_bytes", "check"]
ENTRY = "run int, digest binary, n_bytes int, check long, best long, at int, ids long, n long"


def fold(largest: bool):
    """Folds neighbours of equal run and key in sorted batches. ``at``: the first run that holds the best
    id; ``ids``: rows that have an id."""
    pick = np.maximum if largest else np.minimum

    def folded(it):
        held = None
        for batch in it:
            if not batch.num_rows:
                continue
            t = batch if held is None else pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in zip(held.columns, batch.columns, strict=True)], batch.schema.names)
            digests = np.frombuffer(b"".join(t.column(1).to_pylist()), "S32")
            new = np.ones(t.num_rows, bool)
            new[1:] = digests[1:] != digests[:-1]
            for k in (0, 2, 3):
                x = t.column(k).to_numpy()
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            best, at, ids, n = (t.column(k).to_numpy() for k in (4, 5, 6, 7))
            top = pick.reduceat(best, first)
            at = np.minimum.reduceat(np.where(best == top[np.cumsum(new) - 1], at, np.iinfo(np.int32).max).astype(np.int32), first)
            columns = [c.take(pa.array(first)) for c in t.columns[:4]] + [pa.array(x) for x in (top, at, np.add.reduceat(ids, first), np.add.reduceat(n, first))]
            done = pa.RecordBatch.from_arrays(columns, t.schema.names)
            yield done.slice(0, len(first) - 1)
            held = done.slice(len(first) - 1)
        if held is not None:
            yield held

    return folded


def merge_runs(entries: DataFrame, rounds: int, fan_in: int, largest: bool) -> DataFrame:
    """Sorted, folded runs -> the same after all rounds: each key in one run."""
    runs = fan_in**rounds
    share = F.pmod(F.xxhash64("digest"), F.lit(runs).cast("long"))
    for k in range(rounds):
        unit = fan_in**k
        digit = lambda x, unit=unit: F.floor(x / unit) % fan_in
        slot = (F.col("run") + (digit(share) - digit(F.col("run"))) * unit).cast("int")
        entries = entries.withColumn("run", slot).repartition(runs, "run").sortWithinPartitions("run", *KEY).mapInArrow(fold(largest), ENTRY)
    return entries


def exact_duplicates(docs: DataFrame, text: Column | None = None, keep: str = "smallest", fan_in: int = 8, rows_per_run: int = 500_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``text``: what is compared (default: the text as it is); null counts as empty. ``keep``: whether
    the smallest or the largest doc_id of a group stays. Of rows that repeat the kept doc_id exactly
    one is kept. In a group without any doc_id keep_id is null and one row is kept. There are as many
    rounds as runs of some ``rows_per_run`` rows need. Empty tables give empty tables; other columns are
    ignored.
    """
    largest = keep == "largest"
    body = F.coalesce(F.col("text").cast("string") if text is None else text, F.lit(""))
    # rows keep the number of the task that read them: their run, with or without an id
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), F.octet_length(body).alias("n_bytes"), F.xxhash64(body).alias("check"), F.spark_partition_id().alias("task")
    )
    rows = written(rows, "digests")
    needed = max(shuffle_width(docs.sparkSession), -(-rows.count() // rows_per_run))
    rounds = max(1, math.ceil(math.log(needed, fan_in) - 1e-9))
    rows = rows.withColumn("run", F.pmod("task", F.lit(fan_in**rounds)).cast("int")).drop("task")

    # a row without an id never wins
    nothing = F.lit(-(2**63) if largest else 2**63 - 1)
    single = rows.select("run", *KEY, F.coalesce("doc_id", nothing).alias("best"), F.col("run").alias("at"), F.col("doc_id").isNotNull().cast("long").alias("ids"), F.lit(1).cast("long").alias("n"))
    entries = single.sortWithinPartitions("run", *KEY).mapInArrow(fold(largest), ENTRY)
    merged = merge_runs(entries, rounds, fan_in, largest)
    merged = merged.select(*KEY, F.when(F.col("ids") > 0, F.col("best")).alias("keep_id"), "at", F.col("n").alias("group_size"))
    # rows meet the answer by run and key, so rows of one text are dealt out as the runs are
    answers = entries.select("run", *KEY).distinct().join(merged, KEY)
    same = Window.partitionBy("run", *KEY, "doc_id").orderBy("doc_id")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("run") == F.col("at")) & (F.row_number().over(same) == 1)
    return rows.join(answers, ["run", *KEY]).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
