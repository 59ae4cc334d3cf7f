"""Verified links within groups of candidate rows, whatever a group holds; exact Jaccard similarity.

A group of more than ``block`` rows is dealt out to blocks, so no task ever holds a whole large group,
and only a spanning forest of the verified links leaves a task, so a group of near copies never emits
all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, durable, ship, unite

ship(__name__)
ship("stockops.llm.common")

#: Words of 64 columns that are held for the rows of one block at a time.
HELD_WORDS = 1 << 21


def similar_forest(ids: np.ndarray, sets: list[np.ndarray], threshold: float) -> list[tuple[int, int]]:
    """Spanning links of rows whose Jaccard similarity reaches the threshold; ``sets`` are distinct values.

    Values of one row only cannot be shared and are left out; the others are columns of a bit matrix
    that is held for a bounded number of columns at a time. Two empty sets are alike.
    """
    n = len(ids)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    row = np.repeat(np.arange(n), sizes)
    use = count[column] > 1
    row, column = row[use], dense[column[use]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 64 * max(1, HELD_WORDS // n)
    both = np.zeros((n, n), np.int32)
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (low, low + width))
        here = column[a:b] - low
        bits = np.zeros((n, int(here[-1]) // 64 + 1), np.uint64)
        np.bitwise_or.at(bits, (row[a:b], here >> 6), np.uint64(1) << (here & 63).astype(np.uint64))
        for i in range(n - 1):
            both[i, i + 1 :] += np.bitwise_count(bits[i + 1 :] & bits[i]).sum(1, dtype=np.int32)
    root = np.arange(n)
    for i in range(n - 1):
        alike = np.flatnonzero(both[i, i + 1 :] >= threshold * (sizes[i] + sizes[i + 1 :] - both[i, i + 1 :])) + i + 1
        if len(alike):
            root = unite(root, np.full(len(alike), i), alike)
    return [(int(ids[i]), int(ids[r])) for i, r in enumerate(root) if i != r and ids[i] != ids[r]]


def sorted_groups(it: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Groups of two rows or more, as tables, of batches that are sorted by their first two columns."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in it:
        if not batch.num_rows:
            continue
        a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (b[1:] != b[:-1])) + 1, [batch.num_rows]])
        several = cuts[1:] - cuts[:-1] > 1
        several[[0, -1]] = True  # the first and the last group may go on in other batches
        for k in np.flatnonzero(several):
            start, end = int(cuts[k]), int(cuts[k + 1])
            if held and key != (a[start], b[start]):
                if len(held) > 1 or held[0].num_rows > 1:
                    yield pa.Table.from_batches(held)
                held = []
            key = (a[start], b[start])
            held.append(batch.slice(start, end - start))
    if len(held) > 1 or (held and held[0].num_rows > 1):
        yield pa.Table.from_batches(held)


def compare_sets(threshold: float) -> Callable:
    """Compares rows by the exact Jaccard similarity of their sets."""
    return lambda ids, payload: similar_forest(ids, [np.asarray(g.values) for c in payload.chunks for g in c], threshold)


def block_links(rows: DataFrame, compare: Callable) -> DataFrame:
    """(grp, cell, id, payload) -> (src, dst) spanning links that ``compare`` finds in each (grp, cell)."""

    def out(found):
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], ["src", "dst"])

    def link(it):
        found = []
        for group in sorted_groups(it):
            found += compare(group["id"].to_numpy(), group["payload"])
            if len(found) > 10_000:
                yield out(found)
                found = []
        yield out(found)

    return rows.select("grp", "cell", "id", "payload").repartition("grp", "cell").sortWithinPartitions("grp", "cell", "id").mapInArrow(link, "src long, dst long")


def in_blocks(members: DataFrame, block: int) -> DataFrame:
    """(grp, id) -> the same with ``pivot``, the least id of the group, and ``k``, its number of blocks.

    Groups of one row are left out."""
    sizes = members.groupBy("grp").agg(F.min("id").alias("pivot"), F.max("id").alias("last"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("k"))
    return members.join(sizes.where("pivot < last").drop("last"), "grp")


def linked_blocks(rows: DataFrame, compare: Callable, block: int) -> DataFrame:
    """(grp, pivot, k, id, payload) -> (src, dst) spanning links of the rows of each group.

    The pivot of a group of several blocks visits each of them; what is not linked to it, directly or by
    others, then meets all rows of the group, block by block. Only rows that are linked to the pivot
    both are never compared.
    """
    here = (F.col("id") == F.col("pivot")) & (F.col("k") > 1)
    spread = F.when(here, F.sequence(F.lit(0), F.col("k") - 1)).otherwise(F.array(F.pmod(F.xxhash64("id"), F.col("k")).cast("int")))
    first = durable(block_links(rows.select("grp", F.explode(spread).alias("cell"), "id", "payload"), compare))
    large = rows.where("k > 1")
    if large.isEmpty():
        return first
    classes = connected_components(first)
    marked = large.join(classes.withColumnRenamed("component", "mine"), "id", "left").join(classes.select(F.col("id").alias("pivot"), F.col("component").alias("its")), "pivot", "left")
    marked = marked.withColumn("rest", F.coalesce("mine", "id") != F.coalesce("its", "pivot"))
    counts = marked.groupBy("grp").agg(*[F.ceil(F.count(F.when(F.col("rest") == side, 1)) / block).cast("int").alias(name) for side, name in ((True, "kr"), (False, "km"))]).where("kr > 0")
    mine = F.pmod(F.xxhash64("id", F.lit(1)), F.when(F.col("rest"), F.col("kr")).otherwise(F.col("km"))).cast("int")
    upto = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    # cells: pairs of blocks of the rest, and each such block with each block of the linked rows
    name = lambda kind, a, b: F.xxhash64(F.concat_ws("-", F.lit(kind), a.cast("string"), b.cast("string")))
    meets = F.when(~F.col("rest"), F.transform(upto("kr"), lambda b: name("m", b, F.col("blk")))).otherwise(
        F.concat(F.transform(upto("kr"), lambda b: name("r", F.least(b, "blk"), F.greatest(b, "blk"))), F.transform(upto("km"), lambda m: name("m", F.col("blk"), m)))
    )
    dealt = marked.join(counts, "grp").withColumn("blk", mine).select("grp", F.explode(meets).alias("cell"), "id", "payload")
    return first.union(block_links(dealt, compare))
