"""Forests of any depth by pointer jumping: a node holds one pointer and its sums, never its path."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import forget, written
from .skew import lookup


def contracted(nodes: DataFrame, sums: Sequence[str] = ()) -> DataFrame:
    """(id, parent, sums...) -> (id, root_id, depth, sums... over the node and all below it).

    A parent that is null or not among the ids makes a root. In every round a node knows a run of its
    ancestors, twice as long as before, and what lies below it within that reach: it adds the sums of
    the nodes whose run ends just below it, and its pointer jumps to where the run of the node above
    ends. So rounds are the logarithm of the depth, rows stay one for each node, and each round ends in a
    table whose size Spark knows (sizes guessed through joins square in every round). Rows on a cycle, or below one, never reach a root and are left out. Ids are
    unique and not null.
    """
    sums = list(sums)
    known = nodes.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    state = lookup(nodes, known, ["parent"], "left").select("id", F.when(F.col("known"), F.col("parent")).alias("up"), F.col("id").alias("root_id"), F.lit(0).cast("long").alias("depth"), *sums)
    state = written(state, "forest")
    left = state.where("up is not null").count()
    while left:
        open_ = state.where("up is not null")
        above = state.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("root_id").alias("its_root"), F.col("depth").alias("its_depth"))
        jumped = lookup(open_, above, ["up"]).select("id", F.col("further").alias("up"), F.col("its_root").alias("root_id"), (F.col("depth") + 1 + F.col("its_depth")).alias("depth"), *sums)
        after = state.where("up is null").unionByName(jumped)
        if sums:
            below = open_.groupBy(F.col("up").alias("id")).agg(*[F.sum(c).alias(f"_b_{c}") for c in sums])
            after = after.join(below, "id", "left").select("id", "up", "root_id", "depth", *[(F.col(c) + F.coalesce(F.col(f"_b_{c}"), F.lit(0))).alias(c) for c in sums])
        former, state = state, written(after, "forest")
        forget(former)
        before, left = left, state.where("up is not null").count()
        if left == before:
            break
    return state.where("up is null").drop("up")
