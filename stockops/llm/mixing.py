"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets share the tokens of all sources by weight; a source is repeated ``cap`` times at most and
what it cannot give is shared again by weight. Equal-token blocks are then apportioned by highest
quotients, first to the sources, within a source to groups of its shards and within a group to the
shards, so quotas are integers that add up. A shard lays its documents out in seeded order and takes its quota of blocks as one run from a
seeded block onwards, around the end if need be; whole passes come first. All of it is DataFrame
operations, and only sums for each source and shard are ever gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, durable, if_small


def targets(sources: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, source_size) -> the same with ``target``. Weights repeat over sources by code point,
    null last. The common level is found in closed form over sources ordered by the level at which
    they reach their cap."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sources.withColumn("weight", weight)
    t = t.withColumn("most", cap * F.col("source_size")).withColumn("full_at", F.col("most") / F.col("weight")).withColumn("total", F.sum("source_size").over(everything))
    t = t.withColumn("given", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("open", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing))).withColumn("nr", F.row_number().over(by_level))
    t = t.withColumn("level", (F.col("total") - F.col("given")) / F.col("open"))
    settled = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("nr", "level"))).over(everything)["level"]
    target = F.least(F.col("most").cast("double"), F.coalesce(settled * F.col("weight"), F.col("most").cast("double")))
    return t.select("source", "source_size", target.alias("target"))


def apportion(votes: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Sainte-Lague: adds ``quota`` to rows (group, order, votes, seats), seats being the group's.

    Seats that a row is sure of are given at once; only the quotients near its share compete, a
    number that grows with the rows and not with the seats.
    """
    all_of = Window.partitionBy(*group)
    t = votes.withColumn("share", F.coalesce(F.try_divide(F.col("seats") * F.col("votes"), F.sum("votes").over(all_of)), F.lit(0.0)))
    slack = F.ceil(F.coalesce(F.try_divide(F.col("share") * F.count(F.lit(1)).over(all_of), F.col("seats")), F.lit(0.0))) + 2
    t = t.withColumn("slack", slack).withColumn("sure", F.greatest(F.lit(0).cast("long"), F.floor("share") - F.col("slack")))
    t = t.withColumn("left", F.col("seats") - F.sum("sure").over(all_of))
    k = F.explode(F.sequence(F.col("sure") + 1, F.floor("share") + F.col("slack") + 1))
    rivals = t.where("votes > 0").select(*group, *order, "left", "votes", k.alias("k"))
    best = Window.partitionBy(*group).orderBy(F.desc(F.col("votes") / (2 * F.col("k") - 1)), *[F.col(c).asc_nulls_last() for c in order], "k")
    won = rivals.withColumn("nr", F.row_number().over(best)).where(F.col("nr") <= F.col("left")).groupBy(*group, *order).agg(F.count(F.lit(1)).alias("won"))
    keys = [*group, *order]
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return t.alias("a").join(won.alias("b"), same, "left").select("a.*", F.coalesce("won", F.lit(0)).alias("won")).withColumn("quota", F.col("sure") + F.col("won")).drop("share", "slack", "sure", "left", "won")


def plan(docs: DataFrame, weights: Sequence[float], cap: int, seed: int, rows_per_shard: int, max_block: int, group: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, size, at, shard, ...) with where they lie in their shard and what is taken
    there, and the sources (source, source_size, target, n_shards)."""
    text = F.col("text").cast("string")
    size = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    rows = durable(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), place(seed).alias("at")))
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.ceil(F.count(F.lit(1)) / rows_per_shard).cast("long").alias("n_shards"))
    sources = durable(targets(sums, weights, cap).alias("t").join(sums.alias("s"), F.col("t.source").eqNullSafe(F.col("s.source"))).select("t.*", "n_shards"))
    total, least = sources.agg(F.sum("source_size"), F.min(F.when(F.col("target") > 0, F.col("target")))).head()
    block = int(max(1, min(max_block, (least or 1) / 1000)))
    seats = F.lit(round((total or 0) / block)).cast("long")

    # blocks go to the sources, within a source to groups of shards, within a group to its shards
    rows = rows.alias("d").join(if_small(sources, 64, 8 << 20).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "source_size", "target", "n_shards")
    rows = rows.withColumn("shard", shard_of(seed))
    sizes = durable(rows.groupBy("source", "shard").agg(F.sum("size").alias("votes")).withColumn("grp", F.floor(F.col("shard") / group)))
    of_source = apportion(sources.select("source", F.col("target").alias("votes"), seats.alias("seats")), [], ["source"])
    of_group = apportion(with_seats(sizes.groupBy("source", "grp").agg(F.sum("votes").alias("votes")), of_source, ["source"]), ["source"], ["grp"])
    quotas = apportion(with_seats(sizes, of_group, ["source", "grp"]), ["source", "grp"], ["shard"])
    run = F.least(F.col("quota") * block, cap * F.col("votes"))
    begin = F.pmod(F.xxhash64(F.lit(seed + 2), "source", "shard"), F.greatest(F.lit(1).cast("long"), F.ceil(F.col("votes") / block))) * block
    quotas = quotas.where("votes > 0").select(
        "source", "shard", F.col("votes").alias("length"), F.floor(run / F.col("votes")).alias("passes"), F.pmod(run, F.col("votes")).alias("rest"), begin.alias("begin")
    )
    laid = rows.withColumn("b", F.sum("size").over(Window.partitionBy("source", "shard").orderBy("at", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)))
    laid = laid.withColumn("a", F.col("b") - F.col("size"))
    return with_seats(laid, quotas, ["source", "shard"], ["length", "passes", "rest", "begin"]), sources


def place(seed: int) -> Column:
    """Seeded place of a row; rows equal in doc_id and text share it."""
    return F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64(F.col("text").cast("string")))


def shard_of(seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed + 1), "at"), F.col("n_shards"))


def with_seats(rows: DataFrame, given: DataFrame, keys: list[str], columns: Sequence[str] = ("quota",)) -> DataFrame:
    """Joins what was given by keys that may be null; a quota is called ``seats`` at the next level."""
    on = F.lit(True)
    for c in keys:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"g.{c}"))
    return rows.alias("r").join(given.alias("g"), on, "left").select("r.*", *[F.col(f"g.{c}").alias("seats" if c == "quota" else c) for c in columns])


def overlaps() -> tuple[Column, Column]:
    """Words of a row in the run from ``begin``, up to the end of the shard and from its start on."""
    zero, stop = F.lit(0).cast("long"), F.col("begin") + F.col("rest")
    overlap = lambda lo, hi: F.coalesce(F.greatest(zero, F.least(F.col("b"), hi) - F.greatest(F.col("a"), lo)), zero)
    return overlap(F.col("begin"), F.least(stop, F.col("length"))), overlap(zero, stop - F.col("length"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 42, rows_per_shard: int = 2_000, max_block: int = 2048, group: int = 1024) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, source_size, target, taken.

    ``size``: words of the text; null and empty texts have none and are never taken. ``taken``: words
    the mix takes of the document, repeats counted, at most ``cap`` times its size. A null source is a
    source of its own, a null doc_id is an id like any other. Blocks hold as many words as keep rounding
    below a thousandth of the smallest target, ``max_block`` at most; the last block of a run ends where
    the quota does. A source is dealt to shards of some ``rows_per_shard`` rows, so no task holds a whole
    source, and its shards to groups of ``group``, so none ranks all its shards. Repeated rows each count;
    runs with equal input and seed agree. Empty tables give empty tables; other columns are ignored.
    """
    rows, _ = plan(docs, weights, cap, seed, rows_per_shard, max_block, group)
    tail, head = overlaps()
    taken = F.coalesce(F.col("passes") * F.col("size"), F.lit(0)) + tail + head
    return rows.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), cap: int = 3, seed: int = 42, rows_per_shard: int = 2_000, max_block: int = 2048, group: int = 1024) -> DataFrame:
    """The documents of the mix, each as often as it is taken as a whole: a document that a run cuts
    counts if half of it or more lies inside, at one end of the run or at both together.

    A run takes its shard's documents from one seeded place to another, so texts meet a few numbers for
    each shard and not for each document; they are shuffled only if those numbers are not small. Null and
    empty texts are never taken; row rules are those of ``mix``; an empty table stays empty.
    """
    rows, sources = plan(docs, weights, cap, seed, rows_per_shard, max_block, group)
    tail, head = overlaps()
    most = 2 * (tail + head) >= F.col("size")
    # a row at both ends of its run belongs to the end that begins in it
    tail, head = most & (tail > 0), most & (tail == 0) & (head > 0)
    runs = rows.where("length > 0").groupBy("source", "shard").agg(
        F.max("passes").alias("passes"), F.min(F.when(tail, F.col("at"))).alias("low"), F.max(F.when(tail, F.col("at"))).alias("high"), F.max(F.when(head, F.col("at"))).alias("top")
    )
    runs = durable(runs)
    text = F.col("text").cast("string")
    held = docs.select(F.col("source").cast("string").alias("source"), place(seed).alias("at"), F.regexp_like(text, F.lit(WORD)).alias("some"), F.struct(*[docs[c] for c in docs.columns]).alias("whole"))
    found = held.alias("h").join(if_small(sources, 64, 8 << 20).alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).where("some").select("h.*", "n_shards").withColumn("shard", shard_of(seed))
    on = F.col("f.source").eqNullSafe(F.col("r.source")) & (F.col("f.shard") == F.col("r.shard"))
    found = found.alias("f").join(if_small(runs, 64, 8 << 20).alias("r"), on).select("whole", "at", "passes", "low", "high", "top")
    inside = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    copies = F.col("passes").cast("int") + inside(F.col("at").between(F.col("low"), F.col("high"))) + inside(F.col("at") <= F.col("top"))
    return found.withColumn("copies", copies).where("copies > 0").withColumn("nr", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("whole.*")
