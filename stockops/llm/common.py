"""Shared helpers of the corpus operators: durable cuts, connected components, word rules."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import durable, forget, shared_folder, written
from ..functions.python import ship

__all__ = ["durable", "shared_folder", "ship", "written"]

#: Word rule shared by several operators: everything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Byte tables for bytes.translate(); UTF-8 never uses ASCII bytes inside a longer character.
LOWER_ASCII = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def if_small(df: DataFrame, row_bytes: int, max_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows stay within the bound; else Spark shuffles it."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


#: Bits of a row of ``bitmap_construct_agg``.
BITMAP_BITS = 32768


def maybe_among(df: DataFrame, on: list[str], keys: DataFrame, max_bytes: int) -> DataFrame:
    """``df`` with a boolean column ``maybe``: false where ``on`` is surely not among the rows of ``keys``.

    The keys are hashed into a bitmap of 16 bits a key, ``max_bytes`` at most, that is broadcast; one row in 16
    that is not among them may be. So wide rows that no key asks for need not be shuffled.
    """
    parts = max(1, min(max_bytes * 8, 16 * keys.count()) // BITMAP_BITS)
    spot = F.pmod(F.xxhash64(*on), F.lit(parts * BITMAP_BITS).cast("long"))
    part, bit = F.floor(F.col("_spot") / BITMAP_BITS).cast("int"), F.col("_spot") % BITMAP_BITS
    bits = keys.select(spot.alias("_spot")).groupBy(part.alias("_part")).agg(F.bitmap_construct_agg(bit).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    found = df.withColumn("_spot", spot).withColumn("_part", part).join(F.broadcast(bits), "_part", "left")
    return found.withColumn("maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_spot", "_part", "_bits")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def held_out(doc_id: Column) -> Column:
    """True for the quarter of rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots after linking rows a[k] and b[k]; every root is the smallest row of its set."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return root
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def connected_components(links: DataFrame, max_rounds: int = 40) -> DataFrame:
    """(src, dst) links between long ids -> (id, component), the smallest id reachable.

    Alternating large-star and small-star steps: every step is one aggregation and one join on
    the node, rows never exceed twice the links, and the number of rounds is logarithmic.
    Only ids that occur in a link are returned; null ends are ignored. Each round ends in a table, so
    plans stay short, sizes are known and a lost executor costs one round at most. Links settle when
    their number and a sum of their hashes do.
    """
    edges = (
        links.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    edges = written(edges, "components")
    state = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.shiftright(F.xxhash64("v", "u"), 32))).head())
    before = state(edges)
    for _ in range(max_rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        former, edges = edges, written(small.where("u <> v").distinct(), "components")
        forget(former)
        after = state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
