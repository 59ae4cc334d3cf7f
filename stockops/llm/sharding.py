"""Sharding by weighted rendezvous hashing of stable record keys.

Every record ranks all shards by ``-ln(u) / weight``, ``u`` being a hash of key and shard in (0, 1),
and goes to the smallest. A shard that is added takes only the records that now rank it first, and
no record moves between old shards. All of it is column expressions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import durable


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """Shard number (int) of a key; null keys go where a null hashes. Weights of zero take no records."""
    shards = [
        F.struct((-F.log((F.shiftrightunsigned(F.xxhash64(key, F.lit(k)), 11).cast("double") + 0.5) / float(1 << 53)) / float(w)).alias("cost"), F.lit(k).alias("shard"))
        for k, w in enumerate(weights)
        if w > 0
    ]
    if not shards:
        raise ValueError("no shard has a weight above zero")
    return (F.least(*shards) if len(shards) > 1 else shards[0])["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], rows_per_bucket: int = 20_000) -> DataFrame:
    """One row for each row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``size``: UTF-8 bytes of the text (null: none) plus 8. ``slot`` numbers the rows of a shard from 0
    without gaps; it is a rank within one bucket of some ``rows_per_bucket`` rows plus the sizes of the
    buckets before, so no task ever sorts a whole shard. Rows are dealt to buckets by their number, so
    copies of a row and rows without an id are spread as well. ``grown_shard``: the shard with one more
    of the last weight. Rows without doc_id share one shard, as their key is the same; repeated rows get
    slots of their own. Empty tables give empty tables; other columns are ignored.
    """
    key = F.col("doc_id").cast("long")
    body = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        key.alias("doc_id"),
        (F.octet_length(body) + F.lit(8)).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, [*weights, weights[-1]]).alias("grown_shard"),
        F.monotonically_increasing_id().alias("nr"),
    )
    rows = durable(rows)
    buckets = max(16, -(-rows.count() // (rows_per_bucket * len(weights))))
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("nr"), F.lit(buckets)))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = (
        rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("shard", "bucket", "before")
    )
    within = Window.partitionBy("shard", "bucket").orderBy("nr")
    return rows.join(ranges, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("before") + F.row_number().over(within) - 1).cast("long").alias("slot"), "grown_shard"
    )


def sharded_documents(docs: DataFrame, weights: Sequence[float]) -> DataFrame:
    """``docs`` with their ``shard`` by rendezvous hashing of the doc_id, in one pass without a shuffle.

    A column of that name gives way. Rows without doc_id share one shard, rows that repeat a doc_id too;
    texts are not read; an empty table stays empty. ``write.partitionBy("shard")`` lays the shards out.
    """
    return docs.withColumn("shard", rendezvous(F.col("doc_id").cast("long"), weights))
