"""Running sums and exclusive-ors over keys of any size.

A key with many rows is cut into ranges of its order. Each range is summed by itself, the totals of
the ranges are scanned (one row for each), and every row adds what lies before its range. Keys below
the bound take one window. Both ways give the same rows; only the plan differs.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import written

#: Rows of one key that one task may sum.
BLOCK = 1 << 20


def same(left: str, right: str, columns: Sequence[str]) -> Column:
    """Equality of key columns of two aliases; nulls are equal."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns], F.lit(True))


def ordered(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], exclusive: bool = False, block: int = BLOCK, ranges: int | None = None, fold: str = "sum"
) -> DataFrame:
    """``df`` with a running sum for each entry of ``sums``, within ``keys`` and in ``order``.

    ``fold`` is ``sum`` or ``bit_xor``: an aggregate that 0 leaves as it is and that adds up over ranges.
    ``exclusive`` leaves the row's own value out (0 at the first row); null values count as nothing.
    The order should be total: rows that tie share a range, but their order there is Spark's. Null keys
    are a key like any other. Keys of more than ``block`` rows are cut into ``ranges`` ranges (the number
    of shuffle partitions, if not given). No columns are dropped; an empty table stays empty.
    """
    keys = list(keys)
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > block).select(*keys)
    if sizes.isEmpty():
        return in_window(df, keys, order, sums, exclusive, fold)
    hot = sizes.alias("h")
    large = df.alias("d").join(hot, same("d", "h", keys), "left_semi")
    small = df.alias("d").join(hot, same("d", "h", keys), "left_anti")
    return in_window(small, keys, order, sums, exclusive, fold).unionByName(in_ranges(large, keys, order, sums, exclusive, ranges, fold))


FOLDS = {"sum": (F.sum, lambda a, b: a + b), "bit_xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b))}


def in_window(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], exclusive: bool, fold: str = "sum") -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*ordered(order)).rowsBetween(Window.unboundedPreceding, -1 if exclusive else 0)
    return df.withColumns({name: F.coalesce(FOLDS[fold][0](value).over(w), F.lit(0)) for name, value in sums.items()})


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], sums: dict[str, Column], exclusive: bool, ranges: int | None = None, fold: str = "sum") -> DataFrame:
    """The running sums by ranges of (keys, order). Ranges are cut from a sample, so rows are written with
    the number of theirs before they are read twice."""
    total, plus = FOLDS[fold]
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = df.withColumns({f"_v_{name}": value for name, value in sums.items()})
    cut = written(cut.repartitionByRange(n, *keys, *ordered(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = cut.groupBy(*keys, "_range").agg(*[total(f"_v_{name}").alias(f"_t_{name}") for name in sums])
    earlier = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, "_range", *[F.coalesce(total(f"_t_{name}").over(earlier), F.lit(0)).alias(f"_o_{name}") for name in sums])
    met = cut.alias("c").join(offsets.alias("o"), same("c", "o", [*keys, "_range"])).select("c.*", *[f"o._o_{name}" for name in sums])
    local = in_window(met, [*keys, "_range"], order, {name: F.col(f"_v_{name}") for name in sums}, exclusive, fold)
    return local.withColumns({name: plus(F.col(name), F.col(f"_o_{name}")) for name in sums}).select(*df.columns, *sums)


def medians(df: DataFrame, keys: Sequence[str], value: str, block: int = BLOCK, ranges: int | None = None) -> DataFrame:
    """(keys, median): the exact median of the values of each key, the mean of the two middle ones if their number
    is even. Equal values are counted first, then counts are summed in order of the values, in ranges where a
    key has many; no key is ever gathered. Nulls count as nothing; a key without values has a null median.
    """
    keys = list(keys)
    counts = df.groupBy(*keys, F.col(value).alias("_value")).agg(F.count(value).alias("_n"))
    upto = running(counts, keys, [F.col("_value").asc_nulls_first()], {"_upto": F.col("_n")}, block=block, ranges=ranges)
    total = df.groupBy(*keys).agg(F.count(value).alias("_total"))
    met = upto.alias("u").join(total.alias("t"), same("u", "t", keys)).select("u.*", "_total")
    at = lambda rank: F.min(F.when(F.col("_upto") >= rank, F.col("_value")))
    low, high = at(F.floor((F.col("_total") + 1) / 2)), at(F.floor(F.col("_total") / 2) + 1)
    return met.where("_value is not null or _total = 0").groupBy(*keys).agg(((low + high) / 2).alias("median"))
