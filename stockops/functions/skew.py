"""Lookups in tables of unique keys by rows of which many may ask for one key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(df: DataFrame, table: DataFrame, on: Sequence[str], how: str = "inner", most: int = 1 << 16, least: int = 256) -> DataFrame:
    """``df`` joined with ``table``, whose keys are unique; ``how``: inner, left, left_semi or left_anti.

    Keys that more than ``least`` rows and more than one row of ``most`` ask for meet them by broadcast:
    they are fewer than ``most``, whatever the size of ``df``. All others are shuffled. Null keys meet nothing.
    """
    on = list(on)
    total = df.count()
    if total <= least:
        return df.join(table, on, how)
    hot = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_asked")).where(F.col("_asked") > max(least, total // most)).dropna(subset=on).select(*on)
    if hot.isEmpty():
        return df.join(table, on, how)
    known = table.join(F.broadcast(hot), on, "left_semi")
    rest = df.join(F.broadcast(hot), on, "left_anti").join(table, on, how)
    return df.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(known), on, how).unionByName(rest)
