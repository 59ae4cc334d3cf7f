"""Column helpers that several operators share."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is zero or null."""
    return F.try_divide(a.cast("double"), b)


def weighted_mean(value: Column, weight: Column) -> Column:
    """Aggregate: sum(value * weight) / sum(weight); null weights count as 0, a zero sum gives null."""
    w = F.coalesce(weight, F.lit(0.0))
    return F.try_divide(F.sum(value * w), F.sum(w))


def hours_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(3.6e9)


def days_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(8.64e10)


def at(ts: str) -> Column:
    """A pinned moment (UTC)."""
    return F.lit(ts).cast("timestamp")


def plus_hours(ts: Column, hours: float) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + F.lit(round(hours * 3_600_000_000)).cast("long"))


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def labels(*pairs: tuple[Column, str]) -> Column:
    """Array of the names whose condition is true, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in pairs]))


def norm_cdf(z: Column) -> Column:
    """Standard normal distribution function by a five-term polynomial (error below 7.5e-8)."""
    a = F.abs(z)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def page(df: DataFrame, order: Sequence[Column], offset: int = 0, limit: int | None = 50) -> DataFrame:
    """One page in a total order; Spark keeps only the top offset + limit rows of each partition."""
    df = df.orderBy(*order)
    if offset:
        df = df.offset(offset)
    return df if limit is None else df.limit(limit)


def by_keys(df: DataFrame, keys, column: str = "id") -> DataFrame:
    """Rows whose key is one literal, in a list, or in a DataFrame of keys."""
    if isinstance(keys, DataFrame):
        return df.join(keys.select(F.col(keys.columns[0]).alias(column)).distinct(), column, "left_semi")
    if isinstance(keys, list | tuple | set):
        return df.where(F.col(column).isin(list(keys)))
    return df.where(F.col(column) == keys)


def lowered(values) -> list[str]:
    return [v.lower() for v in ([values] if isinstance(values, str) else values)]
