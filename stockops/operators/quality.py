"""Data quality: domain rules, uniqueness, orphans."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_negative(column: str) -> Column:
    return F.col(column) < 0


def not_positive(column: str) -> Column:
    return F.col(column) <= 0


def outside_unit(column: str) -> Column:
    return (F.col(column) < 0) | (F.col(column) > 1)


def outside_domain(column: str, domain: Sequence[str]) -> Column:
    return ~F.lower(F.col(column)).isin(list(domain))


def check_violations(df: DataFrame, rules: Mapping[str, Column], id_column: str = "id") -> DataFrame:
    """Number of violating rows and smallest violating id of each rule, in one pass. Nulls pass."""
    broken = F.filter(F.array(*[F.struct(F.lit(name).alias("rule"), F.coalesce(c, F.lit(False)).alias("bad")) for name, c in rules.items()]), lambda r: r["bad"])
    return df.select(F.col(id_column).alias("id"), F.explode(broken).alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("id").alias("first_id"))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def orphan_rows(child: DataFrame, parent: DataFrame, foreign_key: str, key: str = "id") -> DataFrame:
    """Rows whose foreign key is set but has no parent."""
    return child.where(F.col(foreign_key).isNotNull()).join(parent.select(F.col(key).alias(foreign_key)).distinct(), foreign_key, "left_anti")
