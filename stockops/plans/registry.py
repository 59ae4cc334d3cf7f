"""Registry of queries over the given tables, each with its oracle SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.durable import written
from ..sources.logical import load, with_clause

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Pinned moments: the data has no wall clock.
AS_OF, EVENTS_AS_OF = "1998-06-01 00:00:00", "2024-01-31 00:00:00"


class Tables:
    """Logical and given tables of one folder by attribute."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._cache = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        return load(self.spark, self.sf_dir, name, self._cache)

    def keep(self, *names: str, without: Sequence[str] = ()) -> None:
        """Write tables that a query reads many times once; later uses read what was written. Columns that the
        query does not use can be left out, with all the work that they alone need."""
        for name in names:
            self._cache[name] = written(getattr(self, name).drop(*without), name)

    def within(self, **given: DataFrame) -> Tables:
        """The same folder with some tables replaced, and with them whatever is made of them."""
        out = Tables(self.spark, self.sf_dir)
        out._cache.update(given)
        return out

    def narrowed(self, keys: DataFrame, max_bytes: int = 8 << 20, row_bytes: int = 64, **on: str) -> Tables | None:
        """The same folder with the rows of given tables whose key, an expression for each table, stands in the one
        column of ``keys``; they are written. None if the counted keys are too many to be broadcast."""
        if keys.count() * row_bytes > max_bytes:
            return None
        asked = F.broadcast(keys.toDF("_asked"))
        return self.within(**{x: written(getattr(self, x).join(asked, F.expr(key) == F.col("_asked"), "left_semi"), x) for x, key in on.items()})


def query(name: str, needs: Sequence[str] = (), sql: str | None = None):
    """Register ``fn(tables)``. ``sql``: a SELECT, or further CTEs that start with a comma."""

    def register(fn):
        QUERIES[name] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = (with_clause(needs) or "WITH RECURSIVE one AS (SELECT 1 AS one)") + "\n" + sql.strip()
        return fn

    return register


def r6(column: str | Column, name: str | None = None) -> Column:
    """Rounded to six digits: sums of doubles depend on their order."""
    c = F.col(column) if isinstance(column, str) else column
    return F.round(c, 6).alias(name or (column if isinstance(column, str) else "value"))


def us(column: str) -> Column:
    """A moment as microseconds since 1970."""
    return F.unix_micros(F.col(column)).alias(column)


def joined(column: str) -> Column:
    """An array of strings as one string."""
    return F.array_join(column, ",").alias(column)
