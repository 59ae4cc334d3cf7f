"""Every registered query with SQL against an oracle engine on the smallest given tables."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from stockops.plans import catalog

FOLDER = "/root/testdata/sf0.001"
GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="given tables are absent")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in GIVEN:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, bool):
        return repr(v)
    if isinstance(v, int | float | Decimal):
        return "nan" if math.isnan(v) else repr(round(float(v), 5) + 0.0)
    return str(v)


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    if name not in ORACLES:
        assert got
        return
    cur = duck.execute(ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cur.fetchall())


def test_partitions_do_not_change_results(spark):
    def rows():
        return sorted(map(str, QUERIES["v5_device_anomalies"](spark, FOLDER).collect()))

    before, width = rows(), spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert rows() == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)


def test_kept_moves_take_no_rank_of_lines(spark, monkeypatch):
    """Moves kept for decisions have no id, so their table is written without a window over all lines."""
    plans = {}

    def spy(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        return df

    monkeypatch.setattr("stockops.plans.registry.written", spy)
    QUERIES["b14_decision_confidence"](spark, FOLDER)
    assert "Window" not in plans["moves"] and "Window" not in plans["balances"] and "Window" in plans["order_lines"]


def test_decisions_read_what_is_observed(spark, monkeypatch):
    """Moves, balances and lines are kept of observed products and their orders only; too many keys to broadcast
    change no row."""
    from stockops.plans import registry

    wide, kept, write = "/root/testdata/sf0.01", {}, registry.written
    monkeypatch.setattr(registry, "written", lambda df, name: (kept.setdefault(name, df.count()), write(df, name))[1])
    narrow = QUERIES["b15_deferral"](spark, wide)
    lines = spark.read.parquet(f"{wide}/lineitem.parquet").count()
    assert 0 < kept["moves"] < lines / 4 and kept["balances"] < lines / 2 and 0 < kept["order_lines"] < lines
    # observed products are a tenth; the orders that hold one are more
    got = sorted(map(str, narrow.collect()))
    monkeypatch.setattr(registry, "written", write)
    monkeypatch.setattr(registry.Tables, "narrowed", lambda *a, **k: None)
    assert got and got == sorted(map(str, QUERIES["b15_deferral"](spark, wide).collect()))
