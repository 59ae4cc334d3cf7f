"""Scans over hot keys and forests against plain versions."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stockops.functions.forest import contracted
from stockops.functions.scan import in_ranges, medians, running
from stockops.operators import decisions, graph, inventory, topology


def test_running_sums_of_a_hot_key(spark):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.5 else rng.choice(["a", "b", None]), rng.randrange(40), i, rng.choice([None, 1, 2, -3])) for i in range(3_000)]
    rows += [r for r in rows if r[3]][:1]  # a repeated row ties
    df = spark.createDataFrame(rows, "k string, t int, id int, v long")
    for exclusive in (False, True):
        want, acc = [], {}
        for k, t, i, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
            before = acc.get(k, (0, 0))
            acc[k] = (before[0] + (v or 0), before[1] + 1)
            want.append((k, t, i, v, *(before if exclusive else acc[k])))
        for options in ({}, {"block": 100}, {"block": 100, "ranges": 37}, {"block": 0}):
            got = running(df, ["k"], ["t", "id"], {"s": F.col("v"), "n": F.lit(1)}, exclusive, **options)
            assert got.columns == ["k", "t", "id", "v", "s", "n"]
            key = lambda r: (r[0] or "", r[1], r[2], r[5])
            assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    for options in ({}, {"block": 100, "ranges": 9}):
        last = running(df, ["k"], ["t", "id"], {"x": F.col("id")}, fold="bit_xor", **options).groupBy("k").agg(F.max_by("x", F.struct("t", "id")).alias("x"), F.bit_xor("id").alias("want"))
        assert last.where("x <> want").isEmpty() and last.count() == 4
    assert running(df.where("false"), ["k"], ["t"], {"s": F.col("v")}).isEmpty()


def test_ranges_of_one_key_are_even(spark):
    df = spark.range(200_000).select(F.lit(1).alias("k"), F.col("id"))
    got = in_ranges(df, ["k"], ["id"], {"s": F.lit(1)}, False, 16)
    assert got.where("s <> id + 1").isEmpty() and got.count() == 200_000
    sizes = [r["count"] for r in df.repartitionByRange(16, "k", "id").groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * sorted(sizes)[8]


def test_forest_sums_equal_plain_walks(spark):
    rng = random.Random(2)
    parent = {i: rng.choice([None, 999, *range(max(0, i - 4), i)]) if i else None for i in range(300)}
    parent |= {500: 501, 501: 502, 502: 500, 503: 500}  # a cycle and a node below it
    rows = [(i, p, i + 1) for i, p in parent.items()]
    got = {r.id: (r.root_id, r.depth, r.v) for r in contracted(spark.createDataFrame(rows, "id long, parent long, v long"), ["v"]).collect()}
    total = {i: 0 for i in range(300)}
    want = {}
    for i in range(300):
        at, depth = i, 0
        total[at] += i + 1
        while parent[at] in total:
            at, depth = parent[at], depth + 1
            total[at] += i + 1
        want[i] = (at, depth)
    assert got == {i: (*want[i], total[i]) for i in want}
    assert contracted(spark.createDataFrame([], "id long, parent long, v long"), ["v"]).isEmpty()


READINGS = "k string, observed_at timestamp, id string, observed_qty double, bias double, noise_sigma double, is_missing boolean"


def folded(readings, m, v):
    """The step after one another, as stated: lost readings widen, others correct and stay above zero."""
    for z, vs, lost in readings:
        if lost:
            v *= 2.25
            continue
        gain = 1.0 if vs == 0 else 0.0 if vs is None or v + vs == 0 else v / (v + vs)
        m = 0.0 if z is None else max(0.0, m + gain * (z - m))
        v = v if vs is None else v * vs / (v + vs) if v + vs else 0.0  # (1 - gain) * v, without loss of digits
    return m, v**0.5


def test_beliefs_of_a_hot_key_equal_the_fold(spark):
    n = 1_000_000
    value = F.when(F.col("id") % 7 < 4, 30 * F.sin(F.col("id") / 5000)).otherwise(F.pmod(F.xxhash64("id"), 40) - 10.0)
    df = spark.range(n).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id")).alias("observed_at"), F.col("id").cast("string").alias("id"), value.alias("observed_qty"), F.lit(0.5).alias("bias"), (1.0 + F.col("id") % 5).alias("noise_sigma"), (F.col("id") % 11 == 3).alias("is_missing"))
    rows = df.orderBy("observed_at").select("observed_qty", "noise_sigma", "is_missing").toPandas()
    m, std = folded([(q - 0.5, s * s, x) for q, s, x in zip(rows.observed_qty, rows.noise_sigma, rows.is_missing, strict=True)], 20.0, 400.0)
    for options in ({"block": 50_000}, {"segment": 500}):
        r = decisions.belief_sequence(df, ["k"], 20.0, 20.0, **options).collect()
        assert len(r) == 1 and r[0].n_readings == n and abs(r[0]["mean"] - m) < 1e-9 and abs(r[0]["std"] - std) < 1e-9


def test_beliefs_of_odd_readings(spark):
    rng = random.Random(9)
    series = {"empty": [], "exact": [(5.0, 0.0, 2.0, False), (None, 0.0, 1.0, True), (-3.0, 0.0, 0.0, False), (7.0, 0.0, 1.0, False)], "lost": [(None, 0.0, 1.0, None)] * 30, "null": [(4.0, 0.0, None, False), (4.0, None, 2.0, False), (1.0, 0.0, None, False)]}
    series |= {f"r{i}": [(rng.choice([None, rng.uniform(-30, 30)]), rng.choice([0.0, 1.0, None]), rng.choice([0.5, 2.0, 5.0, None]), rng.random() < 0.3) for _ in range(rng.randrange(1, 40))] for i in range(20)}
    series["long silence"] = [(9.0, 0.0, 1.0, False)] + [(None, 0.0, 1.0, True)] * 420 + [(3.0, 0.0, 1.0, False)] + [(4.0, 0.0, 2.0, False)]
    rows = [(k, datetime(2024, 1, 1) + timedelta(minutes=i), f"{i:03d}", q, b, s, x) for k, items in series.items() for i, (q, b, s, x) in enumerate(items)]
    for segment in (1, 3, 4096):
        got = {r.k: (r["mean"], r["std"]) for r in decisions.belief_sequence(spark.createDataFrame(rows, READINGS), ["k"], -2.0, 4.0, segment=segment, block=100).collect()}
        assert set(got) == set(series) - {"empty"}
        for k, (mean, std) in got.items():
            want = folded([(None if q is None or b is None else q - b, None if s is None else s * s, bool(x) or q is None) for q, b, s, x in series[k]], -2.0, 16.0)
            assert abs(mean - want[0]) < 1e-9 and abs(std - want[1]) <= 1e-9 * max(1, std), (k, segment)


def test_hot_keys_of_operators(spark):
    """One product with all rows: the ranges give what one window gives."""
    n = 5_000
    when = F.timestamp_seconds(F.col("id") % 900)
    moves = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("p").alias("product_id"), when.alias("occurred_at"), F.when(F.col("id") % 3 == 0, "a").alias("to_location_id"), F.when(F.col("id") % 3 > 0, "a").alias("from_location_id"), (F.col("id") % 17).cast("double").alias("qty"))
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(inventory.negative_stock_violations(moves)) == rows(inventory.negative_stock_violations(moves, block=100)) != []
    lines = spark.range(n).select("id", F.lit("p").alias("product_id"), when.alias("ts"), (F.col("id") % 5).cast("double").alias("qty"))
    stock = spark.createDataFrame([("p", 4321.0)], "product_id string, stock double")
    whole = rows(inventory.allocate_fcfs(lines, stock))
    assert whole == rows(inventory.allocate_fcfs(lines, stock, block=100)) and sum("shipped" in r for r in whole) > 500
    chunks = spark.createDataFrame([("c", [f"{i % 13}.{i}" for i in range(400)] + ["A.1", "2.b"])], "chunk_id string, referenced_figures array<string>")
    for c in graph.TARGETS:
        if c not in chunks.columns:
            chunks = chunks.withColumn(c, F.array().cast("array<string>"))
    got = graph.distinct_references(chunks, block=50)
    assert rows(graph.distinct_references(chunks)) == rows(got) and got.count() == 402 and got.agg(F.max("place")).head()[0] == 402


def test_chain_of_locations_takes_one_row_each(spark):
    n = 100_000
    chain = spark.range(n).select(F.col("id").cast("string").alias("id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_location_id"), F.lit("c").alias("code"), F.lit(2).alias("capacity_units"))
    up = topology.subtree_rollup(chain)
    assert up.where(F.col("n_nodes") != n - F.col("id").cast("long")).isEmpty() and up.where("capacity_units <> 2 * n_nodes").isEmpty() and up.count() == n


def test_siblings(spark):
    rows = [("r", None, "b"), ("q", None, "a"), *[(f"c{i}", "r", f"{9 - i % 5}") for i in range(9)]]
    tree = topology.locations_tree(spark.createDataFrame([(i, p, c, 1) for i, p, c in rows], "id string, parent_location_id string, code string, capacity_units int"))
    got = {r.id: r.sibling_rank for r in topology.sibling_order(tree).collect()}
    order = [i for _, i in sorted((c, i) for i, p, c in rows if p)]
    assert got == {"q": 1, "r": 2} | {i: k + 1 for k, i in enumerate(order)}


def test_medians_and_conflicts_of_hot_keys(spark):
    rng = random.Random(21)
    rows = [("hot", f"{i:05d}", rng.choice([None, 5.0, 5.0, round(rng.gauss(5, 1), 2)]), 0.5, rng.choice([0.2, 0.9])) for i in range(2_000)]
    rows += [("even", f"e{i}", float(v), 1.0, 0.5) for i, v in enumerate([1, 2, 10, 30])] + [("none", "n", None, 1.0, 0.5), (None, "x", 3.0, 1.0, 0.5)]
    df = spark.createDataFrame([(*r, 5.0, 6.0) for r in rows], "k string, signal_id string, mean double, std double, reliability double, base_mean double, base_std double")
    want = {r.k: r["median"] for r in df.groupBy("k").agg(F.median("mean").alias("median")).collect()}
    for options in ({}, {"block": 3, "ranges": 7}):
        assert {r.k: r["median"] for r in medians(df, ["k"], "mean", **options).collect()} == want
    near = lambda df: sorted((str(r.k), r.conflict, r.outlier_id, r.n_used, r.reset, r["mean"] and round(r["mean"], 9), r["std"] and round(r["std"], 9), round(r.confidence_delta, 9)) for r in df.collect())
    some = df.where("mean is not null")
    assert near(decisions.resolve_conflicts(some, ["k"])) == near(decisions.resolve_conflicts(some, ["k"], block=100)) and decisions.resolve_conflicts(some, ["k"]).where("conflict").count() == 2
