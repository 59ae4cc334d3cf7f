from __future__ import annotations

from datetime import datetime, timedelta

import pytest

from stockops.operators import graph
from stockops.sources import files
from stockops.streaming import twins

OBS = "event_id long, observed_at timestamp, device_id string, product_id string, location_id string, observed_qty double, confidence double, is_missing boolean"
T0 = datetime(2024, 1, 1)


def observations(spark):
    rows = []
    for i in range(200):
        missing = i % 9 == 0
        rows.append((i, T0 + timedelta(hours=(i * 7) % 90, minutes=i % 3), f"d{i % 5}", f"p{i % 4}", f"l{i % 3}", None if missing else float(i), None if i % 11 == 0 else (i % 10) / 10, missing))
    rows.append((500, rows[5][1], "d1", rows[5][3], rows[5][4], 1.0, rows[5][6], False))  # a full tie but for the id
    return spark.createDataFrame(rows, OBS)


def rows_of(df):
    # a mean of doubles depends on their order
    return sorted(str(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in df.collect())


KEYS = {"stream_latest_snapshot": ["product_id", "location_id"], "stream_device_health": ["window_start", "device_id"]}


def run(spark, path, twin, tmp_path, delay="10 days", name="out"):
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(path)
    return twins.run_to_table(twin(stream, delay), KEYS[twin.__name__], f"{tmp_path}/{twin.__name__}-{name}")


def test_streams_equal_batches(spark, tmp_path):
    obs = observations(spark)
    obs.repartition(4).write.parquet(f"{tmp_path}/obs")
    for twin in (twins.stream_latest_snapshot, twins.stream_device_health):
        assert rows_of(run(spark, f"{tmp_path}/obs", twin, tmp_path)) == rows_of(twin(obs))


def test_panes_of_a_stream_give_the_windows(spark, tmp_path):
    """State holds one row a device and hour, not one for each window over it."""
    obs = observations(spark)
    obs.repartition(4).write.parquet(f"{tmp_path}/obs")
    stream = spark.readStream.schema(OBS).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/obs")
    panes = twins.run_to_table(twins.stream_device_panes(stream, "10 days"), ["pane_start", "device_id"], f"{tmp_path}/panes")
    assert panes.count() == obs.selectExpr("date_trunc('hour', observed_at)", "device_id").distinct().count()
    assert rows_of(twins.windows_of_panes(panes)) == rows_of(twins.stream_device_health(obs))


def test_rows_past_the_watermark_are_dropped(spark, tmp_path):
    early, late = observations(spark).where("event_id = 1"), observations(spark).where("event_id = 12")
    for k, rows in enumerate((late, late, early)):
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/obs")
        run(spark, f"{tmp_path}/obs", twins.stream_device_health, tmp_path, "1 minute", "late")
    got = run(spark, f"{tmp_path}/obs", twins.stream_device_health, tmp_path, "1 minute", "late")
    assert {r.device_id for r in got.collect()} == {"d2"} and early.first().device_id == "d1"


def test_jsonl_skips_bad_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"id": "a", "n": 1}\n{broken\n{"id": "b", "n": 2}\n')
    df = files.read_jsonl(spark, f"file://{tmp_path}/log.jsonl", "id string, n int")
    assert sorted(tuple(r) for r in df.collect()) == [("a", 1), ("b", 2)]
    files.append_jsonl(df, f"file://{tmp_path}/out")
    files.append_jsonl(df.where("n = 1"), f"file://{tmp_path}/out")
    assert files.read_jsonl(spark, f"file://{tmp_path}/out", "id string, n int").count() == 3


def test_json_corpus_and_upsert(spark, tmp_path):
    (tmp_path / "c.json").write_text('[{"chunk_id": "x", "tags": ["A"]},\n {"chunk_id": "y"}]')
    df = files.read_json_corpus(spark, f"file://{tmp_path}/c.json", "chunk_id string, tags array<string>")
    assert {r.chunk_id: r.tags for r in df.collect()} == {"x": ["A"], "y": None}
    changes = spark.createDataFrame([("y", ["B"]), ("z", None)], "chunk_id string, tags array<string>")
    files.upsert_parquet(df, changes, ["chunk_id"], f"file://{tmp_path}/merged")
    got = {r.chunk_id: r.tags for r in spark.read.parquet(f"file://{tmp_path}/merged").collect()}
    assert got == {"x": ["A"], "y": ["B"], "z": None}


def test_scenarios(spark):
    rows = [{"id": "s1", "category": "c", "difficulty": "easy", "query": "q", "expected_output": {"must_include": {"formula": True}}}, {"id": "s2"}]
    got = {r.scenario_id: r.has_expected for r in files.scenarios(spark, rows).collect()}
    assert got == {"s1": True, "s2": False}


def test_yaml_scenarios_are_read_where_they_lie(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.yaml").write_text("id: s1\ncategory: stock\nquery: how much?\nexpected_output:\n  must_include: {formula: true}\n---\nid: 2\n")
    (tmp_path / "deep" / "b.yml").write_text("scenarios:\n- id: s3\n  difficulty: hard\n- {name: nobody}\n- plain\n")
    (tmp_path / "broken.yaml").write_text("a: [1, 2\nb: }")
    (tmp_path / "empty.yaml").write_text("")
    (tmp_path / "other.txt").write_text("id: no\n")
    (tmp_path / "long.yaml").write_text("id: long\nquery: " + "x" * 5_000)
    rows = files.read_scenarios(spark, f"file://{tmp_path}", max_file_bytes=4_000).collect()
    good = {r.scenario_id: (r.category, r.difficulty, r.query, r.expected, r.has_expected) for r in rows if r.error is None}
    assert good == {"s1": ("stock", None, "how much?", '{"must_include": {"formula": true}}', True), "2": (None, None, None, "{}", False), "s3": (None, "hard", None, "{}", False)}
    assert sorted((r.path.rsplit("/", 1)[1], r.position, r.error) for r in rows if r.error) == [("b.yml", 1, "no record with an id"), ("b.yml", 2, "no record with an id"), ("broken.yaml", 0, "not YAML: ParserError"), ("long.yaml", 0, "too long")]


def test_database_is_read_in_ranges(spark):
    """The database that comes with Spark, in memory: bounds deal rows out and drop none."""
    url = "jdbc:derby:memory:stock;create=true"
    rows = spark.range(100).selectExpr("id AS n", "concat('x', id) AS name")
    rows.write.format("jdbc").option("url", url).option("dbtable", "things").option("driver", "org.apache.derby.iapi.jdbc.AutoloadedDriver").save()
    df = files.read_database(spark, url, "things", "n", 10, 60, 4, driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    assert df.rdd.getNumPartitions() == 4
    assert sorted(r.name for r in df.collect()) == sorted(f"x{i}" for i in range(100))


def test_objects_are_inserted_and_replaced_by_key(spark, tmp_path):
    path = f"file://{tmp_path}/objects"
    make = lambda rows: spark.createDataFrame(rows, "uuid string, content string, links array<string>")
    read = lambda: {r.uuid: (r.content, r.links) for r in spark.read.parquet(path).collect()}
    files.upsert_objects(make([(f"u{i}", f"a{i}", None) for i in range(20)]), path, buckets=4)
    files.upsert_objects(make([("u3", "b3", ["u4"]), ("new", "c", []), ("new", "c", [])]), path, buckets=4)
    assert read() == {f"u{i}": (f"a{i}", None) for i in range(20) if i != 3} | {"u3": ("b3", ["u4"]), "new": ("c", [])}
    before = {p.name for p in (tmp_path / "objects").glob("bucket=*/*.parquet")}
    files.upsert_objects(make([("u3", "d3", None)]), path, buckets=4)
    after = {p.name for p in (tmp_path / "objects").glob("bucket=*/*.parquet")}
    assert read()["u3"] == ("d3", None) and len(read()) == 21 and before & after  # other buckets stay as they are


def test_chunks_become_objects_with_links(spark):
    fields = "chunk_id string, load_order long, chunk_type string, entity_id string, content string, " + ", ".join(f"{f} array<string>" for f in graph.TARGETS)
    blank = [None] * len(graph.TARGETS)
    field, kind = next(iter(graph.TARGETS.items()))
    rows = [("a", 1, "text", None, "see 1.2 and 9.9", ["1.2", "9.9"], *blank[1:]), ("b", 2, kind, "1.2", "it", *blank)]
    got = {r.chunk_id: r for r in graph.chunk_objects(spark.createDataFrame(rows, fields), spark.createDataFrame([("b", [0.5])], "chunk_id string, embedding array<double>")).collect()}
    assert got["a"].embedding is None and got["b"].embedding == [0.5] and got["b"].links == []
    assert [(x.field, x.target) for x in got["a"].links] == [(field, got["b"].uuid)]


def test_purchase_orders_are_distinct_before_the_joins(spark):
    """Rows of a plain DISTINCT over the join, whatever repeats; no aggregate over the wide rows."""
    from stockops.sources import logical

    tables = {
        "orders": "VALUES (1, 'F', '1995-01-01'), (1, 'F', '1995-01-01'), (1, 'O', '1995-01-01'), (2, 'P', '1996-01-01'), (3, 'O', '1996-02-01'), (3, 'X', '1996-02-01'), (4, CAST(NULL AS STRING), CAST(NULL AS STRING)) AS t(o_orderkey, o_orderstatus, o_orderdate)",
        "lineitem": "VALUES (1, 7), (1, 7), (1, 8), (2, 8), (3, 7), (4, 9), (5, 7), (1, NULL) AS t(l_orderkey, l_suppkey)",
        "supplier": "VALUES (7, 3), (7, 3), (7, 4), (8, 5), (9, 6) AS t(s_suppkey, s_nationkey)",
    }
    given = {n: spark.sql(f"SELECT * FROM {v}") for n, v in tables.items()}
    df = spark.sql(logical.TABLES["purchase_orders"](logical.Dialect(spark=True)), **given)

    class Plain(logical.Dialect):
        """Spark's spelling with the oracle's statement."""

        def hours(self, ts, n):
            return f"timestampadd(HOUR, CAST({n} AS INT), {ts})"

    want = spark.sql(logical.TABLES["purchase_orders"](Plain(spark=False)), **given)
    assert df.columns == want.columns and sorted(map(str, df.collect())) == sorted(map(str, want.collect())) and df.count() > 6
    assert "Aggregate [id" not in df._jdf.queryExecution().optimizedPlan().toString()
