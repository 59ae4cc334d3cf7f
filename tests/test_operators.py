"""Small literal cases and edge cases of the operators."""

from __future__ import annotations

import ast
import math
import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stockops.functions.columns import norm_cdf
from stockops.operators import corpus, evaluation, graph, inventory, orders, quality, retrieval, topology
from stockops.operators import decisions as b
from stockops.plans import catalog

T0 = datetime(2024, 1, 31, 12)
AT = "2024-01-31 12:00:00"
OBS = "id string, observed_at timestamp, device_id string, product_id string, location_id string, observed_qty double, confidence double, is_missing boolean"
DEV = "id string, warehouse_id string, missing_rate double, status string"
MOVE = "id string, product_id string, from_location_id string, to_location_id string, move_type string, qty double, occurred_at timestamp, reason_code string"
LOC = "id string, warehouse_id string, parent_location_id string, code string, type string, capacity_units int"


def ago(**k):
    return T0 - timedelta(**k)


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def near(x, y, eps=1e-5):
    return abs(x - y) < eps


def test_device_health_and_quirk(spark):
    dev = spark.createDataFrame([("d", "w", 0.1, "online"), ("e", "w", 0.1, "active")], DEV)
    obs = spark.createDataFrame([("1", ago(minutes=20), "d", "p", "l", 12.0, 0.9, False), ("2", ago(minutes=10), "d", "p", "l", None, 0.2, True)], OBS)
    got = {r.id: r for r in topology.device_health(dev, obs, AT, 1).collect()}
    assert (got["d"].last_seen, got["d"].n_obs, got["d"].n_missing, got["d"].n_null) == (ago(minutes=10), 2, 1, 1)
    assert near(got["d"].avg_confidence, 0.55)
    assert (got["e"].n_obs, got["e"].n_null) == (0, 1)


def test_device_anomalies(spark):
    dev = spark.createDataFrame([("off", "w", 0.1, "offline"), ("act", "w", 0.1, "active")], DEV)
    obs = spark.createDataFrame([("1", ago(minutes=20), "off", "p", "l", None, 0.9, True), ("2", ago(hours=2), "off", "p", "l", 1.0, 0.9, False)], OBS)
    cand = {r.id: (r.n_obs, r.n_missing, r.observed_missing_rate) for r in topology.device_anomaly_candidates(dev, obs, AT, 1).collect()}
    assert cand == {"off": (1, 1, 1.0), "act": (0, 0, None)}
    got = {r.id: r.anomalies for r in topology.device_anomalies(dev, obs, AT, 1).collect()}
    assert got == {"off": ["offline_with_observations", "missing_rate_spike"], "act": ["online_without_observations"]}


@pytest.mark.parametrize("hours", [0, -1, 721, "24", True])
def test_bad_windows(spark, hours):
    dev, obs = spark.createDataFrame([], DEV), spark.createDataFrame([], OBS)
    with pytest.raises(ValueError):
        topology.device_anomaly_candidates(dev, obs, AT, hours)


def test_adjustments_fan_out(spark):
    loc = spark.createDataFrame([("dock", "w", None, "dock", "dock", 10), ("bin", "w", None, "bin", "bin", 10)], LOC)
    mv = spark.createDataFrame(
        [("t", "p", "dock", "bin", "transfer", 10.0, T0, None), ("a", "p", None, "dock", "adjustment", 3.0, T0, "gain"), ("b", "p", None, "dock", "adjustment", 2.0, T0, "loss"), ("c", "p", "dock", "bin", "adjustment", 1.0, T0, None), ("d", "p", "dock", "dock", "adjustment", 5.0, T0, None)], MOVE
    )
    assert tuple(one(inventory.adjustments_summary(mv, loc))) == (5, 12.0)
    assert tuple(one(inventory.adjustments_summary(mv, loc, distinct_moves=True))) == (4, 11.0)
    assert [tuple(r) for r in inventory.adjustments_by_reason(mv, loc).collect()] == [("gain", 1, 3.0), ("loss", 1, 2.0), (None, 3, 7.0)]
    assert one(inventory.adjustments_summary(mv.where("false"), loc)).n_moves == 0


def test_replay_and_negative_stock(spark):
    rows = [("1", None, "l", 100.0), ("2", "l", None, 30.0), ("3", None, "l", 50.0), ("4", "l", None, 15.0)]
    mv = spark.createDataFrame([(i, "p", f, t, "x", q, T0 + timedelta(minutes=int(i)), None) for i, f, t, q in rows], MOVE)
    bal = spark.createDataFrame([("p", "l", 105.0)], "product_id string, location_id string, on_hand double")
    assert one(inventory.replay_balances(mv, bal)).diff == 0
    assert inventory.negative_stock_violations(mv).isEmpty()
    bad = one(inventory.negative_stock_violations(mv.where("id <> '1'")))
    assert (bad.id, bad.running) == ("2", -30.0)


def test_fcfs_fill(spark):
    lines = spark.createDataFrame([("a", "p", T0, 6.0), ("b", "p", T0, 6.0), ("c", "p", T0, 6.0), ("z", "q", T0, 1.0)], "id string, product_id string, ts timestamp, qty double")
    stock = spark.createDataFrame([("p", 10.0)], "product_id string, stock double")
    got = {r.id: (r.shipped, r.penalty, r.status) for r in inventory.allocate_fcfs(lines, stock).collect()}
    assert got == {"a": (6.0, 0.0, "shipped"), "b": (4.0, 20.0, "shipped"), "c": (0.0, 60.0, "cancelled"), "z": (0.0, 10.0, "cancelled")}


def test_snapshot_ties_and_quality(spark):
    obs = spark.createDataFrame([("1", ago(minutes=30), "d", "p", "l", 20.0, 0.6, False), ("2", ago(minutes=5), "d", "p", "l", 22.0, 0.9, False), ("3", ago(minutes=5), "d", "p", "l", 23.0, 0.9, False), ("4", ago(minutes=5), "d", "p", "l", 24.0, None, False)], OBS)
    bal = spark.createDataFrame([("p", "l", 25.0, 2.0, "damaged")], "product_id string, location_id string, on_hand double, reserved double, quality_status string")
    row = one(inventory.observed_snapshot(obs, bal, ["DAMAGED"], dev_mode=True))
    assert (row.observed_qty, row.on_hand, row.reserved) == (22.0, 25.0, 2.0)
    assert inventory.observed_snapshot(obs, bal, ["expired"]).isEmpty()


def test_utilization(spark):
    loc = spark.createDataFrame([("l", "w", None, "L", "bin", 80), ("m", "w", None, "M", "bin", 0)], LOC)
    obs = spark.createDataFrame([("1", ago(hours=1), "d", "A", "l", 20.0, 0.5, False), ("2", ago(hours=1), "d", "A", "l", 40.0, 1.0, False), ("3", ago(hours=1), "d", "B", "l", 10.0, 1.0, False), ("4", ago(hours=1), "d", "B", "m", 10.0, 0.0, False)], OBS)
    got = {r.location_id: r for r in topology.capacity_utilization(obs, loc, AT, 24).collect()}
    assert near(got["l"].observed_qty, 43.33333) and near(got["l"].avg_confidence, 0.875) and got["l"].n_obs == 3 and near(got["l"].utilization, 0.541667)
    assert got["m"].observed_qty is None and got["m"].utilization is None
    with pytest.raises(ValueError):
        topology.capacity_utilization(obs, loc, AT, 24, AT, AT)


def test_tree_with_outside_parent_and_cycle(spark):
    rows = [("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "x")]
    loc = spark.createDataFrame([(i, "w", p, i, "zone", 1) for i, p in rows], LOC)
    tree = topology.locations_tree(loc)
    assert {r.id: (r.root_id, r.depth) for r in tree.collect()} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0)}
    assert {r.id: r.capacity_units for r in topology.subtree_rollup(tree).collect()} == {"a": 3, "b": 2, "c": 1, "d": 1}


def test_pipeline_and_remaining(spark):
    po = spark.createDataFrame([("1", "s", "w", "submitted", T0 + timedelta(days=4), T0), ("2", "s", "w", "partial", T0 + timedelta(days=2), T0), ("3", "s", "w", "received", T0, T0)], "id string, supplier_id string, destination_warehouse_id string, status string, expected_at timestamp, created_at timestamp")
    ln = spark.createDataFrame([("1", "1", 10.0, 2.0), ("2", "2", 5.0, 2.0), ("3", "3", 5.0, None)], "id string, purchase_order_id string, qty_ordered double, qty_received double")
    rows = orders.procurement_pipeline(po, ln).where("mode = 'both'").collect()
    assert [(r.po_count, r.qty_ordered, r.qty_received, r.remaining) for r in rows] == [(2, 15.0, 4.0, 11.0)]


def test_shipment_flag_has_three_values(spark):
    sh = spark.createDataFrame([("1", ago(hours=1), None), ("2", ago(hours=90), None), ("3", ago(hours=90), ago(hours=89))], "id string, shipped_at timestamp, arrived_at timestamp")
    sh = sh.withColumns({c: F.lit("x") for c in ("origin_warehouse_id", "destination_warehouse_id", "route_id", "status")})
    assert {r.id: r.is_delayed for r in orders.shipment_delays(sh, AT).collect()} == {"1": None, "2": True, "3": False}
    s = one(orders.shipment_delay_summary(sh, AT))
    assert (s.total, s.delivered, s.in_transit, s.delayed, s.avg_transit_hours) == (3, 1, 2, 1, 1.0)


def frame(spark, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns))


def test_belief(spark):
    df = frame(spark, prior_mean=200.0, prior_std=50.0, observed_qty=214.0, bias=3.0, noise_sigma=18.0, confidence=0.61, is_missing=False, status="active")
    r = one(b.belief_update(df))
    assert near(r.gain, 0.885269) and near(r["mean"], 209.737960) and near(r.std, 16.935973)
    lost = one(b.belief_update(df.withColumn("status", F.lit("offline"))))
    assert (lost["mean"], lost.std) == (200.0, 75.0) and near(lost.belief_confidence, 0.183)


def test_belief_sequence_equals_precision_sum(spark):
    rows = [("k", T0 + timedelta(hours=i), str(i), q, 0.0, 2.0, False) for i, q in enumerate([10.0, 14.0, 12.0])]
    df = spark.createDataFrame(rows, "k string, observed_at timestamp, id string, observed_qty double, bias double, noise_sigma double, is_missing boolean")
    r = one(b.belief_sequence(df, ["k"], 8.0, 4.0))
    precision = 1 / 16 + 3 / 4
    assert near(r["mean"], (8 / 16 + 36 / 4) / precision) and near(r.std, math.sqrt(1 / precision))


def test_supplier_posterior_and_quantile(spark):
    r = one(b.beta_posterior(frame(spark, reliability_score=0.82, s_eff=14.3, f_eff=5.1)))
    assert near(r["mean"], 0.765306) and near(r.n_eff, 19.4) and r.evidence == "moderate"
    # integer parameters: the distribution function is a binomial sum
    for a, c, x in ((3, 2, 0.4), (5, 5, 0.7), (1, 4, 0.2)):
        n = a + c - 1
        assert near(b.incomplete_beta(a, c, x), sum(math.comb(n, k) * x**k * (1 - x) ** (n - k) for k in range(a, n + 1)), 1e-9)
        assert near(b.incomplete_beta(a, c, b.beta_quantile(a, c, 0.1)), 0.1, 1e-9)
    assert b.beta_quantile(0.0, 1.0, 0.1) is None


def test_signal(spark):
    r = one(b.signal_reliability(frame(spark, avg_confidence=0.51, observed_missing_rate=0.21, missing_rate=0.06, is_anomaly=True, status="active")))
    assert near(r.reliability, 0.2601) and r.signal == "LOW"


def test_uncertainty(spark):
    r = one(b.uncertainty_index(frame(spark, mean=541.2, std=38.4, days_since_count=20.0, quality_status="good")))
    assert near(r.h_norm, 0.950484) and near(r.uncertainty, 0.720622) and r.uncertainty_class == "HIGH"


def test_leadtime(spark):
    r = one(b.leadtime_risk(frame(spark, p1=7.0, p2=1.5, p_rare_delay=0.12, rare_delay_add_days=8.0, reliability=0.765), 10.0))
    assert near(r.lt_mean, 7.96) and near(r.lt_var, 11.125374) and near(r.p95, 13.4466, 1e-3) and near(r.p99, 15.7195, 1e-3) and near(r.p_late, 0.2704, 1e-4) and r.risk_class == "CRITICAL"


def test_regime(spark):
    r = one(frame(spark, x=1).select(b.regime(F.lit(0.18), F.lit(0.07), F.lit(0.02), F.lit(0.666667), F.lit(90)).alias("r")))
    assert r.r == "ELEVATED_ADJUSTMENTS"


def test_utility_and_voi(spark):
    rows = [("a", 0.96, 400.0, "ELEVATED", 1.0), ("b", 0.70, 3000.0, "ACCEPTABLE", 0.75), ("c", 1.0, 0.0, "ACCEPTABLE", 0.5)]
    df = spark.createDataFrame(rows, "id string, fill_rate double, penalty_exposure double, risk_class string, sla double").withColumn("g", F.lit(1))
    got = {r.id: (r.utility, r["rank"]) for r in b.action_utility(df, ["g"]).collect()}
    assert near(got["a"][0], 0.820286) and near(got["b"][0], 0.6325) and near(got["c"][0], 0.925) and got["c"][1] == 1
    v = one(b.voi_of(frame(spark, eu=0.71, eu_high=0.88, eu_low=0.54)))
    assert near(v.voi, -0.05) and v.decision == "ACT_NOW"


def test_pareto(spark):
    rows = [("A", 0.92, 0.55, 1.0, 1.0), ("B", 0.70, 0.40, 0.60, 0.75), ("C", 0.88, 0.60, 0.60, 0.50), ("E", 0.95, 0.50, 0.60, 0.75)]
    df = spark.createDataFrame([(1, *r, 0.0) for r in rows], "g int, action_id string, f double, p double, l double, s double, score double")
    got = b.pareto_frontier(df, ["g"], ["f", "p", "l", "s"]).collect()
    assert {r.action_id for r in got if not r.dominated} == {"A", "C", "E"} and near(got[0].reduction, 0.25)


def test_ranking_ties(spark):
    df = spark.createDataFrame([(1, "a", 0.8, 0.2, 0.5, 0.9, "FEASIBLE"), (1, "b", 0.78, 0.2, 0.5, 0.9, "FEASIBLE"), (1, "x", 0.99, 0.2, 0.5, 0.9, "INFEASIBLE"), (2, "c", 0.5, 0.2, 0.5, 0.9, "CONDITIONAL")], "g int, action_id string, score double, uncertainty double, sla double, reliability double, feasibility string")
    got = {(r.g, r.action_id): (r["rank"], r.margin, r.margin_class) for r in b.rank_actions(df, ["g"]).collect()}
    assert set(got) == {(1, "a"), (1, "b"), (2, "c")} and got[2, "c"][1:] == (1.0, "HIGH")
    assert near(got[1, "a"][1], 0.02) and got[1, "a"][0] == 1


def test_trigger(spark):
    r = one(b.threshold_trigger(frame(spark, qty=142.0, outbound_30d=840.0, pipeline_qty=200.0, quality_status="ok")))
    assert near(r.demand, 28) and near(r.cover_days, 5.0714, 1e-3) and near(r.safety_stock, 196) and r.trigger == "REORDER_TRIGGER"


def test_confidence_and_deferral(spark):
    sensor = (0.82 + 0.91 + 0.34) / 3
    r = one(b.decision_confidence(frame(spark, sensor=sensor, n_low=1, regime="ELEVATED_ADJUSTMENTS", uncertainty=0.41, margin=0.13, margin_class="HIGH", trigger="NORMAL")))
    assert near(r.decision_confidence, 0.5695) and r.confidence_class == "ADEQUATE"
    d = one(b.deferral(frame(spark, voi=0.03, confidence_class="LOW_CONFIDENCE", uncertainty=0.61, n_deferrals=1, trigger="NORMAL")))
    assert (d.deferral, d.wait_hours, d.n_deferrals_after) == ("DEFER", 30, 2)


def test_conflict(spark):
    df = spark.createDataFrame([("k", "1", 140.0, 18.0, 0.88, 210.0, 35.0), ("k", "2", 320.0, 25.0, 0.41, 210.0, 35.0)], "k string, signal_id string, mean double, std double, reliability double, base_mean double, base_std double")
    r = one(b.resolve_conflicts(df, ["k"]))
    assert near(r["mean"], 197.2093, 1e-3) and near(r.std, 83.8139, 1e-3) and r.outlier_id == "2" and near(r.severity, 1.465, 1e-3) and near(r.confidence_delta, -0.10)


def test_severity_and_cdf(spark):
    r = one(b.discrepancy_severity(frame(spark, expected=1000.0, observed=950.0, sigma=15.0)))
    assert near(r.shrinkage_pct, 5) and near(r.z, 3.3333, 1e-3) and near(r.p_value, 0.000858, 1e-5) and r.significant
    zs = [-3.0, -0.5, 0.0, 1.0, 2.5]
    got = [x.p for x in spark.createDataFrame([(z,) for z in zs], "z double").select(norm_cdf(F.col("z")).alias("p")).collect()]
    assert all(near(p, 0.5 * (1 + math.erf(z / math.sqrt(2))), 1e-7) for z, p in zip(zs, got, strict=True))


def test_headings(spark):
    text = "# 1 INTRODUCTION\nx\n## 1.2 Probability Theory\ny\n### 2.1.3 Advanced Optimization\nz\n# 3 NEXT\nw"
    lines = corpus.lines_of(spark.createDataFrame([("d", 0, 0, text)], "doc_id string, page_num int, block_id int, block_content string"))
    got = {r.line: (r.section_number, r.subsection_number, r.subsubsection_number) for r in corpus.heading_carry(lines).collect()}
    assert got["x"] == ("1", None, None) and got["y"] == ("1", "1.2", None) and got["z"] == ("1", "1.2", "2.1.3") and got["w"] == ("3", None, None)


def test_references_and_ids(spark):
    r = one(corpus.extract_references(frame(spark, content="Refer to Example 1.1, Exercise 4.2 and Equation (5.6).")))
    assert (r.referenced_examples, r.referenced_exercises, r.referenced_formulas) == (["1.1"], ["4.2"], ["5.6"])
    got = one(graph.deterministic_uuid(frame(spark, chunk_id="c", entity_id="1.1", chunk_type="algorithm", content="x"))).uuid
    assert got == "631f8d97-ad58-51d0-8dc4-943d091cb0db" == str(uuid.uuid5(uuid.NAMESPACE_DNS, "1.1:algorithm"))


BLOCK = "doc_id string, page_num int, block_id int, block_label string, block_content string, block_bbox array<double>"


def test_formula_numbers_and_html(spark):
    rows = [("d", 0, 1, "formula", "E=mc", [100.0, 100.0, 200.0, 120.0]), ("d", 0, 2, "formula_number", "(1.1)", [500.0, 100.0, 550.0, 120.0]), ("d", 0, 3, "formula", "far", [100.0, 400.0, 200.0, 420.0])]
    r = one(corpus.match_formula_numbers(spark.createDataFrame(rows, BLOCK)))
    assert (r.entity_id, r.content) == ("1.1", "E=mc")
    html = one(frame(spark, h='<table style="a:b" border=1 id=\'x\'><td colspan="2" class=c>a &lt; b</td></table>').select(corpus.clean_html(F.col("h")).alias("x"))).x
    assert html == '<table><td colspan="2">a &lt; b</td></table>'


def test_clean_html_leaves_text_that_looks_like_an_attribute(spark):
    pages = ["<title lang=en>key token = &quot;0b96</title>", "a b = c<p  class=x>d e=f</p >\n<td\tid = 'q r'  HREF=\"u\">", "", "no tags a=b", None, "<a title='x<y' class=c>"]
    got = frame(spark, n=1).select(F.explode(F.array(*[F.lit(p) for p in pages])).alias("h")).select(corpus.clean_html(F.col("h")).alias("x")).collect()
    assert [r.x for r in got] == ["<title>key token = &quot;0b96</title>", "a b = c<p>d e=f</p >\n<td  HREF=\"u\">", "", "no tags a=b", None, "<a title='x<y'>"]


def test_chunks_split_and_are_stable(spark):
    rows = [("d", 0, i, "text", t, [0.0, float(i), 10.0, float(i) + 1]) for i, t in enumerate(["# 1 A", "a" * 600, "b" * 600, "Exercise 1.2 do", "more", "", "# 2 B", "end"])]
    df = spark.createDataFrame(rows, BLOCK)
    got = [(r.seq, r.chunk_type, r.entity_id, len(r.content)) for r in corpus.chunk_text(df).orderBy("seq").collect()]
    assert got == [(0, "text", None, 606), (1, "text", None, 600), (2, "exercise", "1.2", 20), (3, "text", None, 9)]
    again = [(r.seq, r.chunk_type, r.entity_id, len(r.content)) for r in corpus.chunk_text(df.repartition(3)).orderBy("seq").collect()]
    assert again == got
    assert corpus.chunk_text(df.where("false")).isEmpty()


def test_note_repair(spark):
    rows = [("d", 0, 1, "text", "body\n$ ^{1} $ the note", [0.0] * 4), ("d", 0, 2, "footnote", "", [0.0] * 4), ("d", 0, 3, "footnote", "", [0.0] * 4)]
    got = {r.block_id: r.block_content for r in corpus.repair_note_splits(spark.createDataFrame(rows, BLOCK)).collect()}
    assert got == {1: "body", 2: "$ ^{1} $ the note", 3: ""}


def test_boost_and_dedupe(spark):
    hits = spark.createDataFrame([(1, 1, 0.8, ["x"], ["q"], "low"), (1, 2, 0.8, ["A"], [], "mid"), (1, 3, 0.8, ["A", "B"], [], "high")], "query_id int, rank int, similarity double, bc_concepts array<string>, bc_db_tables array<string>, name string")
    got = [(r.name, r.similarity) for r in retrieval.tag_boost(hits, ["A", "B"], [], 3).orderBy("rank").collect()]
    assert got == [("high", 1.0), ("mid", 0.9), ("low", 0.8)]
    rows = spark.createDataFrame([(1, "doc-1", 1), (1, "doc-1", 2), (1, "doc-2", 3), (1, None, 4), (1, None, 5)], "query_id int, chunk_id string, position int")
    assert [r.chunk_id for r in retrieval.dedupe_first_seen(rows).orderBy("position").collect()] == ["doc-1", "doc-2", None, None]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, [2.0, 0.0]), (6, None)], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = [(r.vec_id, round(r.similarity, 4)) for r in retrieval.vector_topk(v, q, 3).orderBy("rank").collect()]
    assert got == [(1, 1.0), (5, 1.0), (3, 0.7071)]
    assert retrieval.vector_topk(v, q.where("false"), 3).isEmpty() and retrieval.vector_topk(v.where("false"), q, 3).isEmpty()


def test_metrics(spark):
    res = spark.createDataFrame([("q", "a", 1), ("q", "b", 2), ("q", "b", 3), ("r", "z", 1)], "query_id string, chunk_id string, rank int")
    exp = spark.createDataFrame([("q", "b"), ("q", "c"), ("r", "y")], "query_id string, chunk_id string")
    got = {r.query_id: (r.recall, r.precision, r.mrr) for r in evaluation.retrieval_metrics(res, exp, 10).collect()}
    assert got == {"q": (0.5, 0.1, 0.5), "r": (0.0, 0.0, 0.0)}


def test_code_graph(spark):
    code = "class A:\n    def m(self):\n        return self.n()\n    def n(self):\n        return helper(A())\n\ndef helper(x):\n    return x.unique()\n\nclass B:\n    def unique(self):\n        pass\n"
    ent = graph.code_entities(spark.createDataFrame([("f", code), ("bad", "def (:"), ("none", None)], "fragment_id string, code string"))
    assert {(r.kind, r.name) for r in ent.where("kind <> 'call'").collect()} == {("class", "A"), ("class", "B"), ("method", "A.m"), ("method", "A.n"), ("method", "B.unique"), ("function", "helper")}
    calls = graph.call_graph(ent)
    assert {(r.caller, r.callee) for r in calls.collect()} == {("A.m", "A.n"), ("A.n", "helper"), ("A.n", "A"), ("helper", "B.unique")}
    roots = spark.createDataFrame([("A.m", "A.m")], "root string, name string")
    depth = {r.name: r.depth for r in graph.code_closure(roots, calls).collect()}
    assert depth == {"A.m": 0, "A.n": 1, "helper": 2, "A": 2, "B.unique": 3}
    assert ast.parse(code)


def test_code_snippets(spark):
    text = "```python\nimport os\nx = 1\n```\n```python\nimport os\nx =  1\n```\n```py\nx = (\n```\n```\nfunction f(x)\nend\n```"
    got = [(r.language, r.is_valid, r.dependencies) for r in evaluation.extract_code(frame(spark, k="a", t=text), "k", "t").orderBy("position").collect()]
    assert got == [("python", True, ["os"]), ("text", False, []), ("julia", False, [])]


def test_code_query_reads_whole_texts(spark, tmp_path):
    """A fence that stands late in a document, and a document without text."""
    late = "word " * 200 + "\n```python\nimport json\ny = 2\n```\n"
    spark.createDataFrame([(7, late), (8, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()["e10_extract_code"](spark, str(tmp_path)).collect()
    assert {r.position for r in rows if r.dependencies == "json"} == {0}
    assert [sum(str(r.doc_id) == k for r in rows) for k in "78"] == [4, 3]


def test_quality_rules(spark):
    df = spark.createDataFrame([("1", -1.0, "ok"), ("2", None, "BAD"), ("3", 2.0, "OK")], "id string, qty double, status string")
    got = {r.rule: (r.n_rows, r.first_id) for r in quality.check_violations(df, {"qty": quality.not_negative("qty"), "status": quality.outside_domain("status", ["ok"])}).collect()}
    assert got == {"qty": (1, "1"), "status": (1, "2")}


def test_tree_of_any_depth(spark):
    """A chain of 1000 levels, siblings, an unknown parent, and cycles, which have no root."""
    rows = [(f"n{i}", f"n{i - 1}" if i else None, f"c{i}", 1) for i in range(1000)]
    rows += [("s1", "n10", "s", 5), ("s2", "n10", "s", 5), ("lost", "nowhere", "l", 7), ("x", "y", "x", 1), ("y", "x", "y", 1), ("z", "y", "z", 1)]
    tree = topology.locations_tree(spark.createDataFrame(rows, "id string, parent_location_id string, code string, capacity_units int"), paths=True)
    got = {r.id: (r.root_id, r.depth, len(r.path)) for r in tree.collect()}
    assert got == {f"n{i}": ("n0", i, i + 1) for i in range(1000)} | {"s1": ("n0", 11, 12), "s2": ("n0", 11, 12), "lost": ("lost", 0, 1)}
    up = {r.id: (r.capacity_units, r.n_nodes) for r in topology.subtree_rollup(tree).collect()}
    assert up["n0"] == (1010, 1002) and up["n999"] == (1, 1) and up["n10"] == (1000, 992)


def test_usage_index_shuffles_names_once(spark):
    blocks = spark.createDataFrame([("a", "def f(x):\n    return g(x, x)"), ("a", "f(1)"), ("b", "y = f(2)\nf(f(3))\n  struct g"), ("c", None), ("d", "g")], "block_id string, code string")
    declared = spark.createDataFrame([("f", "a"), ("f", "a"), ("g", "d")], "name string, block_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = graph.usage_index(blocks, declared)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, df.collect())) == [("f", "a", "b"), ("g", "d", "a")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    # names in use meet the declared ones, and only what is found is made distinct
    scan = plan.index("Generate explode")
    assert plan[:scan].count("HashAggregate(keys=[block_id") + plan[scan:].count("HashAggregate(keys=[block_id") == 0


def test_balances_are_summed_for_observed_keys_only(spark, monkeypatch):
    facts = spark.createDataFrame([(f"P{i % 50}", f"N{i % 7}" if i % 11 else None, float(i)) for i in range(2000)], "product_id string, location_id string, delta double")
    balances = facts.groupBy("product_id", "location_id").agg(F.sum("delta").alias("on_hand"), F.lit(0.0).alias("reserved"), F.min(F.lit("ok")).alias("quality_status"))
    seen = [("a", "P1", "N1", 4.0), ("b", "P1", "N1", 8.0), ("c", "P3", "N2", 1.0), ("d", "P9", "N99", 1.0), ("e", None, "N1", 1.0), ("f", "P1", None, 1.0), ("g", "P99", "N1", 1.0)]
    observations = spark.createDataFrame([(*r, 1.0, False) for r in seen], "id string, product_id string, location_id string, observed_qty double, confidence double, is_missing boolean").withColumn("observed_at", F.timestamp_seconds(F.ascii("id")))
    products = spark.createDataFrame([(f"P{i}", f"S{i}") for i in range(50)], "id string, sku string")
    locations = spark.createDataFrame([(f"N{i}", "W1") for i in range(7)], "id string, warehouse_id string")
    run = lambda: (inventory.observation_vs_balance(observations, balances, products, locations, limit=None), inventory.observed_snapshot(observations, balances, dev_mode=True))
    compared, snapshot = run()
    for df in (compared, snapshot):
        plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        summed = next(k for k, line in enumerate(plan) if "Aggregate" in line)
        assert any("LeftSemi" in line for line in plan[summed:])
    stock = {(r.product_id, r.location_id): r.on_hand for r in balances.collect()}
    assert {(r.product_id, r.location_id): (r.estimate, r.on_hand) for r in compared.collect()} == {("P1", "N1"): (6.0, stock["P1", "N1"]), ("P3", "N2"): (1.0, stock["P3", "N2"])}
    assert {(r.id, r.on_hand) for r in snapshot.collect()} == {("b", stock["P1", "N1"]), ("c", stock["P3", "N2"])}
    # too many keys to be broadcast: the same rows
    monkeypatch.setattr(inventory, "of_keys", lambda df, keys: df)
    for former, plain in zip((compared, snapshot), run(), strict=True):
        assert sorted(former.collect(), key=str) == sorted(plain.collect(), key=str)
