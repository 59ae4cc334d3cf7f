"""Queries of the decision analytics, over every product and location at once."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions.durable import written
from ..operators import decisions as b
from ..operators import inventory as inv
from ..operators import topology as top
from .registry import AS_OF, EVENTS_AS_OF, joined, query, r6
from .relational import LATEST, health

BELIEF_NEEDS = ["observations", "balances", "devices"]
BELIEF = f""", {LATEST},
readings AS (SELECT l.id, l.product_id, l.location_id, l.device_id, observed_qty, confidence, is_missing, bias, noise_sigma, d.status, on_hand AS prior_mean, 10 + 0.1 * on_hand AS prior_std, quality_status, last_count_at, reserved
  FROM latest l JOIN balances b ON b.product_id = l.product_id AND b.location_id = l.location_id JOIN devices d ON d.id = l.device_id),
flagged AS (SELECT *, is_missing OR observed_qty IS NULL OR status = 'offline' AS lost, CASE WHEN noise_sigma = 0 THEN 1 ELSE prior_std * prior_std / (prior_std * prior_std + noise_sigma * noise_sigma) END AS k FROM readings),
belief AS (SELECT *, CASE WHEN lost THEN 0 ELSE k END AS gain, CASE WHEN lost THEN prior_mean ELSE greatest(0, prior_mean + k * (observed_qty - bias - prior_mean)) END AS mean,
  CASE WHEN lost THEN prior_std * 1.5 ELSE sqrt((1 - k) * prior_std * prior_std) END AS std, CASE WHEN lost THEN confidence * 0.3 ELSE confidence END AS belief_confidence FROM flagged)"""


def belief(t):
    seen = inv.observed_snapshot(t.observations, t.balances, dev_mode=True)
    dev = t.devices.select(F.col("id").alias("device_id"), "bias", "noise_sigma", "status")
    last = t.balances.select("product_id", "location_id", "last_count_at")
    df = seen.join(dev, "device_id").join(last, ["product_id", "location_id"])
    return b.belief_update(df.withColumn("prior_mean", F.col("on_hand")).withColumn("prior_std", 10 + 0.1 * F.col("on_hand")))


@query("b1_belief_update", BELIEF_NEEDS, BELIEF + " SELECT product_id, location_id, round(gain, 6) AS gain, round(mean, 6) AS mean, round(std, 6) AS std, round(belief_confidence, 6) AS belief_confidence FROM belief")
def b1(t):
    return belief(t).select("product_id", "location_id", r6("gain"), r6("mean"), r6("std"), r6("belief_confidence"))


@query("b2_belief_sequence", ["observations", "devices"], """
, z AS (SELECT product_id, location_id, observed_at, o.id, observed_qty - bias AS z, noise_sigma * noise_sigma AS vs, is_missing OR observed_qty IS NULL AS lost, row_number() OVER (PARTITION BY product_id, location_id ORDER BY observed_at, o.id) AS rn FROM observations o JOIN devices d ON d.id = o.device_id),
fold AS (SELECT product_id, location_id, CAST(0 AS BIGINT) AS rn, CAST(20 AS DOUBLE) AS m, CAST(400 AS DOUBLE) AS v FROM z GROUP BY product_id, location_id
  UNION ALL SELECT f.product_id, f.location_id, z.rn, CASE WHEN lost THEN m ELSE greatest(0, m + v / (v + vs) * (z - m)) END, CASE WHEN lost THEN v * 2.25 ELSE (1 - v / (v + vs)) * v END FROM fold f JOIN z ON z.product_id = f.product_id AND z.location_id = f.location_id AND z.rn = f.rn + 1)
SELECT product_id, location_id, max(rn) AS n_readings, round(arg_max(m, rn), 6) AS mean, round(sqrt(arg_max(v, rn)), 6) AS std FROM fold GROUP BY product_id, location_id""")
def b2(t):
    dev = t.devices.select(F.col("id").alias("device_id"), "bias", "noise_sigma")
    df = b.belief_sequence(t.observations.join(dev, "device_id"), ["product_id", "location_id"], 20.0, 20.0)
    return df.select("product_id", "location_id", F.col("n_readings").cast("long").alias("n_readings"), r6("mean"), r6("std"))


NOW = f"TIMESTAMP '{AS_OF}'"
EVIDENCE = f"""
, done AS (SELECT supplier_id, exp(-0.05 * greatest(0, (epoch_us({NOW}) - epoch_us(arrived_at)) / 8.64e10)) AS w, arrived_at <= expected_at AS ok FROM purchase_orders WHERE arrived_at IS NOT NULL AND expected_at IS NOT NULL AND arrived_at <= {NOW}),
ev AS (SELECT supplier_id, sum(CASE WHEN ok THEN w ELSE 0 END) AS s, sum(CASE WHEN ok THEN 0 ELSE w END) AS f FROM done GROUP BY supplier_id),
beta AS (SELECT id AS supplier_id, 10 * reliability_score + coalesce(s, 0) AS alpha, 10 * (1 - reliability_score) + coalesce(f, 0) AS beta, coalesce(s, 0) + coalesce(f, 0) AS n_eff FROM suppliers LEFT JOIN ev ON ev.supplier_id = id),
rel AS (SELECT *, alpha / nullif(alpha + beta, 0) AS mean, CASE WHEN n_eff >= 20 THEN 'strong' WHEN n_eff >= 5 THEN 'moderate' ELSE 'weak' END AS evidence FROM beta)"""


def evidence(t):
    return b.supplier_evidence(t.purchase_orders, t.suppliers, F.lit(AS_OF).cast("timestamp"))


@query("b3_supplier_evidence", ["purchase_orders", "suppliers"], EVIDENCE + " SELECT supplier_id, round(alpha, 6) AS alpha, round(beta, 6) AS beta, round(mean, 6) AS mean, round(n_eff, 6) AS n_eff, evidence FROM rel")
def b3(t):
    return evidence(t).select("supplier_id", r6("alpha"), r6("beta"), r6("mean"), r6("n_eff"), "evidence")


@query("b3_supplier_reliability", ["purchase_orders", "suppliers"])
def b3q(t):
    return b.supplier_reliability(t.purchase_orders, t.suppliers, F.lit(AS_OF).cast("timestamp")).select("supplier_id", r6("mean"), r6("low_quantile"), "evidence")


SIGNAL = health(168) + """
, x AS (SELECT *, n_missing * 1.0 / nullif(n_obs, 0) AS rate FROM h),
sig AS (SELECT id, warehouse_id, CASE WHEN status = 'offline' THEN 0 ELSE coalesce(avg_confidence * (1 - greatest(0, coalesce(rate, 0) - missing_rate)) *
  CASE WHEN (status = 'offline' AND n_obs > 0) OR (status <> 'offline' AND n_obs = 0) OR rate > missing_rate OR round(avg_confidence, 9) < 0.5 THEN 0.6 ELSE 1.0 END, 0) END AS reliability FROM x),
sigc AS (SELECT *, CASE WHEN reliability >= 0.8 THEN 'HIGH' WHEN reliability >= 0.5 THEN 'MEDIUM' ELSE 'LOW' END AS signal FROM sig)"""


def signals(t):
    rates = top.device_anomaly_candidates(t.devices, t.observations, EVENTS_AS_OF, 168)
    odd = top.device_anomalies(t.devices, t.observations, EVENTS_AS_OF, 168).select("id", F.lit(True).alias("is_anomaly"))
    return b.signal_reliability(rates.join(odd, "id", "left").withColumn("is_anomaly", F.coalesce("is_anomaly", F.lit(False))))


@query("b4_signal_reliability", ["devices", "observations"], SIGNAL + " SELECT id, round(reliability, 6) AS reliability, signal FROM sigc")
def b4(t):
    return signals(t).select("id", r6("reliability"), "signal")


@query("b4_signal_rollup", ["devices", "observations"], SIGNAL + " SELECT warehouse_id, count(*) AS n_devices, CAST(count(*) FILTER (signal = 'LOW') AS BIGINT) AS n_low, count(*) FILTER (signal = 'LOW') = 0 AS trustworthy FROM sigc GROUP BY warehouse_id")
def b4r(t):
    return b.signal_rollup(signals(t))


SPAN = repr(0.5 * math.log(2 * math.pi * math.e * 2500))
TPE = repr(2 * math.pi * math.e)
UNCERTAIN = BELIEF + f""",
aged AS (SELECT *, floor(greatest(0, (epoch_us({NOW}) - epoch_us(last_count_at)) / 8.64e10)) AS days, std / greatest(mean, 1) AS cv, least(1, greatest(0, 0.5 * ln({TPE} * greatest(std, 0.01) * greatest(std, 0.01)) / {SPAN})) AS h_norm FROM belief),
unc AS (SELECT *, least(1, 0.5 * cv + 0.3 * h_norm + least(0.02 * days, 0.5) + CASE WHEN quality_status = 'ok' THEN 0 ELSE 0.2 END) AS uncertainty FROM aged),
uncc AS (SELECT *, CASE WHEN uncertainty < 0.1 THEN 'CERTAIN' WHEN uncertainty < 0.3 THEN 'LOW' WHEN uncertainty < 0.6 THEN 'MODERATE' ELSE 'HIGH' END AS uncertainty_class FROM unc)"""


def uncertain(t):
    days = F.floor(F.greatest(F.lit(0.0), b.days_between(F.col("last_count_at"), F.lit(AS_OF).cast("timestamp")))).cast("double")
    return b.uncertainty_index(belief(t).withColumn("days_since_count", days))


@query("b5_uncertainty_index", BELIEF_NEEDS, UNCERTAIN + " SELECT product_id, location_id, round(cv, 6) AS cv, round(h_norm, 6) AS h_norm, round(uncertainty, 6) AS uncertainty, uncertainty_class FROM uncc")
def b5(t):
    return uncertain(t).select("product_id", "location_id", r6("cv"), r6("h_norm"), r6("uncertainty"), "uncertainty_class")


def cdf_sql(z: str) -> str:
    a = f"abs({z})"
    k = f"(1 / (1 + 0.2316419 * {a}))"
    poly = f"{k} * (0.319381530 + {k} * (-0.356563782 + {k} * (1.781477937 + {k} * (-1.821255978 + {k} * 1.330274429))))"
    tail = f"(exp(-{a} * {a} / 2) / {math.sqrt(2 * math.pi)!r} * {poly})"
    return f"(CASE WHEN {z} >= 0 THEN 1 - {tail} ELSE {tail} END)"


RISK_NEEDS = ["purchase_orders", "suppliers", "leadtime_models"]
RISK = EVIDENCE + f""",
glb AS (SELECT p1, p2, p_rare_delay, rare_delay_add_days FROM leadtime_models WHERE scope = 'global'),
lt AS (SELECT p.id, p.supplier_id, p.destination_warehouse_id, coalesce(m.p1, g.p1) AS p1, coalesce(m.p2, g.p2) AS p2, coalesce(m.p_rare_delay, g.p_rare_delay) AS pr, coalesce(m.rare_delay_add_days, g.rare_delay_add_days) AS ad, coalesce(rel.mean, 0.5) AS reliability
  FROM purchase_orders p LEFT JOIN leadtime_models m ON m.id = p.leadtime_model_id CROSS JOIN glb g LEFT JOIN rel ON rel.supplier_id = p.supplier_id),
mom AS (SELECT *, p1 + pr * ad AS lt_mean, sqrt((p2 * p2 + pr * (1 - pr) * ad * ad) * (1 + (1 - reliability))) AS lt_std FROM lt),
late AS (SELECT *, 1 - {cdf_sql("((12 - lt_mean) / lt_std)")} AS p_late FROM mom),
risk AS (SELECT *, CASE WHEN p_late < 0.05 THEN 'ACCEPTABLE' WHEN p_late < 0.2 THEN 'ELEVATED' ELSE 'CRITICAL' END AS risk_class FROM late)"""


def risk(t):
    return b.po_leadtime_risk(t.purchase_orders.select("id", "supplier_id", "destination_warehouse_id", "leadtime_model_id"), t.leadtime_models, evidence(t), 12.0)


@query("b6_leadtime_risk", RISK_NEEDS, RISK + " SELECT id, round(lt_mean, 6) AS lt_mean, round(lt_std, 6) AS lt_std, round(lt_mean + 1.6449 * lt_std, 6) AS p95, round(lt_mean + 2.3263 * lt_std, 6) AS p99, round(p_late, 6) AS p_late, risk_class FROM risk")
def b6(t):
    return risk(t).select("id", r6("lt_mean"), r6("lt_std"), r6("p95"), r6("p99"), r6("p_late"), "risk_class")


REGIME = f"""
, rec AS (SELECT product_id, move_type = 'adjustment' AS adj, reason_code, qty, reported_qty, actual_qty, CAST(floor(greatest(0, (epoch_us({NOW}) - epoch_us(occurred_at)) / 8.64e10)) AS INT) AS age FROM moves WHERE occurred_at <= {NOW}),
r90 AS (SELECT * FROM rec WHERE age <= 90),
daily AS (SELECT product_id, age, sum(CASE WHEN adj THEN 1 ELSE 0 END) AS n_adj, count(*) AS n, sum(CASE WHEN adj THEN 1 ELSE 0 END) * 1.0 / count(*) AS d FROM r90 GROUP BY product_id, age),
st AS (SELECT product_id, avg(d) FILTER (age BETWEEN 31 AND 90) AS base_mean, coalesce(stddev_pop(d) FILTER (age BETWEEN 31 AND 90), 0) AS base_std, count(*) AS n_days, sum(n_adj) FILTER (age < 7) * 1.0 / nullif(sum(n) FILTER (age < 7), 0) AS ratio7, sum(n_adj) FILTER (age < 30) * 1.0 / nullif(sum(n) FILTER (age < 30), 0) AS ratio30 FROM daily GROUP BY product_id),
odd AS (SELECT product_id, count(*) AS w FROM daily JOIN st USING (product_id) WHERE age < 7 AND d > base_mean + 2 * base_std GROUP BY product_id),
cnt AS (SELECT product_id, reason_code, count(*) AS c, sum(abs(reported_qty - actual_qty) / greatest(qty, 1)) AS gap FROM r90 WHERE adj GROUP BY product_id, reason_code),
why AS (SELECT product_id, arg_min(coalesce(reason_code, '<null>'), (-c, coalesce(reason_code, '~'))) AS dominant_reason, sum(gap) / sum(c) AS discrepancy FROM cnt GROUP BY product_id),
reg AS (SELECT st.*, coalesce(w, 0) AS w, (coalesce(w, 0) + 1) / 9.0 AS p_shift, coalesce(dominant_reason, '<null>') AS dominant_reason, discrepancy, n_days < 14 AS data_gap FROM st LEFT JOIN odd USING (product_id) LEFT JOIN why USING (product_id)),
regime AS (SELECT *, CASE WHEN n_days < 14 THEN 'STABLE' WHEN ratio7 > base_mean + 2 * base_std AND p_shift > 0.7 THEN 'REGIME_SHIFT' WHEN ratio7 > base_mean + base_std THEN 'ELEVATED_ADJUSTMENTS' ELSE 'STABLE' END AS regime FROM reg)"""


def regimes(t):
    return b.flow_regime(t.moves, F.lit(AS_OF).cast("timestamp"))


@query("b7_flow_regime", ["moves"], REGIME + " SELECT product_id, round(base_mean, 6) AS base_mean, round(base_std, 6) AS base_std, n_days, round(ratio7, 6) AS ratio7, round(ratio30, 6) AS ratio30, round(p_shift, 6) AS p_shift, dominant_reason, round(discrepancy, 6) AS discrepancy, data_gap, regime FROM regime")
def b7(t):
    return regimes(t).select("product_id", r6("base_mean"), r6("base_std"), "n_days", r6("ratio7"), r6("ratio30"), r6("p_shift"), F.coalesce("dominant_reason", F.lit("<null>")).alias("dominant_reason"), r6("discrepancy"), "data_gap", "regime")


ACT_NEEDS = ["sales_orders", "order_lines", *RISK_NEEDS, "locations"]
ACTIONS = RISK + """,
site AS (SELECT destination_warehouse_id AS w, max(risk_class) AS risk_class FROM risk GROUP BY destination_warehouse_id),
act AS (SELECT l.id AS action_id, order_id, qty_ordered, qty_allocated, service_level_penalty, sla_priority AS sla, CASE WHEN qty_ordered > 0 THEN qty_allocated / qty_ordered ELSE 1 END AS fill_rate, service_level_penalty * greatest(qty_ordered - qty_allocated, 0) AS penalty_exposure,
  coalesce(site.risk_class, 'ACCEPTABLE') AS risk_class FROM order_lines l JOIN sales_orders o ON o.id = l.order_id LEFT JOIN site ON site.w = concat('W', CAST(substr(product_id, 2) AS BIGINT) % 25)),
term AS (SELECT *, 0.35 * fill_rate AS f, 0.3 / (1 + penalty_exposure / 1000) AS p, 0.2 * CASE risk_class WHEN 'ACCEPTABLE' THEN 1 WHEN 'ELEVATED' THEN 0.6 ELSE 0.2 END AS l, 0.15 * sla AS s FROM act),
util AS (SELECT *, f + p + l + s AS utility, CASE greatest(f, p, l, s) WHEN f THEN 'fill' WHEN p THEN 'penalty' WHEN l THEN 'leadtime' ELSE 'sla' END AS dominant_driver, rank() OVER (PARTITION BY order_id ORDER BY round(f + p + l + s, 9) DESC) AS rank FROM term)"""


def site_risk(t):
    """Highest risk of each warehouse's orders. It is that of their supplier, place and model, so orders are read
    once and summed by these."""
    by = ["supplier_id", "destination_warehouse_id", "leadtime_model_id"]
    sums = written(b.delivery_sums(t.purchase_orders, F.lit(AS_OF).cast("timestamp"), by), "deliveries")
    late = b.po_leadtime_risk(sums.select(*by), t.leadtime_models, b.posterior_of_sums(sums, t.suppliers), 12.0)
    return late.groupBy(F.col("destination_warehouse_id").alias("w")).agg(F.max("risk_class").alias("risk_class"))


def actions(t, whole=None):
    """``t`` may hold some orders only if ``whole`` holds all that the risk is taken from."""
    site = site_risk(whole or t)
    df = t.order_lines.join(t.sales_orders.select(F.col("id").alias("order_id"), F.col("sla_priority").alias("sla")), "order_id")
    df = df.withColumn("w", F.expr("concat('W', CAST(substr(product_id, 2) AS BIGINT) % 25)")).join(site, "w", "left").withColumn("risk_class", F.coalesce("risk_class", F.lit("ACCEPTABLE")))
    df = df.withColumn("fill_rate", F.when(F.col("qty_ordered") > 0, F.col("qty_allocated") / F.col("qty_ordered")).otherwise(1.0))
    df = df.withColumn("penalty_exposure", F.col("service_level_penalty") * F.greatest(F.col("qty_ordered") - F.col("qty_allocated"), F.lit(0.0)))
    return b.action_utility(df.withColumnRenamed("id", "action_id"), ["order_id"])


@query("b8_action_utility", ACT_NEEDS, ACTIONS + " SELECT action_id, order_id, round(utility, 6) AS utility, dominant_driver, rank FROM util")
def b8(t):
    return actions(t).select("action_id", "order_id", r6("utility"), "dominant_driver", F.col("rank").cast("long").alias("rank"))


def eu_sql(q: str) -> str:
    return f"(0.35 * least(1, {q} / demand) + 0.3 / (1 + 5 * greatest(0, demand - {q}) / 1000) + 0.2 * 0.6 + 0.15 * 0.8)"


VOI = UNCERTAIN + f""",
dem AS (SELECT *, 50 + 0.5 * prior_mean AS demand FROM uncc),
eus AS (SELECT *, {eu_sql("mean")} AS eu, {eu_sql("(mean + 2 * std)")} AS eu_high, {eu_sql("greatest(0, mean - 2 * std)")} AS eu_low FROM dem),
voi AS (SELECT *, 0.5 * eu_high + 0.5 * eu_low - eu - 0.05 AS voi FROM eus)"""


def voi(t):
    df = uncertain(t).withColumns({"demand": 50 + 0.5 * F.col("prior_mean"), "penalty_per_unit": F.lit(5.0), "risk_class": F.lit("ELEVATED"), "sla": F.lit(0.8)})
    return b.value_of_information(df)


@query("b9_value_of_information", BELIEF_NEEDS, VOI + " SELECT product_id, location_id, round(eu, 6) AS eu, round(voi, 6) AS voi, CASE WHEN round(voi, 9) > 0 THEN 'GATHER_INFO' ELSE 'ACT_NOW' END AS decision FROM voi")
def b9(t):
    return voi(t).select("product_id", "location_id", r6("eu"), r6("voi"), "decision")


CONSTRAINTS = UNCERTAIN + """,
cst AS (SELECT u.*, capacity_units, shelf_life_days AS days_remaining, 25 AS proposed_qty FROM uncc u JOIN locations l ON l.id = location_id JOIN products p ON p.id = product_id),
chk AS (SELECT *, concat_ws(',', CASE WHEN proposed_qty + prior_mean > capacity_units THEN 'CAPACITY_EXCEEDED' END, CASE WHEN quality_status NOT IN ('ok') THEN 'QUALITY_BLOCKED' END, CASE WHEN days_remaining < 3 THEN 'SHELF_LIFE_CRITICAL' END, CASE WHEN reserved + proposed_qty > prior_mean THEN 'ALLOCATION_EXCEEDS_ORDER' END) AS violations,
  CASE WHEN (proposed_qty + prior_mean) / nullif(capacity_units, 0) > 0.8 THEN 0.2 ELSE 0 END + CASE WHEN days > 30 THEN 0.1 ELSE 0 END AS soft_penalty FROM cst)"""


def constrained(t):
    df = uncertain(t).join(t.locations.select(F.col("id").alias("location_id"), "capacity_units"), "location_id").join(t.products.select(F.col("id").alias("product_id"), F.col("shelf_life_days").alias("days_remaining")), "product_id")
    return b.constraint_check(df.withColumns({"proposed_qty": F.lit(25), "qty_allocated": F.col("reserved"), "qty_ordered": F.col("on_hand")}))


@query("b10_constraint_check", [*BELIEF_NEEDS, "locations", "products"], CONSTRAINTS + " SELECT product_id, location_id, violations, round(soft_penalty, 6) AS soft_penalty, CASE WHEN violations <> '' THEN 'INFEASIBLE' WHEN soft_penalty > 0 THEN 'CONDITIONAL' ELSE 'FEASIBLE' END AS feasibility, nullif(split_part(violations, ',', 1), '') AS first_violation FROM chk")
def b10(t):
    return constrained(t).select("product_id", "location_id", joined("violations"), r6("soft_penalty"), "feasibility", "first_violation")


RANKED = ACTIONS + """,
fea AS (SELECT *, round(utility, 9) AS score, 0.01 * CAST(qty_ordered AS INT) AS uncertainty, CASE WHEN fill_rate < 0.49 THEN 'INFEASIBLE' ELSE 'FEASIBLE' END AS feasibility FROM util),
rk AS (SELECT *, row_number() OVER w AS rn, lead(score) OVER w AS nxt FROM fea WHERE feasibility <> 'INFEASIBLE' WINDOW w AS (PARTITION BY order_id ORDER BY score DESC, sla DESC NULLS LAST, action_id)),
top1 AS (SELECT order_id, CASE WHEN nxt IS NULL THEN 1 ELSE score - nxt END AS margin FROM rk WHERE rn = 1),
ranked AS (SELECT rk.*, margin, CASE WHEN round(margin, 9) > 0.1 THEN 'HIGH' WHEN round(margin, 9) > 0.02 THEN 'MARGINAL' ELSE 'TIE' END AS margin_class FROM rk JOIN top1 USING (order_id) WHERE rn <= 3)"""


def ranked(t, whole=None):
    df = actions(t, whole).drop("rank").withColumns({"score": F.round("utility", 9), "uncertainty": 0.01 * F.col("qty_ordered").cast("int"), "reliability": F.lit(0.5), "feasibility": F.when(F.col("fill_rate") < 0.49, "INFEASIBLE").otherwise("FEASIBLE")})
    return b.rank_actions(df, ["order_id"])


@query("b11_rank_actions", ACT_NEEDS, RANKED + " SELECT action_id, order_id, rn AS rank, round(score - 1.96 * uncertainty * 0.1, 6) AS ci_low, round(score + 1.96 * uncertainty * 0.1, 6) AS ci_high, round(margin, 6) AS margin, margin_class FROM ranked")
def b11(t):
    return ranked(t).select("action_id", "order_id", F.col("rank").cast("long").alias("rank"), r6("ci_low"), r6("ci_high"), r6("margin"), "margin_class")


@query("b12_pareto_frontier", ACT_NEEDS, ACTIONS + """,
pa AS (SELECT order_id, action_id, round(utility, 9) AS score, round(f, 9) AS f, round(p, 9) AS p, round(l, 9) AS l, round(s, 9) AS s FROM util),
dom AS (SELECT a.order_id, a.action_id, bool_or(b.f >= a.f AND b.p >= a.p AND b.l >= a.l AND b.s >= a.s AND (b.f > a.f OR b.p > a.p OR b.l > a.l OR b.s > a.s)) AS dominated,
  bool_or(b.f >= a.f - 0.05 AND b.p >= a.p - 0.05 AND b.l >= a.l - 0.05 AND b.s >= a.s - 0.05 AND b.score > a.score) AS near_dominated FROM pa a JOIN pa b ON a.order_id = b.order_id AND a.action_id <> b.action_id GROUP BY a.order_id, a.action_id)
SELECT pa.order_id, pa.action_id, coalesce(dominated, false) AS dominated, coalesce(near_dominated, false) AS near_dominated, round(avg(CASE WHEN dominated THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY pa.order_id), 6) AS reduction FROM pa LEFT JOIN dom ON dom.order_id = pa.order_id AND dom.action_id = pa.action_id""")
def b12(t):
    df = actions(t)
    terms = b.utility_terms(F.col("fill_rate"), F.col("penalty_exposure"), F.col("risk_class"), F.col("sla"))
    df = df.select("order_id", "action_id", F.round("utility", 9).alias("score"), *[F.round(c, 9).alias(n) for n, c in terms.items()])
    return b.pareto_frontier(df, ["order_id"], list(terms)).select("order_id", "action_id", "dominated", "near_dominated", r6("reduction"))


TRIGGER_NEEDS = [*BELIEF_NEEDS, "moves", "po_lines"]
TRIGGER = UNCERTAIN + f""",
dm AS (SELECT product_id, sum(qty) AS outbound_30d FROM moves WHERE move_type = 'outbound' AND occurred_at <= {NOW} AND occurred_at >= {NOW} - INTERVAL 720 HOUR GROUP BY product_id),
pipe AS (SELECT product_id, sum(greatest(qty_ordered - qty_received, 0)) AS pipeline_qty FROM po_lines GROUP BY product_id),
thr AS (SELECT u.*, CASE WHEN quality_status IN ('quarantined', 'damaged') THEN 0 ELSE mean END AS usable, coalesce(outbound_30d, 0) / 30.0 AS demand, coalesce(pipeline_qty, 0) AS pipeline_qty FROM uncc u LEFT JOIN dm USING (product_id) LEFT JOIN pipe USING (product_id)),
trig AS (SELECT *, usable / greatest(demand, 0.01) AS cover_days, 7 * demand AS safety_stock, (usable + pipeline_qty) / greatest(demand, 0.01) AS effective_cover FROM thr),
trg AS (SELECT *, CASE WHEN usable < safety_stock AND demand > 0 AND cover_days < 3 THEN 'STOCKOUT_IMMINENT' WHEN usable < safety_stock OR (demand > 0 AND cover_days < 7) THEN 'REORDER_TRIGGER' WHEN demand > 0 AND effective_cover < 14 AND pipeline_qty < safety_stock THEN 'PIPELINE_RISK' ELSE 'NORMAL' END AS trigger_name FROM trig)"""


def triggered(t):
    now = F.lit(AS_OF).cast("timestamp")
    out = t.moves.where(F.col("move_type") == "outbound").where((F.col("occurred_at") <= now) & (F.col("occurred_at") >= top.plus_hours(now, -720))).groupBy("product_id").agg(F.sum("qty").alias("outbound_30d"))
    pipe = t.po_lines.groupBy("product_id").agg(F.sum(F.greatest(F.col("qty_ordered") - F.col("qty_received"), F.lit(0.0))).alias("pipeline_qty"))
    df = voi(t).drop("demand").withColumnRenamed("mean", "qty").join(out, "product_id", "left").join(pipe, "product_id", "left").fillna(0.0, ["outbound_30d", "pipeline_qty"])
    return b.threshold_trigger(df)


@query("b13_threshold_trigger", TRIGGER_NEEDS, TRIGGER + " SELECT product_id, location_id, round(demand, 6) AS demand, round(cover_days, 6) AS cover_days, round(safety_stock, 6) AS safety_stock, round(effective_cover, 6) AS effective_cover, trigger_name FROM trg")
def b13(t):
    return triggered(t).select("product_id", "location_id", r6("demand"), r6("cover_days"), r6("safety_stock"), r6("effective_cover"), F.col("trigger").alias("trigger_name"))


def confident(t):
    t.keep("observations")
    asked = written(t.observations.select("product_id").distinct(), "asked")
    # lines of the products that are observed: enough for what is summed by products, but not for ids, which are
    # ranked among all lines of an order
    goods = t.narrowed(asked, lineitem="concat('P', l_partkey)")
    # whole orders that hold such a line: their margins and their lines' ids are those of all orders
    of = goods and t.narrowed(written(goods.lineitem.select("l_orderkey").distinct(), "asked"), row_bytes=16, lineitem="l_orderkey", orders="o_orderkey")
    goods = goods.within(lineitem=goods.lineitem, observations=t.observations) if goods else t
    of = of or t
    goods.keep("moves", "balances", without=["id"])
    of.keep("order_lines")
    sens = signals(t).select(F.col("id").alias("device_id"), F.col("reliability").alias("sensor"), (F.col("signal") == "LOW").cast("int").alias("n_low"))
    reg = regimes(goods).select("product_id", "regime")
    best = ranked(of, t).where("rank = 1").select("order_id", "margin", "margin_class")
    lines = of.order_lines.select("order_id", "product_id").join(best, "order_id").groupBy("product_id").agg(F.min(F.struct("margin", "margin_class")).alias("m"))
    df = triggered(goods).join(sens, "device_id", "left").join(reg, "product_id", "left").join(lines, "product_id", "left").withColumns({"margin": F.col("m.margin"), "margin_class": F.col("m.margin_class")})
    return b.decision_confidence(df)


CONF_NEEDS = list(dict.fromkeys([*TRIGGER_NEEDS, *ACT_NEEDS]))


def tail(ctes: str) -> str:
    """The CTEs of another chain, to be joined to one."""
    return ctes.strip().lstrip(",").strip()


CONFIDENCE = (
    TRIGGER
    + ", "
    + tail(RANKED)
    + ", "
    + tail(SIGNAL)
    + ", "
    + tail(REGIME)
    + """,
mar AS (SELECT product_id, min((margin, margin_class)) AS m FROM order_lines l JOIN (SELECT order_id, margin, margin_class FROM ranked WHERE rn = 1) r ON r.order_id = l.order_id GROUP BY product_id),
joinc AS (SELECT trg.*, sigc.reliability AS sensor, CASE WHEN signal = 'LOW' THEN 1 ELSE 0 END AS n_low, regime.regime, m[1] AS margin, m[2] AS margin_class FROM trg LEFT JOIN sigc ON sigc.id = trg.device_id LEFT JOIN regime USING (product_id) LEFT JOIN mar USING (product_id)),
conf AS (SELECT *, least(1, greatest(0, 0.25 * coalesce(sensor, 0.5) + 0.2 * CASE regime WHEN 'REGIME_SHIFT' THEN 0.2 WHEN 'ELEVATED_ADJUSTMENTS' THEN 0.6 WHEN 'STABLE' THEN 1 ELSE 0.8 END + 0.3 * (1 - coalesce(uncertainty, 0.5)) + 0.25 * CASE WHEN margin_class = 'TIE' THEN 0 ELSE least(coalesce(margin, 0.05) / 0.1, 1) END - 0.15 * n_low)) AS c FROM joinc),
confc AS (SELECT *, CASE WHEN c >= 0.75 THEN 'CONFIDENT' WHEN c >= 0.5 THEN 'ADEQUATE' WHEN c >= 0.25 THEN 'LOW_CONFIDENCE' ELSE 'INSUFFICIENT' END AS confidence_class FROM conf)"""
)


@query("b14_decision_confidence", CONF_NEEDS, CONFIDENCE + " SELECT product_id, location_id, round(c, 6) AS decision_confidence, confidence_class, CASE WHEN trigger_name = 'STOCKOUT_IMMINENT' OR c >= 0.75 THEN 'EXECUTE' WHEN c >= 0.5 THEN 'EXECUTE_WITH_FLAG' WHEN c >= 0.25 THEN 'DEFER' ELSE 'ESCALATE' END AS next_step FROM confc")
def b14(t):
    return confident(t).select("product_id", "location_id", r6("decision_confidence"), "confidence_class", "next_step")


@query("b15_deferral", CONF_NEEDS, CONFIDENCE + f""",
dv AS (SELECT *, 50 + 0.5 * prior_mean AS dmd, CAST(substr(product_id, 2) AS BIGINT) % 3 AS n_deferrals FROM confc),
ev2 AS (SELECT *, 0.5 * {eu_sql("(mean + 2 * std)").replace("demand", "dmd")} + 0.5 * {eu_sql("greatest(0, mean - 2 * std)").replace("demand", "dmd")} - {eu_sql("mean").replace("demand", "dmd")} - 0.05 + 0.3 AS voi FROM dv),
df AS (SELECT *, trigger_name <> 'STOCKOUT_IMMINENT' AND n_deferrals < 2 AND voi > 0 AND confidence_class IN ('LOW_CONFIDENCE', 'INSUFFICIENT') AS defer FROM ev2)
SELECT product_id, location_id, CASE WHEN trigger_name = 'STOCKOUT_IMMINENT' THEN 'CANNOT_DEFER' WHEN n_deferrals >= 2 THEN 'FORCED_DECISION' WHEN defer THEN 'DEFER' ELSE 'ACT_NOW' END AS deferral, CAST(CASE WHEN defer THEN least(48, ceil(round(uncertainty * 8, 9)) * 6) ELSE 0 END AS INT) AS wait_hours, n_deferrals + CASE WHEN defer THEN 1 ELSE 0 END AS n_deferrals_after FROM df""")
def b15(t):
    # 0.3 stands for the value that a count has beyond this one decision, so that some rows defer
    df = confident(t).withColumn("voi", F.col("voi") + 0.3).withColumn("n_deferrals", F.expr("CAST(substr(product_id, 2) AS BIGINT) % 3"))
    return b.deferral(df).select("product_id", "location_id", "deferral", "wait_hours", "n_deferrals_after")


@query("b16_resolve_conflicts", ["observations", "devices", "balances"], """
, g AS (SELECT o.product_id, o.location_id, o.id AS signal_id, observed_qty - bias AS mean, noise_sigma AS std, confidence AS reliability, on_hand AS base_mean, 5 + 0.2 * on_hand AS base_std FROM observations o JOIN devices d ON d.id = o.device_id JOIN balances b ON b.product_id = o.product_id AND b.location_id = o.location_id WHERE observed_qty IS NOT NULL),
g2 AS (SELECT *, median(mean) OVER w AS med, sqrt(avg(std * std) OVER w) AS pooled, max(mean) OVER w - min(mean) OVER w AS spread FROM g WINDOW w AS (PARTITION BY product_id, location_id)),
g3 AS (SELECT *, spread > 2 * pooled AS conflict, row_number() OVER (PARTITION BY product_id, location_id ORDER BY round(abs(mean - med), 9) DESC, reliability, signal_id) = 1 AND spread > 2 * pooled AS outlier FROM g2),
g4 AS (SELECT *, CASE WHEN outlier AND reliability < 0.4 THEN 0 ELSE reliability END AS w FROM g3),
g5 AS (SELECT product_id, location_id, bool_or(conflict) AS conflict, max(CASE WHEN outlier THEN signal_id END) AS outlier_id, sum(w * mean) / nullif(sum(w), 0) AS m, sum(w * mean * mean) / nullif(sum(w), 0) AS s2, count(*) FILTER (w > 0) AS n_used, max(std) FILTER (w > 0) AS only_std, max(CASE WHEN outlier THEN mean END) AS om, any_value(base_mean) AS bm, any_value(base_std) AS bs FROM g4 GROUP BY product_id, location_id),
g6 AS (SELECT *, CASE WHEN n_used = 1 THEN only_std ELSE sqrt(greatest(0, s2 - m * m)) END AS std, conflict AND coalesce(abs(m - bm) > 3 * bs, false) AS reset FROM g5)
SELECT product_id, location_id, conflict, outlier_id, reset, round(CASE WHEN reset THEN bm ELSE m END, 4) AS mean, round(CASE WHEN NOT conflict THEN 0 WHEN abs(om - m) / nullif(std, 0) <= 3 THEN -0.1 WHEN abs(om - m) / nullif(std, 0) <= 5 THEN -0.2 ELSE -0.35 END + CASE WHEN reset THEN -0.4 ELSE 0 END, 6) AS confidence_delta FROM g6""")
def b16(t):
    dev = t.devices.select(F.col("id").alias("device_id"), "bias", F.col("noise_sigma").alias("std"))
    df = t.observations.where("observed_qty is not null").join(dev, "device_id").join(t.balances.select("product_id", "location_id", "on_hand"), ["product_id", "location_id"])
    df = df.select("product_id", "location_id", F.col("id").alias("signal_id"), (F.col("observed_qty") - F.col("bias")).alias("mean"), "std", F.col("confidence").alias("reliability"), F.col("on_hand").alias("base_mean"), (5 + 0.2 * F.col("on_hand")).alias("base_std"))
    return b.resolve_conflicts(df, ["product_id", "location_id"]).select("product_id", "location_id", "conflict", "outlier_id", "reset", F.round("mean", 4).alias("mean"), r6("confidence_delta"))


KIND = {"STOCKOUT_IMMINENT": "EMERGENCY_ORDER", "REORDER_TRIGGER": "PLACE_ORDER", "PIPELINE_RISK": "EXPEDITE_OR_MONITOR", "NORMAL": "MONITOR"}
KIND_SQL = "CASE trigger_name " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KIND.items()) + " END"


@query("b16_resolve_actions", TRIGGER_NEEDS, TRIGGER + f""",
ac AS (SELECT product_id, location_id AS action_id, {KIND_SQL} AS action_type, round(mean, 6) AS score, CASE trigger_name WHEN 'STOCKOUT_IMMINENT' THEN 4 WHEN 'REORDER_TRIGGER' THEN 3 WHEN 'PIPELINE_RISK' THEN 2 ELSE 1 END AS priority FROM trg),
cl AS (SELECT product_id, bool_or(action_type = 'EMERGENCY_ORDER') AND bool_or(action_type = 'MONITOR') AS clash FROM ac GROUP BY product_id)
SELECT product_id, action_id, action_type, CASE WHEN clash THEN -0.15 ELSE 0 END AS confidence_delta FROM (SELECT *, row_number() OVER (PARTITION BY product_id ORDER BY priority DESC, score DESC, action_id) AS rn FROM ac) JOIN cl USING (product_id) WHERE rn = 1""")
def b16a(t):
    kind = F.create_map(*[F.lit(x) for kv in KIND.items() for x in kv])
    df = triggered(t).select("product_id", F.col("location_id").alias("action_id"), "trigger", r6("qty", "score")).withColumn("action_type", kind[F.col("trigger")])
    return b.resolve_actions(df, ["product_id"]).select("product_id", "action_id", "action_type", "confidence_delta")


@query("b17_discrepancy_severity", BELIEF_NEEDS, BELIEF + f"""
, sev AS (SELECT product_id, location_id, (prior_mean - observed_qty) / nullif(prior_mean, 0) * 100 AS shrinkage_pct, (prior_mean - observed_qty) / nullif(noise_sigma * 5, 0) AS z FROM belief WHERE observed_qty IS NOT NULL),
sp AS (SELECT *, 2 * (1 - {cdf_sql("abs(z)")}) AS p_value FROM sev)
SELECT product_id, location_id, round(shrinkage_pct, 6) AS shrinkage_pct, round(z, 6) AS z, round(p_value, 6) AS p_value, p_value < 0.05 AS significant FROM sp""")
def b17(t):
    df = belief(t).where("observed_qty is not null").withColumns({"expected": F.col("on_hand"), "observed": F.col("observed_qty"), "sigma": F.col("noise_sigma") * 5})
    return b.discrepancy_severity(df).select("product_id", "location_id", r6("shrinkage_pct"), r6("z"), r6("p_value"), "significant")
