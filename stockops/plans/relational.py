"""Queries of inventory, orders, procurement, topology, devices and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import inventory as inv
from ..operators import orders as o
from ..operators import quality as dq
from ..operators import topology as top
from .registry import AS_OF, EVENTS_AS_OF, joined, query, r6, us

BAL = ["balances", "products", "locations"]


@query("i1_current_inventory", BAL, """
SELECT product_id, location_id, sku, warehouse_id, round(on_hand, 6) AS on_hand, round(reserved, 6) AS reserved, round(on_hand - reserved, 6) AS available
FROM balances b JOIN products p ON b.product_id = p.id JOIN locations l ON b.location_id = l.id
ORDER BY on_hand - reserved ASC NULLS LAST, sku ASC, location_id ASC LIMIT 500""")
def i1(t):
    return inv.current_inventory(t.balances, t.products, t.locations, limit=500).select("product_id", "location_id", "sku", "warehouse_id", r6("on_hand"), r6("reserved"), r6("available"))


SEEN = "NOT is_missing AND observed_qty IS NOT NULL AND observed_at >= TIMESTAMP '2024-01-01 00:00:00' AND observed_at <= TIMESTAMP '2024-01-31 00:00:00'"


@query("i2_observation_vs_balance", ["observations", *BAL], f"""
, est AS (SELECT product_id, location_id, sum(observed_qty * coalesce(confidence, 0)) / nullif(sum(coalesce(confidence, 0)), 0) AS estimate, count(*) AS n_obs, avg(confidence) AS avg_confidence
  FROM observations WHERE {SEEN} GROUP BY product_id, location_id)
SELECT est.product_id, est.location_id, warehouse_id, round(estimate, 6) AS estimate, n_obs, round(avg_confidence, 6) AS avg_confidence, round(on_hand, 6) AS on_hand, round(estimate - on_hand, 6) AS discrepancy
FROM est JOIN locations l ON l.id = est.location_id JOIN products p ON p.id = est.product_id JOIN balances b ON b.product_id = est.product_id AND b.location_id = est.location_id""")
def i2(t):
    df = inv.observation_vs_balance(t.observations, t.balances, t.products, t.locations, "2024-01-01 00:00:00", "2024-01-31 00:00:00", limit=None)
    return df.select("product_id", "location_id", "warehouse_id", r6("estimate"), "n_obs", r6("avg_confidence"), r6("on_hand"), r6("discrepancy"))


LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product_id, location_id ORDER BY observed_at DESC, confidence DESC NULLS LAST, id ASC) AS rn FROM observations) WHERE rn = 1)"


@query("i3_observed_snapshot", ["observations", "balances"], f"""
, {LATEST}
SELECT latest.id, latest.product_id, latest.location_id, epoch_us(observed_at) AS observed_at, observed_qty, is_missing, on_hand, reserved, quality_status
FROM latest JOIN balances b ON b.product_id = latest.product_id AND b.location_id = latest.location_id""")
def i3(t):
    return inv.observed_snapshot(t.observations, t.balances, dev_mode=True).select("id", "product_id", "location_id", us("observed_at"), "observed_qty", "is_missing", "on_hand", "reserved", "quality_status")


@query("i3_observed_snapshot_damaged", ["observations", "balances"], f"""
, {LATEST}
SELECT latest.id, latest.product_id, latest.location_id, observed_qty, is_missing, quality_status
FROM latest JOIN balances b ON b.product_id = latest.product_id AND b.location_id = latest.location_id WHERE quality_status IN ('damaged')""")
def i3b(t):
    return inv.observed_snapshot(t.observations, t.balances, quality=["DAMAGED"]).select("id", "product_id", "location_id", "observed_qty", "is_missing", "quality_status")


@query("i4_list_moves", ["moves", "locations"], """
SELECT m.id, product_id, move_type, qty, epoch_us(occurred_at) AS occurred_at FROM moves m LEFT JOIN locations f ON m.from_location_id = f.id LEFT JOIN locations g ON m.to_location_id = g.id
WHERE (f.warehouse_id = 'W3' OR g.warehouse_id = 'W3') AND occurred_at >= TIMESTAMP '1995-01-01 00:00:00' AND move_type = 'adjustment' ORDER BY occurred_at DESC, m.id LIMIT 500""")
def i4(t):
    return inv.list_moves(t.moves, t.locations, warehouse_id="W3", move_type="ADJUSTMENT", start="1995-01-01 00:00:00", limit=500).select("id", "product_id", "move_type", "qty", us("occurred_at"))


@query("i4_list_moves_by_sku", ["moves", "locations", "products"], """
SELECT m.id, product_id, move_type, qty FROM moves m JOIN products p ON p.id = m.product_id WHERE sku = 'SKU-7' ORDER BY occurred_at DESC, m.id LIMIT 500""")
def i4b(t):
    return inv.list_moves(t.moves, t.locations, t.products, product="SKU-7", limit=500).select("id", "product_id", "move_type", "qty")


@query("i5_move_by_id", ["moves"], "SELECT id, product_id, from_location_id, to_location_id, move_type, qty FROM moves WHERE id IN (SELECT related_move_id FROM obs)".replace("FROM obs)", "FROM (SELECT concat('V', event_id % 1000, '-', 1 + event_id % 7, '-1') AS related_move_id FROM events WHERE event_id % 10 = 0))"))
def i5(t):
    return inv.move_by_id(t.moves, t.observations.where("related_move_id is not null").select("related_move_id")).select("id", "product_id", "from_location_id", "to_location_id", "move_type", "qty")


@query("i6_move_audit_trace", ["moves", "observations"], """
SELECT m.id, count(o.id) AS n_obs, coalesce(string_agg(o.id, ',' ORDER BY o.observed_at, o.id), '') AS observation_ids FROM moves m LEFT JOIN observations o ON o.related_move_id = m.id GROUP BY m.id""")
def i6(t):
    df = inv.move_audit_trace(t.moves, t.observations)
    return df.select("id", F.size("trace").cast("long").alias("n_obs"), F.array_join("trace.observation_id", ",").alias("observation_ids"))


ADJ = "FROM moves m JOIN locations l ON l.id = m.from_location_id OR l.id = m.to_location_id WHERE move_type = 'adjustment'"


@query("i7_adjustments_summary", ["moves", "locations"], f"SELECT count(*) AS n_moves, coalesce(sum(qty), 0) AS total_qty {ADJ}")
def i7(t):
    return inv.adjustments_summary(t.moves, t.locations)


@query("i8_adjustments_by_reason", ["moves", "locations"], f"SELECT reason_code, count(*) AS n_moves, sum(qty) AS total_qty {ADJ} GROUP BY reason_code")
def i8(t):
    return inv.adjustments_by_reason(t.moves, t.locations)


DELTAS = """deltas AS (SELECT id, product_id, to_location_id AS location_id, qty AS delta, occurred_at FROM moves WHERE to_location_id IS NOT NULL
  UNION ALL SELECT id, product_id, from_location_id, -qty, occurred_at FROM moves WHERE from_location_id IS NOT NULL)"""


@query("i9_replay_balances", ["moves", "balances"], f"""
, {DELTAS}, log AS (SELECT product_id, location_id, sum(delta) AS replayed FROM deltas GROUP BY product_id, location_id)
SELECT product_id, location_id, replayed, on_hand, coalesce(on_hand, 0) - coalesce(replayed, 0) AS diff FROM log FULL JOIN balances USING (product_id, location_id)""")
def i9(t):
    return inv.replay_balances(t.moves, t.balances)


@query("i10_negative_stock_violations", ["moves"], f"""
, {DELTAS}, run AS (SELECT *, sum(delta) OVER (PARTITION BY product_id, location_id ORDER BY occurred_at, id, delta ROWS UNBOUNDED PRECEDING) AS running FROM deltas)
SELECT product_id, location_id, epoch_us(occurred_at) AS occurred_at, id, running FROM (SELECT *, row_number() OVER (PARTITION BY product_id, location_id ORDER BY occurred_at, id, delta) AS rn FROM run WHERE running < 0) WHERE rn = 1""")
def i10(t):
    return inv.negative_stock_violations(t.moves).select("product_id", "location_id", us("occurred_at"), "id", "running")


@query("i11_apply_receipts", ["balances", "po_lines", "purchase_orders"], """
, receipts AS (SELECT product_id, concat('N', CAST(substr(destination_warehouse_id, 2) AS INT)) AS location_id, qty_received AS qty FROM po_lines l JOIN purchase_orders p ON p.id = l.purchase_order_id WHERE qty_received > 0)
SELECT product_id, location_id, round(sum(qty), 6) AS on_hand FROM (SELECT product_id, location_id, on_hand AS qty FROM balances UNION ALL SELECT * FROM receipts) GROUP BY product_id, location_id""")
def i11(t):
    pos = t.purchase_orders.select(F.col("id").alias("purchase_order_id"), "destination_warehouse_id")
    rec = t.po_lines.where("qty_received > 0").join(pos, "purchase_order_id").select("product_id", F.expr("concat('N', substr(destination_warehouse_id, 2))").alias("location_id"), F.col("qty_received").alias("qty"))
    return inv.apply_receipts(t.balances, rec).select("product_id", "location_id", r6("on_hand"))


DOCKS = "docks AS (SELECT warehouse_id, min(id) AS dock_id FROM locations WHERE type = 'dock' GROUP BY warehouse_id)"


def docks(t):
    return t.locations.where("type = 'dock'").groupBy("warehouse_id").agg(F.min("id").alias("dock_id"))


@query("i12_arrivals_due", ["shipments", "po_lines", "locations"], f"""
, {DOCKS}, due AS (SELECT s.*, dock_id, CASE WHEN purchase_order_id IS NULL THEN 'no_purchase_order' WHEN destination_warehouse_id IS NULL THEN 'no_destination' WHEN dock_id IS NULL THEN 'no_dock' END AS reject
  FROM shipments s LEFT JOIN docks d ON d.warehouse_id = s.destination_warehouse_id WHERE status = 'in_transit' AND direction = 'inbound' AND coalesce(arrived_at, shipped_at) <= TIMESTAMP '{AS_OF}')
SELECT due.id, due.purchase_order_id, dock_id, product_id, qty_ordered AS qty, reject FROM due JOIN po_lines l ON l.purchase_order_id = due.purchase_order_id WHERE reject IS NULL
UNION ALL SELECT id, purchase_order_id, dock_id, NULL, NULL, reject FROM due WHERE reject IS NOT NULL""")
def i12(t):
    return inv.arrivals_due(t.shipments, t.po_lines, docks(t), AS_OF)


@query("i13_allocate_fcfs", ["order_lines", "sales_orders", "balances"], """
, d AS (SELECT l.id, l.product_id, created_at AS ts, qty_ordered AS qty FROM order_lines l JOIN sales_orders o ON o.id = l.order_id),
s AS (SELECT product_id, sum(on_hand) AS stock FROM balances GROUP BY product_id),
f AS (SELECT d.*, coalesce(stock, 0) AS stock, coalesce(sum(qty) OVER (PARTITION BY d.product_id ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d LEFT JOIN s USING (product_id))
SELECT id, product_id, qty, greatest(0, least(qty, stock - before)) AS shipped, (qty - greatest(0, least(qty, stock - before))) * 10 AS penalty, CASE WHEN greatest(0, least(qty, stock - before)) > 0 THEN 'shipped' ELSE 'cancelled' END AS status FROM f""")
def i13(t):
    lines = t.order_lines.join(t.sales_orders.select(F.col("id").alias("order_id"), "created_at"), "order_id").select("id", "product_id", F.col("created_at").alias("ts"), F.col("qty_ordered").alias("qty"))
    stock = t.balances.groupBy("product_id").agg(F.sum("on_hand").alias("stock"))
    return inv.allocate_fcfs(lines, stock).select("id", "product_id", "qty", "shipped", "penalty", "status")


@query("i14_reorder_review", ["products", "locations", "balances"], f"""
, {DOCKS}
SELECT p.id AS product_id, dock_id AS location_id, coalesce(on_hand, 0) AS on_hand, 100 - coalesce(on_hand, 0) AS order_qty FROM products p CROSS JOIN docks LEFT JOIN balances b ON b.product_id = p.id AND b.location_id = dock_id WHERE coalesce(on_hand, 0) < 20""")
def i14(t):
    return inv.reorder_review(t.products, docks(t), t.balances).select("product_id", "location_id", "on_hand", "order_qty")


@query("o1_at_risk_orders", ["sales_orders", "order_lines", "products"], f"""
, l AS (SELECT o.id AS order_id, promised_at, sla_priority, sku, greatest(qty_ordered - qty_allocated, 0) AS open_qty, service_level_penalty, qty_shipped < qty_ordered AS unshipped
  FROM sales_orders o JOIN order_lines x ON x.order_id = o.id JOIN products p ON p.id = x.product_id
  WHERE promised_at <= TIMESTAMP '{AS_OF}' + INTERVAL 48 HOUR AND sla_priority >= 0.7),
per AS (SELECT order_id, promised_at, count(*) AS total_lines, sum(CASE WHEN open_qty > 0 OR (unshipped AND promised_at <= TIMESTAMP '{AS_OF}' + INTERVAL 24 HOUR) THEN 1 ELSE 0 END) AS risk_lines, sum(open_qty) AS open_qty, sum(service_level_penalty * open_qty) AS exposure FROM l GROUP BY order_id, promised_at),
short AS (SELECT order_id, sku, row_number() OVER (PARTITION BY order_id ORDER BY sum(open_qty) DESC, sku) AS rn FROM l GROUP BY order_id, sku HAVING sum(open_qty) > 0)
SELECT per.order_id, total_lines, CAST(risk_lines AS BIGINT) AS risk_lines, open_qty, round(exposure, 6) AS exposure, string_agg(sku, ',' ORDER BY rn) AS missing_skus
FROM per LEFT JOIN short ON short.order_id = per.order_id AND rn <= 3 WHERE risk_lines > 0 GROUP BY ALL""")
def o1(t):
    df = o.at_risk_orders(t.sales_orders, t.order_lines, t.products, AS_OF, limit=None)
    return df.select("order_id", "total_lines", "risk_lines", "open_qty", r6("exposure"), joined("missing_skus"))


SHIP = f"""
, s AS (SELECT *, (epoch_us(arrived_at) - epoch_us(shipped_at)) / 3.6e9 AS transit FROM shipments),
d AS (SELECT *, (arrived_at IS NULL AND shipped_at < TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR) OR transit > 48 AS is_delayed FROM s)"""


@query("o2_shipment_delay_summary", ["shipments"], SHIP + """
SELECT count(*) AS total, CAST(count(arrived_at) AS BIGINT) AS delivered, CAST(count(*) - count(arrived_at) AS BIGINT) AS in_transit, CAST(count(*) FILTER (is_delayed IS TRUE) AS BIGINT) AS delayed, round(avg(transit), 6) AS avg_transit_hours FROM d""")
def o2(t):
    df = o.shipment_delay_summary(t.shipments, AS_OF)
    return df.select("total", *[F.col(c).cast("long").alias(c) for c in ("delivered", "in_transit", "delayed")], r6("avg_transit_hours"))


@query("o3_delayed_shipments", ["shipments"], SHIP + """
SELECT id, epoch_us(shipped_at) AS shipped_at, round(transit, 6) AS transit_hours, CASE WHEN arrived_at IS NULL THEN 'not arrived' ELSE 'transit too long' END AS reason FROM d WHERE is_delayed IS TRUE ORDER BY d.shipped_at ASC NULLS LAST, id LIMIT 20""")
def o3(t):
    return o.delayed_shipments(t.shipments, AS_OF).select("id", us("shipped_at"), r6("transit_hours"), "reason")


@query("p1_list_suppliers", ["suppliers"], "SELECT id, name, round(reliability_score, 6) AS reliability_score, region FROM suppliers WHERE reliability_score >= 0.3 AND name ILIKE '%supplier%1%' ORDER BY name, id LIMIT 500")
def p1(t):
    return o.list_suppliers(t.suppliers, min_reliability=0.3, name_like="supplier%1", limit=500).select("id", "name", r6("reliability_score"), "region")


@query("p2_supplier_by_id", ["suppliers", "purchase_orders"], "SELECT id, name, region FROM suppliers WHERE id IN (SELECT supplier_id FROM purchase_orders WHERE status = 'partial')")
def p2(t):
    return o.supplier_by_id(t.suppliers, t.purchase_orders.where("status = 'partial'").select("supplier_id")).select("id", "name", "region")


@query("p3_list_purchase_orders", ["purchase_orders", "suppliers", "warehouses"], """
SELECT p.id, s.name AS supplier_name, w.name AS warehouse_name, status, epoch_us(expected_at) AS expected_at FROM purchase_orders p JOIN suppliers s ON s.id = supplier_id JOIN warehouses w ON w.id = destination_warehouse_id
WHERE status IN ('partial', 'submitted') AND created_at >= TIMESTAMP '1997-01-01 00:00:00' ORDER BY created_at DESC, p.id LIMIT 500""")
def p3(t):
    df = o.list_purchase_orders(t.purchase_orders, t.suppliers, t.warehouses, statuses=["PARTIAL", "SUBMITTED"], created=("1997-01-01 00:00:00", None), limit=500)
    return df.select("id", "supplier_name", "warehouse_name", "status", us("expected_at"))


@query("p4_purchase_order_by_id", ["purchase_orders", "shipments"], "SELECT id, supplier_id, status, CAST(NULL AS VARCHAR) AS supplier_name FROM purchase_orders WHERE id IN (SELECT purchase_order_id FROM shipments WHERE status = 'in_transit')")
def p4(t):
    return o.purchase_order_by_id(t.purchase_orders, t.shipments.where("status = 'in_transit'").select("purchase_order_id")).select("id", "supplier_id", "status", "supplier_name")


@query("p5_po_lines", ["po_lines", "products"], """
SELECT l.id, purchase_order_id, sku, greatest(coalesce(qty_ordered, 0) - coalesce(qty_received, 0), 0) AS remaining FROM po_lines l JOIN products p ON p.id = l.product_id""")
def p5(t):
    return o.po_lines_view(t.po_lines, t.products).select("id", "purchase_order_id", "sku", "remaining")


@query("p6_procurement_pipeline", ["purchase_orders", "po_lines"], """
, x AS (SELECT p.id, supplier_id, destination_warehouse_id AS warehouse_id, expected_at, created_at, qty_ordered, qty_received, greatest(qty_ordered - qty_received, 0) AS remaining FROM purchase_orders p JOIN po_lines l ON l.purchase_order_id = p.id
  WHERE status IN ('draft', 'submitted', 'partial') AND expected_at <= TIMESTAMP '1998-06-01 00:00:00' + INTERVAL 365 DAY)
SELECT CASE WHEN supplier_id IS NULL THEN 'warehouse' WHEN warehouse_id IS NULL THEN 'supplier' ELSE 'both' END AS mode, warehouse_id, supplier_id, count(DISTINCT id) AS po_count, sum(qty_ordered) AS qty_ordered, sum(qty_received) AS qty_received, sum(remaining) AS remaining, epoch_us(min(expected_at)) AS next_expected, epoch_us(max(created_at)) AS last_created
FROM x GROUP BY GROUPING SETS ((warehouse_id), (supplier_id), (warehouse_id, supplier_id))""")
def p6(t):
    df = o.procurement_pipeline(t.purchase_orders, t.po_lines, as_of=AS_OF, horizon_days=365)
    return df.select("mode", "warehouse_id", "supplier_id", "po_count", "qty_ordered", "qty_received", "remaining", us("next_expected"), us("last_created"))


PAIRS = "SELECT a.id AS origin_id, b.id AS destination_id, CAST(137 * abs(CAST(substr(a.id, 2) AS INT) - CAST(substr(b.id, 2) AS INT)) + 450 * abs(CAST(substr(a.id, 2) AS INT) % 5 - CAST(substr(b.id, 2) AS INT) % 5) AS DOUBLE) AS distance_km FROM {a} a CROSS JOIN {b} b"


def pairs(t):
    # warehouses are a dimension: one row a site
    return t.spark.sql(PAIRS, a=t.warehouses, b=t.warehouses)


@query("p7_route_tiering", ["warehouses"], ", pairs AS (" + PAIRS.replace("{a}", "warehouses").replace("{b}", "warehouses") + """)
SELECT origin_id, destination_id, distance_km, CASE WHEN distance_km < 800 THEN 'truck' WHEN distance_km < 5000 THEN 'air' ELSE 'sea' END AS mode FROM pairs WHERE origin_id <> destination_id""")
def p7(t):
    return o.route_tiering(pairs(t))


@query("p8_form_options", ["warehouses", "suppliers", "products"], ", pairs AS (" + PAIRS.replace("{a}", "warehouses").replace("{b}", "warehouses") + """),
routes AS (SELECT DISTINCT CASE WHEN distance_km < 800 THEN 'truck' WHEN distance_km < 5000 THEN 'air' ELSE 'sea' END AS mode FROM pairs WHERE origin_id <> destination_id)
SELECT 'name' AS kind, name AS value, NULL AS detail FROM warehouses UNION SELECT 'name', name, NULL FROM suppliers UNION SELECT 'product', name, category FROM products UNION SELECT 'mode', mode, NULL FROM routes""")
def p8(t):
    return o.form_options(t.warehouses, t.suppliers, t.products, o.route_tiering(pairs(t)))


@query("t1_list_warehouses", ["warehouses"], "SELECT id, name, region FROM warehouses WHERE region = 'ASIA' AND name ILIKE '%nation%' ORDER BY name, id LIMIT 50")
def t1(t):
    return top.list_warehouses(t.warehouses, region="ASIA", name_like="nation").select("id", "name", "region")


@query("t2_warehouse_by_id", ["warehouses", "shipments"], "SELECT id, name FROM warehouses WHERE id IN (SELECT origin_warehouse_id FROM shipments WHERE direction = 'inbound')")
def t2(t):
    return top.warehouse_by_id(t.warehouses, t.shipments.where("direction = 'inbound'").select("origin_warehouse_id")).select("id", "name")


@query("t3_list_locations", ["locations"], "SELECT id, code, type FROM locations WHERE type = 'shelf' AND code ILIKE '%supplier%' ORDER BY code, id LIMIT 500")
def t3(t):
    return top.list_locations(t.locations, type="SHELF", code_like="supplier", limit=500).select("id", "code", "type")


@query("t4_location_by_id", ["locations", "balances"], "SELECT id, code FROM locations WHERE id IN (SELECT location_id FROM balances)")
def t4(t):
    return top.location_by_id(t.locations, t.balances.select("location_id")).select("id", "code")


TREE = """, forest AS (SELECT id, id AS root_id, 0 AS depth, id AS path, capacity_units FROM locations l WHERE parent_location_id IS NULL OR parent_location_id NOT IN (SELECT id FROM locations)
  UNION ALL SELECT l.id, root_id, depth + 1, path || ',' || l.id, l.capacity_units FROM locations l JOIN forest ON l.parent_location_id = forest.id)"""


@query("t5_locations_tree", ["locations"], TREE + " SELECT id, root_id, depth, path FROM forest")
def t5(t):
    return top.locations_tree(t.locations, paths=True).select("id", "root_id", "depth", joined("path"))


@query("t6_subtree_rollup", ["locations"], TREE + ", up AS (SELECT unnest(string_split(path, ',')) AS id, capacity_units FROM forest) SELECT id, CAST(sum(capacity_units) AS BIGINT) AS capacity_units, count(*) AS n_nodes FROM up GROUP BY id")
def t6(t):
    return top.subtree_rollup(t.locations)


UTIL = f"""
, keys AS (SELECT location_id, product_id, sum(observed_qty * coalesce(confidence, 0)) / nullif(sum(coalesce(confidence, 0)), 0) AS qty_hat, avg(confidence) AS conf_hat, count(*) AS n FROM observations
  WHERE NOT is_missing AND observed_qty IS NOT NULL AND observed_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL 720 HOUR AND observed_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY location_id, product_id),
locs AS (SELECT location_id, sum(qty_hat) AS observed_qty, avg(conf_hat) AS avg_confidence, sum(n) AS n_obs FROM keys GROUP BY location_id),
util AS (SELECT id AS location_id, warehouse_id, code, capacity_units, observed_qty, avg_confidence, CAST(coalesce(n_obs, 0) AS BIGINT) AS n_obs, CASE WHEN capacity_units > 0 THEN observed_qty / capacity_units END AS utilization FROM locations LEFT JOIN locs ON location_id = id)"""


@query("t7_capacity_utilization", ["observations", "locations"], UTIL + " SELECT location_id, warehouse_id, capacity_units, round(observed_qty, 6) AS observed_qty, round(avg_confidence, 6) AS avg_confidence, n_obs, round(utilization, 6) AS utilization FROM util")
def t7(t):
    return top.capacity_utilization(t.observations, t.locations, EVENTS_AS_OF, 720).select("location_id", "warehouse_id", "capacity_units", r6("observed_qty"), r6("avg_confidence"), "n_obs", r6("utilization"))


@query("t8_warehouse_utilization_total", ["observations", "locations"], UTIL + """
SELECT warehouse_id, round(sum(observed_qty), 6) AS observed_qty, CAST(sum(capacity_units) AS BIGINT) AS capacity_units, CAST(sum(n_obs) AS BIGINT) AS n_obs, round(sum(observed_qty) / nullif(sum(capacity_units), 0), 6) AS utilization FROM util GROUP BY warehouse_id""")
def t8(t):
    df = top.warehouse_utilization_total(top.capacity_utilization(t.observations, t.locations, EVENTS_AS_OF, 720))
    return df.select("warehouse_id", r6("observed_qty"), "capacity_units", "n_obs", r6("utilization"))


@query("v1_list_devices", ["devices"], "SELECT id, warehouse_id, device_type, status FROM devices WHERE device_type = 'rfid' AND status = 'offline' ORDER BY warehouse_id, id LIMIT 500")
def v1(t):
    return top.list_devices(t.devices, device_type="RFID", status="offline", limit=500).select("id", "warehouse_id", "device_type", "status")


@query("v2_device_by_id", ["devices", "observations"], "SELECT id, device_type, noise_sigma FROM devices WHERE id IN (SELECT device_id FROM observations WHERE is_missing)")
def v2(t):
    return top.device_by_id(t.devices, t.observations.where("is_missing").select("device_id")).select("id", "device_type", "noise_sigma")


def exact6(column: str):
    """Six digits by decimals, as a mean of few decimals may end in a five."""
    return F.round(F.col(column).cast("decimal(20,12)"), 6).cast("double").alias(column)


def health(hours: int) -> str:
    return f"""
, h AS (SELECT d.id, d.warehouse_id, d.status, d.missing_rate, max(observed_at) AS last_seen, count(o.id) AS n_obs, CAST(sum(CASE WHEN is_missing THEN 1 ELSE 0 END) AS BIGINT) AS n_missing,
  CAST(sum(CASE WHEN observed_qty IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_null, avg(CAST(confidence AS DECIMAL(18, 9))) AS avg_confidence
  FROM devices d LEFT JOIN observations o ON o.device_id = d.id AND observed_at >= TIMESTAMP '{EVENTS_AS_OF}' - INTERVAL {hours} HOUR AND observed_at <= TIMESTAMP '{EVENTS_AS_OF}' GROUP BY d.id, d.warehouse_id, d.status, d.missing_rate)"""


@query("v3_device_health", ["devices", "observations"], health(24) + " SELECT id, epoch_us(last_seen) AS last_seen, n_obs, n_missing, n_null, CAST(round(CAST(avg_confidence AS DECIMAL(20, 12)), 6) AS DOUBLE) AS avg_confidence FROM h")
def v3(t):
    return top.device_health(t.devices, t.observations, EVENTS_AS_OF, 24).select("id", us("last_seen"), "n_obs", "n_missing", "n_null", exact6("avg_confidence"))


@query("v4_device_anomaly_candidates", ["devices", "observations"], health(720) + " SELECT id, n_obs, n_missing, round(n_missing * 1.0 / nullif(n_obs, 0), 6) AS observed_missing_rate, CAST(round(CAST(avg_confidence AS DECIMAL(20, 12)), 6) AS DOUBLE) AS avg_confidence FROM h")
def v4(t):
    return top.device_anomaly_candidates(t.devices, t.observations, EVENTS_AS_OF, 720).select("id", "n_obs", "n_missing", r6("observed_missing_rate"), exact6("avg_confidence"))


@query("v5_device_anomalies", ["devices", "observations"], health(720) + """
, x AS (SELECT *, n_missing * 1.0 / nullif(n_obs, 0) AS rate FROM h),
y AS (SELECT id, n_obs, round(rate, 6) AS observed_missing_rate, concat_ws(',', CASE WHEN status = 'offline' AND n_obs > 0 THEN 'offline_with_observations' END, CASE WHEN status <> 'offline' AND n_obs = 0 THEN 'online_without_observations' END,
  CASE WHEN rate > missing_rate THEN 'missing_rate_spike' END, CASE WHEN round(avg_confidence, 9) < 0.5 THEN 'low_confidence' END) AS anomalies FROM x)
SELECT * FROM y WHERE anomalies <> ''""")
def v5(t):
    return top.device_anomalies(t.devices, t.observations, EVENTS_AS_OF, 720).select("id", "n_obs", r6("observed_missing_rate"), joined("anomalies"))


@query("d1_check_violations", ["balances"], """
, v AS (SELECT id, unnest([CASE WHEN on_hand <= 0 THEN 'on_hand_positive' END, CASE WHEN reserved < 0 THEN 'reserved_not_negative' END, CASE WHEN reserved / 100 > 1 OR reserved < 0 THEN 'reserved_share' END, CASE WHEN quality_status NOT IN ('ok', 'damaged') THEN 'quality_domain' END]) AS rule FROM balances)
SELECT rule, count(*) AS n_rows, min(id) AS first_id FROM v WHERE rule IS NOT NULL GROUP BY rule""")
def d1(t):
    df = t.balances.withColumn("share", F.col("reserved") / 100)
    return dq.check_violations(df, {"on_hand_positive": dq.not_positive("on_hand"), "reserved_not_negative": dq.not_negative("reserved"), "reserved_share": dq.outside_unit("share"), "quality_domain": dq.outside_domain("quality_status", ["ok", "damaged"])})


@query("d2_unique_violations", [], "SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def d2(t):
    return dq.unique_violations(t.lineitem, ["l_orderkey", "l_linenumber"])


@query("d3_orphan_rows", ["observations", "moves"], "SELECT id, related_move_id FROM observations WHERE related_move_id IS NOT NULL AND related_move_id NOT IN (SELECT id FROM moves)")
def d3(t):
    return dq.orphan_rows(t.observations, t.moves, "related_move_id").select("id", "related_move_id")


