"""Logical supply-chain tables as projections of the given star schema.

Every table is one SELECT that Spark and an oracle engine both read; only the spelling of a few time
and hash functions differs, which ``Dialect`` holds. ``load`` returns Spark DataFrames, ``with_clause``
the same tables as common table expressions.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession


class Dialect:
    def __init__(self, spark: bool):
        self.spark = spark

    def ts(self, x: str) -> str:
        return f"CAST({x} AS TIMESTAMP)"

    def hours(self, ts: str, n: str) -> str:
        return f"timestampadd(HOUR, CAST({n} AS INT), {ts})" if self.spark else f"({ts} + to_hours(CAST({n} AS INT)))"

    def array(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"

    def lines(self, table: str, key: str, text: str) -> str:
        """Rows (key, pos, line) of the lines of a text, from 0."""
        if self.spark:
            return f"(SELECT {key}, pos, line FROM {table} LATERAL VIEW posexplode(split({text}, '\\n')) x AS pos, line)"
        return f"(SELECT {key}, CAST(unnest(range(len(parts))) AS INT) AS pos, unnest(parts) AS line FROM (SELECT {key}, string_split({text}, chr(10)) AS parts FROM {table}))"

    def json_int(self, x: str, key: str) -> str:
        return f"CAST(get_json_object({x}, '$.{key}') AS INT)" if self.spark else f"CAST(json_extract_string({x}, '$.{key}') AS INT)"


TABLES = {
    "warehouses": lambda d: """SELECT concat('W', n_nationkey) AS id, n_name AS name, r_name AS region, 'UTC' AS tz
        FROM {nation} JOIN {region} ON n_regionkey = r_regionkey""",
    "locations": lambda d: """SELECT concat('R', r_regionkey) AS id, concat('W', r_regionkey) AS warehouse_id, CAST(NULL AS STRING) AS parent_location_id,
            r_name AS code, 'virtual' AS type, 5000 AS capacity_units FROM {region}
        UNION ALL SELECT concat('N', n_nationkey), concat('W', n_nationkey), concat('R', n_regionkey), n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'dock' ELSE 'zone' END, 400 + 100 * n_nationkey FROM {nation}
        UNION ALL SELECT concat('S', s_suppkey), concat('W', s_nationkey), concat('N', s_nationkey), s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'shelf' ELSE 'bin' END,
            CAST(floor(greatest(s_acctbal, 0)) AS INT) FROM {supplier}""",
    "products": lambda d: """SELECT concat('P', p_partkey) AS id, concat('SKU-', p_partkey) AS sku, p_name AS name, p_type AS category,
            CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END AS shelf_life_days FROM {part}""",
    "suppliers": lambda d: """SELECT concat('S', s_suppkey) AS id, s_name AS name, least(1.0, greatest(0.0, (s_acctbal + 1000) / 11000)) AS reliability_score, r_name AS region
        FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "sales_orders": lambda d: f"""SELECT concat('O', o_orderkey) AS id, c_name AS customer_name,
            CASE o_orderstatus WHEN 'F' THEN 'shipped' WHEN 'P' THEN 'allocated' ELSE 'open' END AS status,
            {d.hours(d.ts("o_orderdate"), "720")} AS promised_at, (6 - CAST(substr(o_orderpriority, 1, 1) AS INT)) / CAST(5 AS DOUBLE) AS sla_priority,
            n_name AS requested_ship_from_region, {d.ts("o_orderdate")} AS created_at
        FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey""",
    # rows of an order that repeat a line number are told apart by their rank over all other columns
    "lines": lambda d: f"""SELECT concat(l_orderkey, '-', l_linenumber, '-', row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS line_id,
            l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_discount, l_tax, l_returnflag, l_linestatus, {d.ts("l_shipdate")} AS l_shipdate FROM {{lineitem}}""",
    "order_lines": lambda d: """SELECT concat('L', line_id) AS id, concat('O', l_orderkey) AS order_id, concat('P', l_partkey) AS product_id, l_quantity AS qty_ordered,
            CASE WHEN l_discount >= 0.06 THEN floor(l_quantity / 2) ELSE l_quantity END * CAST(1 AS DOUBLE) AS qty_allocated,
            CASE WHEN l_linestatus = 'F' THEN CASE WHEN l_discount >= 0.06 THEN floor(l_quantity / 2) ELSE l_quantity END ELSE 0 END * CAST(1 AS DOUBLE) AS qty_shipped,
            100 * l_tax AS service_level_penalty FROM {lines}""",
    # Spark makes keys distinct before it joins them: the same rows, but wide ones are not shuffled, and what is dealt
    # by the order's key is dealt once for both
    "purchase_orders": lambda d: f"""SELECT concat('O', o_orderkey, 'S', l_suppkey) AS id, concat('S', l_suppkey) AS supplier_id, concat('W', s_nationkey) AS destination_warehouse_id,
            status,
            {d.hours("created_at", "1440")} AS expected_at, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('M', s_nationkey % 3) END AS leadtime_model_id, created_at,
            CASE WHEN status = 'received' THEN {d.hours("created_at", "24 * (10 + (7 * o_orderkey + l_suppkey) % 90)")} END AS arrived_at
        FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM (SELECT /*+ REPARTITION(l_orderkey) */ l_orderkey, l_suppkey FROM {{lineitem}}) AS lk) AS ls
        JOIN (SELECT DISTINCT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'received' WHEN 'P' THEN 'partial' ELSE 'submitted' END AS status, {d.ts("o_orderdate")} AS created_at
            FROM (SELECT /*+ REPARTITION(o_orderkey) */ o_orderkey, o_orderstatus, o_orderdate FROM {{orders}}) AS ok) AS os ON o_orderkey = l_orderkey
        JOIN (SELECT DISTINCT s_suppkey, s_nationkey FROM {{supplier}}) AS ss ON l_suppkey = s_suppkey"""
        if d.spark
        else f"""SELECT DISTINCT concat('O', o_orderkey, 'S', l_suppkey) AS id, concat('S', l_suppkey) AS supplier_id, concat('W', s_nationkey) AS destination_warehouse_id,
            CASE o_orderstatus WHEN 'F' THEN 'received' WHEN 'P' THEN 'partial' ELSE 'submitted' END AS status,
            {d.hours(d.ts("o_orderdate"), "1440")} AS expected_at, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE concat('M', s_nationkey % 3) END AS leadtime_model_id, {d.ts("o_orderdate")} AS created_at,
            CASE WHEN o_orderstatus = 'F' THEN {d.hours(d.ts("o_orderdate"), "24 * (10 + (7 * o_orderkey + l_suppkey) % 90)")} END AS arrived_at
        FROM {{orders}} JOIN {{lineitem}} ON o_orderkey = l_orderkey JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "po_lines": lambda d: """SELECT concat('Q', line_id) AS id, concat('O', l_orderkey, 'S', l_suppkey) AS purchase_order_id, concat('P', l_partkey) AS product_id, l_quantity AS qty_ordered,
            CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE 0 END * CAST(1 AS DOUBLE) AS qty_received FROM {lines}""",
    "shipments": lambda d: f"""SELECT concat('H', line_id) AS id, CASE WHEN l_returnflag = 'A' THEN 'inbound' ELSE 'outbound' END AS direction,
            concat('W', s_nationkey) AS origin_warehouse_id, concat('W', (s_nationkey + 7) % 25) AS destination_warehouse_id, concat('O', l_orderkey) AS order_id,
            CASE WHEN l_returnflag = 'A' THEN concat('O', l_orderkey, 'S', l_suppkey) END AS purchase_order_id,
            concat('T', s_nationkey, '-', (s_nationkey + 7) % 25) AS route_id, CASE WHEN l_linestatus = 'F' THEN 'delivered' ELSE 'in_transit' END AS status,
            l_shipdate AS shipped_at, CASE WHEN l_linestatus = 'F' THEN {d.hours("l_shipdate", "6 * (l_partkey % 7) + 12 * l_linenumber")} END AS arrived_at
        FROM {{lines}} JOIN {{supplier}} ON l_suppkey = s_suppkey""",
    "moves": lambda d: """SELECT concat('V', line_id) AS id, concat('P', l_partkey) AS product_id,
            CASE WHEN l_returnflag IN ('N', 'R') THEN concat('S', l_suppkey) END AS from_location_id,
            CASE WHEN l_returnflag = 'A' THEN concat('S', l_suppkey) WHEN l_returnflag = 'R' THEN concat('N', l_suppkey % 25) END AS to_location_id,
            CASE l_returnflag WHEN 'A' THEN 'inbound' WHEN 'N' THEN 'outbound' ELSE 'adjustment' END AS move_type, l_quantity AS qty, l_shipdate AS occurred_at,
            CASE WHEN l_linenumber = 7 THEN NULL ELSE concat(l_returnflag, l_linestatus) END AS reason_code, l_quantity AS reported_qty, round(l_quantity * (1 - l_discount), 2) AS actual_qty FROM {lines}""",
    "balances": lambda d: f"""SELECT concat(product_id, '@', location_id) AS id, product_id, location_id, greatest(sum(delta), 0) AS on_hand, round(greatest(sum(delta), 0) * 0.1, 4) AS reserved,
            max(occurred_at) AS last_count_at,
            CASE CAST(substr(product_id, 2) AS BIGINT) % 4 WHEN 0 THEN 'quarantined' WHEN 1 THEN 'damaged' ELSE 'ok' END AS quality_status
        FROM (SELECT product_id, to_location_id AS location_id, qty AS delta, occurred_at FROM {{moves}} WHERE to_location_id IS NOT NULL
              UNION ALL SELECT product_id, from_location_id, -qty, occurred_at FROM {{moves}} WHERE from_location_id IS NOT NULL) AS deltas
        GROUP BY product_id, location_id""",
    "devices": lambda d: """SELECT DISTINCT concat('D', user_id) AS id, concat('W', user_id % 25) AS warehouse_id, CASE user_id % 3 WHEN 0 THEN 'rfid' WHEN 1 THEN 'camera' ELSE 'scale' END AS device_type,
            1 + user_id % 9 * CAST(0.5 AS DOUBLE) AS noise_sigma, CAST(0.05 AS DOUBLE) * (user_id % 4) AS missing_rate, CAST(user_id % 5 AS DOUBLE) - 2 AS bias,
            CASE user_id % 3 WHEN 0 THEN 'offline' WHEN 1 THEN 'online' ELSE 'active' END AS status FROM {events}
        UNION ALL SELECT concat('D-', n_nationkey), concat('W', n_nationkey), 'rfid', CAST(1 AS DOUBLE), CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 'active' FROM {nation}""",
    "observations": lambda d: f"""SELECT concat('E', event_id) AS id, event_id, {d.ts("ts")} AS observed_at, concat('D', user_id) AS device_id, concat('P', event_id % 200) AS product_id, concat('N', event_id % 25) AS location_id,
            event_type AS obs_type, CASE WHEN event_type = 'error' THEN NULL ELSE value END AS observed_qty, {d.json_int("props", "k")} / CAST(100 AS DOUBLE) AS confidence, event_type = 'error' AS is_missing,
            CASE WHEN event_id % 10 = 0 THEN concat('V', event_id % 1000, '-', 1 + event_id % 7, '-1') END AS related_move_id FROM {{events}}""",
    "leadtime_models": lambda d: """SELECT concat('M', r_regionkey) AS id, CASE WHEN r_regionkey = 2 THEN 'global' ELSE 'supplier' END AS scope, 'normal' AS dist_family,
            7 + 2 * r_regionkey AS p1, CAST(1.5 AS DOUBLE) + r_regionkey AS p2, CAST(0.02 AS DOUBLE) * (1 + r_regionkey) AS p_rare_delay, 8 AS rare_delay_add_days FROM {region} WHERE r_regionkey < 3""",
    "chunks": lambda d: f"""SELECT concat('C', doc_id) AS chunk_id, doc_id AS load_order, doc_id % 500 AS vec_id, CASE WHEN doc_id % 6 = 0 THEN NULL WHEN doc_id % 97 = 0 THEN 'x' ELSE concat(1 + doc_id % 9, '.', 1 + doc_id % 41) END AS entity_id,
            CASE doc_id % 6 WHEN 0 THEN 'text' WHEN 1 THEN 'algorithm' WHEN 2 THEN 'example' WHEN 3 THEN 'numbered_formula' WHEN 4 THEN 'exercise' ELSE 'numbered_table' END AS chunk_type,
            text AS content, CAST(doc_id % 100 AS INT) AS page, lang AS part, source AS section_number, CASE WHEN doc_id % 5 = 0 THEN NULL ELSE concat('Title ', source) END AS section_title,
            CASE WHEN doc_id % 4 = 0 THEN concat(source, '.1') END AS subsection_number, CASE WHEN doc_id % 8 = 0 THEN 'Sub' END AS subsection_title, CASE WHEN doc_id % 7 = 0 THEN concat(source, '.1.1') END AS subsubsection_number, 'Deep' AS subsubsection_title,
            {d.array("concat(1 + (doc_id + 1) % 9, '.', 1 + (doc_id * 3) % 45)", "concat(1 + (doc_id + 4) % 9, '.', 1 + (doc_id * 7) % 45)")} AS referenced_algorithms, {d.array("concat(1 + (doc_id + 2) % 9, '.', 1 + (doc_id * 5) % 41)")} AS referenced_examples,
            {d.array("concat(1 + (doc_id + 3) % 9, '.', 1 + (doc_id * 11) % 43)")} AS referenced_formulas, {d.array("'3.2'", "'A.1'")} AS referenced_tables, {d.array("concat(1 + doc_id % 9, '.', 1 + doc_id % 12)")} AS referenced_figures, {d.array("'4.5'")} AS referenced_exercises,
            {d.array("concat('TAG_', doc_id % 7)", "concat('TAG_', doc_id % 5)")} AS bc_concepts, {d.array("concat('TABLE_', doc_id % 3)")} AS bc_db_tables, CASE WHEN doc_id % 3 = 0 THEN concat('C', doc_id + 1) WHEN doc_id % 3 = 1 THEN concat('Z', doc_id) END AS defined_in_chunk FROM {{documents}}""",
    "blocks": lambda d: f"""SELECT doc_id, CAST(floor(pos / 10.0) AS INT) AS page_num, pos AS block_id,
            CASE pos % 9 WHEN 8 THEN 'footnote' WHEN 7 THEN 'formula' WHEN 6 THEN 'formula_number' WHEN 5 THEN 'table' WHEN 4 THEN 'table_caption' ELSE 'text' END AS block_label,
            CASE WHEN pos % 9 = 8 THEN concat('$ ^{{{{', doc_id % 3, '}}}} $ ', line) WHEN pos % 9 = 6 THEN concat('(', doc_id % 9, '.', pos, ')') WHEN pos % 9 = 0 THEN concat('# ', 1 + doc_id % 5, CASE pos % 27 WHEN 0 THEN '' WHEN 9 THEN '.2' ELSE '.2.3' END, ' ', line)
              WHEN pos % 9 = 1 THEN concat(line, ' $ ^{{{{', doc_id % 2, '}}}} $ see Example 1.', doc_id % 7, ' and Equation (2.', pos, ')') ELSE line END AS block_content,
            {d.array("CAST(50 * (pos % 3) AS DOUBLE)", "CAST(80 * (pos % 10) AS DOUBLE)", "CAST(50 * (pos % 3) + 200 AS DOUBLE)", "CAST(80 * (pos % 10) + 40 AS DOUBLE)")} AS block_bbox
        FROM {d.lines("{documents}", "doc_id", "text")} AS l""",
    "regions": lambda d: f"""SELECT DISTINCT doc_id, page_num, CAST(page_num * 3 + r AS INT) AS region_id, {d.array("CAST(0 AS DOUBLE)", "CAST(240 * r AS DOUBLE)", "CAST(200 + 60 * r AS DOUBLE)", "CAST(240 * r + 300 AS DOUBLE)")} AS bbox
        FROM {{blocks}} CROSS JOIN (SELECT r_regionkey AS r FROM {{region}} WHERE r_regionkey < 3) AS rr""",
    "golden": lambda d: """SELECT concat('G', item_id) AS id, item_id, text AS question FROM {benchmark}""",
}

def needs(name: str, d: Dialect) -> list[str]:
    return re.findall(r"(?<!\{)\{(\w+)\}(?!\})", TABLES[name](d))


def load(spark: SparkSession, sf_dir: str, name: str, cache: dict | None = None) -> DataFrame:
    """A logical or given table. Timestamps are read as UTC moments."""
    cache = {} if cache is None else cache
    if name not in cache:
        if name in TABLES:
            d = Dialect(spark=True)
            parts = {x: load(spark, sf_dir, x, cache) for x in dict.fromkeys(needs(name, d))}
            cache[name] = spark.sql(TABLES[name](d), **parts)
        else:
            cache[name] = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return cache[name]


def with_clause(names: Iterable[str]) -> str:
    """WITH clause of the logical tables named and all they need, for an oracle engine."""
    d = Dialect(spark=False)
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES and name not in done:
            for x in needs(name, d):
                add(x)
            done[name] = f"{name} AS (" + re.sub(r"(?<!\{)\{(\w+)\}(?!\})", r"\1", TABLES[name](d)).replace("{{", "{").replace("}}", "}") + ")"

    for name in names:
        add(name)
    return ("WITH RECURSIVE " + ",\n".join(done.values())) if done else ""
