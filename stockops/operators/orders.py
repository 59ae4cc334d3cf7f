"""Orders, shipments and procurement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, by_keys, hours_between, lowered, page, plus_hours


def at_risk_orders(orders: DataFrame, lines: DataFrame, products: DataFrame, as_of: str, horizon_hours: float = 48, min_sla: float = 0.7, top_skus: int = 3, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """Promised soon, high priority, and not covered; largest exposure first."""
    now = at(as_of)
    due = orders.where(F.col("promised_at").isNotNull() & (F.col("promised_at") <= plus_hours(now, horizon_hours)) & (F.col("sla_priority") >= min_sla))
    due = due.select(F.col("id").alias("order_id"), "promised_at", "sla_priority", "customer_name")
    sku = products.select(F.col("id").alias("product_id"), "sku")
    df = lines.select("order_id", "product_id", "qty_ordered", "qty_allocated", "qty_shipped", "service_level_penalty").join(due, "order_id").join(sku, "product_id")
    df = df.withColumn("open_qty", F.greatest(F.col("qty_ordered") - F.col("qty_allocated"), F.lit(0.0)))
    df = df.withColumn("risky", (F.col("open_qty") > 0) | ((F.col("qty_shipped") < F.col("qty_ordered")) & (F.col("promised_at") <= plus_hours(now, 24))))
    per = df.groupBy("order_id", "promised_at", "sla_priority", "customer_name").agg(
        F.count(F.lit(1)).alias("total_lines"), F.sum(F.when(F.col("risky"), 1).otherwise(0)).alias("risk_lines"), F.sum("open_qty").alias("open_qty"), F.sum(F.col("service_level_penalty") * F.col("open_qty")).alias("exposure")
    )
    w = Window.partitionBy("order_id").orderBy(F.desc("short"), F.asc("sku"))
    missing = df.groupBy("order_id", "sku").agg(F.sum("open_qty").alias("short")).where("short > 0").withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= top_skus)
    missing = missing.groupBy("order_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "sku"))), lambda x: x["sku"]).alias("missing_skus"))
    out = per.where("risk_lines > 0").join(missing, "order_id", "left")
    return page(out, [F.desc("exposure"), F.asc("promised_at"), F.asc("order_id")], offset, limit)


def shipment_delays(shipments: DataFrame, as_of: str, start: str | None = None, end: str | None = None, warehouse_id: str | None = None, route_id: str | None = None, status: str | None = None, late_hours: float = 48) -> DataFrame:
    """Shipments with transit_hours, is_delayed (null while undecided) and reason."""
    df = shipments
    if start is not None:
        df = df.where(F.col("shipped_at") >= at(start))
    if end is not None:
        df = df.where(F.col("shipped_at") <= at(end))
    if warehouse_id is not None:
        df = df.where((F.col("origin_warehouse_id") == warehouse_id) | (F.col("destination_warehouse_id") == warehouse_id))
    if route_id is not None:
        df = df.where(F.col("route_id") == route_id)
    if status is not None:
        df = df.where(F.col("status") == status.lower())
    transit = hours_between(F.col("shipped_at"), F.col("arrived_at"))
    overdue = F.col("arrived_at").isNull() & (F.col("shipped_at") < plus_hours(at(as_of), -late_hours))
    df = df.withColumn("transit_hours", transit).withColumn("is_delayed", overdue | (transit > late_hours))
    return df.withColumn("reason", F.when(overdue, "not arrived").when(transit > late_hours, "transit too long"))


def shipment_delay_summary(shipments: DataFrame, as_of: str, **filters) -> DataFrame:
    """Counts and mean transit; an undecided shipment is not delayed."""
    df = shipment_delays(shipments, as_of, **filters)
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        count(F.col("arrived_at").isNotNull()).alias("delivered"),
        count(F.col("arrived_at").isNull()).alias("in_transit"),
        count(F.col("is_delayed").eqNullSafe(True)).alias("delayed"),
        F.avg("transit_hours").alias("avg_transit_hours"),
    )


def delayed_shipments(shipments: DataFrame, as_of: str, limit: int | None = 20, **filters) -> DataFrame:
    """Delayed ones, longest ago first."""
    df = shipment_delays(shipments, as_of, **filters).where(F.col("is_delayed").eqNullSafe(True))
    return page(df, [F.asc_nulls_last("shipped_at"), F.asc("id")], 0, limit)


def list_suppliers(suppliers: DataFrame, region: str | None = None, min_reliability: float | None = None, max_reliability: float | None = None, name_like: str | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    df = suppliers
    if region is not None:
        df = df.where(F.col("region") == region)
    if min_reliability is not None:
        df = df.where(F.col("reliability_score") >= min_reliability)
    if max_reliability is not None:
        df = df.where(F.col("reliability_score") <= max_reliability)
    if name_like is not None:
        df = df.where(F.col("name").ilike(f"%{name_like}%"))
    return page(df, [F.asc("name"), F.asc("id")], offset, limit)


def supplier_by_id(suppliers: DataFrame, keys) -> DataFrame:
    return by_keys(suppliers, keys)


def with_names(pos: DataFrame, suppliers: DataFrame | None, warehouses: DataFrame | None) -> DataFrame:
    """Names by inner join where a table is given, else null: an unused join is not made."""
    text = F.lit(None).cast("string")
    pos = pos.join(suppliers.select(F.col("id").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id") if suppliers is not None else pos.withColumn("supplier_name", text)
    return pos.join(warehouses.select(F.col("id").alias("destination_warehouse_id"), F.col("name").alias("warehouse_name")), "destination_warehouse_id") if warehouses is not None else pos.withColumn("warehouse_name", text)


def list_purchase_orders(
    pos: DataFrame, suppliers: DataFrame | None = None, warehouses: DataFrame | None = None, supplier_id: str | None = None, warehouse_id: str | None = None, statuses: Sequence[str] | None = None,
    created: tuple[str | None, str | None] = (None, None), expected: tuple[str | None, str | None] = (None, None), offset: int = 0, limit: int | None = 50,
) -> DataFrame:
    df = pos
    if supplier_id is not None:
        df = df.where(F.col("supplier_id") == supplier_id)
    if warehouse_id is not None:
        df = df.where(F.col("destination_warehouse_id") == warehouse_id)
    if statuses:
        df = df.where(F.col("status").isin(lowered(statuses)))
    for column, (low, high) in (("created_at", created), ("expected_at", expected)):
        if low is not None:
            df = df.where(F.col(column) >= at(low))
        if high is not None:
            df = df.where(F.col(column) <= at(high))
    return page(with_names(df, suppliers, warehouses), [F.desc_nulls_last("created_at"), F.asc("id")], offset, limit)


def purchase_order_by_id(pos: DataFrame, keys, suppliers: DataFrame | None = None, warehouses: DataFrame | None = None) -> DataFrame:
    return with_names(by_keys(pos, keys), suppliers, warehouses)


def remaining() -> Column:
    return F.greatest(F.coalesce("qty_ordered", F.lit(0.0)) - F.coalesce("qty_received", F.lit(0.0)), F.lit(0.0))


def po_lines_view(lines: DataFrame, products: DataFrame | None = None, po_ids=None, product_id: str | None = None) -> DataFrame:
    df = lines if po_ids is None else by_keys(lines, po_ids, "purchase_order_id")
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    df = df.withColumn("remaining", remaining())
    return df if products is None else df.join(products.select(F.col("id").alias("product_id"), "sku", F.col("name").alias("product_name")), "product_id")


def procurement_pipeline(pos: DataFrame, lines: DataFrame, statuses: Sequence[str] = ("draft", "submitted", "partial"), as_of: str | None = None, horizon_days: float | None = None) -> DataFrame:
    """Open quantities by warehouse, by supplier and by both, in one pass of grouping sets."""
    df = pos.where(F.col("status").isin(lowered(statuses)))
    if as_of is not None and horizon_days is not None:
        df = df.where(F.col("expected_at") <= plus_hours(at(as_of), 24 * horizon_days))
    df = df.select(F.col("id").alias("purchase_order_id"), "supplier_id", F.col("destination_warehouse_id").alias("warehouse_id"), "expected_at", "created_at")
    sums = lines.groupBy("purchase_order_id").agg(
        F.sum(F.coalesce("qty_ordered", F.lit(0.0))).alias("qty_ordered"), F.sum(F.coalesce("qty_received", F.lit(0.0))).alias("qty_received"), F.sum(remaining()).alias("remaining")
    )
    df = df.join(sums, "purchase_order_id")
    w, s = F.col("warehouse_id"), F.col("supplier_id")
    out = df.groupingSets([[w], [s], [w, s]], w, s).agg(
        F.grouping_id().alias("gid"), F.count_distinct("purchase_order_id").alias("po_count"), F.sum("qty_ordered").alias("qty_ordered"), F.sum("qty_received").alias("qty_received"), F.sum("remaining").alias("remaining"), F.min("expected_at").alias("next_expected"), F.max("created_at").alias("last_created")
    )
    mode = F.when(F.col("gid") == 1, "warehouse").when(F.col("gid") == 2, "supplier").otherwise("both")
    return out.withColumn("mode", mode).drop("gid").orderBy(F.asc_nulls_last("next_expected"), F.desc("remaining"))


def route_tiering(pairs: DataFrame) -> DataFrame:
    """(origin_id, destination_id, distance_km) with the mode of each pair of different warehouses."""
    d = F.col("distance_km")
    return pairs.where("origin_id <> destination_id").withColumn("mode", F.when(d < 800, "truck").when(d < 5000, "air").otherwise("sea"))


def form_options(warehouses: DataFrame, suppliers: DataFrame, products: DataFrame, routes: DataFrame) -> DataFrame:
    """Distinct choices: names of warehouses and suppliers, products with category, modes."""
    text = F.lit(None).cast("string")
    names = warehouses.select(F.lit("name").alias("kind"), F.col("name").alias("value"), text.alias("detail")).union(suppliers.select(F.lit("name"), F.col("name"), text))
    rest = products.select(F.lit("product"), F.col("name"), F.col("category")).union(routes.select(F.lit("mode"), F.col("mode"), text))
    return names.union(rest).distinct().orderBy("kind", "value", F.asc_nulls_last("detail"))
