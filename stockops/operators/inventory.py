"""Inventory and observation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import at, by_keys, lowered, page, ratio, weighted_mean
from ..functions.durable import written
from ..functions.scan import BLOCK, running


def current_inventory(
    balances: DataFrame, products: DataFrame, locations: DataFrame, include_reserved: bool = True, location_id: str | None = None, warehouse_id: str | None = None, sku: str | None = None, product_id: str | None = None, offset: int = 0, limit: int | None = 50
) -> DataFrame:
    """Stock by product and location, least available first. A location filter outranks a warehouse filter."""
    p = products.select(F.col("id").alias("product_id"), "sku", F.col("name").alias("product_name"))
    loc = locations.select(F.col("id").alias("location_id"), "warehouse_id", "code")
    reserved = F.col("reserved") if include_reserved else F.lit(0.0)
    df = balances.select("product_id", "location_id", "on_hand", reserved.alias("reserved"), "quality_status").join(p, "product_id").join(loc, "location_id")
    if location_id is not None:
        df = df.where(F.col("location_id") == location_id)
    elif warehouse_id is not None:
        df = df.where(F.col("warehouse_id") == warehouse_id)
    if sku is not None:
        df = df.where(F.col("sku") == sku)
    if product_id is not None:
        df = df.where(F.col("product_id") == product_id)
    df = df.withColumn("available", F.col("on_hand") - F.col("reserved"))
    return page(df, [F.asc_nulls_last("available"), F.asc_nulls_last("sku"), F.asc_nulls_last("location_id")], offset, limit)


def window_of(df: DataFrame, column: str, start: str | None, end: str | None) -> DataFrame:
    """Rows with start <= column <= end; open ends where null."""
    if start is not None:
        df = df.where(F.col(column) >= at(start))
    if end is not None:
        df = df.where(F.col(column) <= at(end))
    return df


def of_keys(df: DataFrame, keys: DataFrame, max_bytes: int = 8 << 20, row_bytes: int = 128) -> DataFrame:
    """Rows of ``df`` whose keys stand in ``keys``, or all rows if the counted keys are too many to be broadcast.

    For a join that follows: where ``df`` sums facts by these keys, Spark takes the filter to the facts, and what
    no one asks for is neither summed nor shuffled.
    """
    return df.join(F.broadcast(keys), keys.columns, "left_semi") if keys.count() * row_bytes <= max_bytes else df


def observation_vs_balance(observations: DataFrame, balances: DataFrame, products: DataFrame, locations: DataFrame, start: str | None = None, end: str | None = None, warehouse_id: str | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """Confidence-weighted estimate against the book stock, largest discrepancy first.

    Observations are reduced to one row a key before any join, and all else to the keys observed.
    """
    seen = window_of(observations, "observed_at", start, end).where(~F.col("is_missing") & F.col("observed_qty").isNotNull())
    est = seen.groupBy("product_id", "location_id").agg(
        weighted_mean(F.col("observed_qty"), F.col("confidence")).alias("estimate"), F.count(F.lit(1)).alias("n_obs"), F.avg("confidence").alias("avg_confidence")
    )
    est = written(est, "estimates")
    loc, goods, book = locations.select(F.col("id").alias("location_id"), "warehouse_id"), products.select(F.col("id").alias("product_id"), "sku"), balances.select("product_id", "location_id", "on_hand")
    loc, goods, book = of_keys(loc, est.select("location_id")), of_keys(goods, est.select("product_id")), of_keys(book, est.select("product_id", "location_id"))
    if warehouse_id is not None:
        loc = loc.where(F.col("warehouse_id") == warehouse_id)
    df = est.join(loc, "location_id").join(goods, "product_id").join(book, ["product_id", "location_id"])
    df = df.withColumn("discrepancy", F.col("estimate") - F.col("on_hand"))
    return page(df, [F.desc_nulls_last(F.abs("discrepancy")), F.asc("sku"), F.asc("location_id")], offset, limit)


def latest_observation(observations: DataFrame) -> DataFrame:
    """Latest reading of each (product, location), missing readings included; then confidence, then id."""
    w = Window.partitionBy("product_id", "location_id").orderBy(F.desc("observed_at"), F.desc_nulls_last("confidence"), F.asc("id"))
    return observations.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def observed_snapshot(observations: DataFrame, balances: DataFrame, quality: list[str] | None = None, dev_mode: bool = False) -> DataFrame:
    """Latest reading of each key that has a balance; ``dev_mode`` adds the book stock."""
    b = balances.select("product_id", "location_id", "on_hand", "reserved", "quality_status")
    if quality:
        b = b.where(F.col("quality_status").isin(lowered(quality)))
    latest = written(latest_observation(observations), "latest")
    df = latest.join(of_keys(b, latest.select("product_id", "location_id")), ["product_id", "location_id"])
    return df if dev_mode else df.drop("on_hand", "reserved")


def list_moves(moves: DataFrame, locations: DataFrame, products: DataFrame | None = None, warehouse_id: str | None = None, product: str | None = None, move_type: str | None = None, start: str | None = None, end: str | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    """Moves, newest first. ``product`` is an id, or a sku if products are given and hold it."""
    df = window_of(moves, "occurred_at", start, end)
    if move_type is not None:
        df = df.where(F.col("move_type") == move_type.lower())
    if product is not None and products is not None:
        ids = products.where((F.col("id") == product) | (F.col("sku") == product)).select(F.col("id").alias("product_id"))
        df = df.join(ids, "product_id", "left_semi")
    elif product is not None:
        df = df.where(F.col("product_id") == product)
    loc = locations.select(F.col("id"), "warehouse_id")
    if warehouse_id is not None:
        here = loc.where(F.col("warehouse_id") == warehouse_id).select("id")
        touched = df.withColumn("at", F.explode(F.array_distinct(F.array_compact(F.array("from_location_id", "to_location_id")))))
        df = touched.join(here.withColumnRenamed("id", "at"), "at").drop("at").dropDuplicates(["id"])
    return page(df, [F.desc_nulls_last("occurred_at"), F.asc("id")], offset, limit)


def move_by_id(moves: DataFrame, keys) -> DataFrame:
    return by_keys(moves, keys)


def move_audit_trace(moves: DataFrame, observations: DataFrame) -> DataFrame:
    """All moves with their linked observations in order of time and id."""
    linked = observations.where(F.col("related_move_id").isNotNull()).groupBy(F.col("related_move_id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("observed_at", F.col("id").alias("observation_id"), "observed_qty"))).alias("trace"))
    return moves.join(linked, "id", "left").withColumn("trace", F.coalesce("trace", F.array().cast(linked.schema["trace"].dataType)))


def adjustments(moves: DataFrame, locations: DataFrame, warehouse_id: str | None = None, start: str | None = None, end: str | None = None, distinct_moves: bool = False) -> DataFrame:
    """Adjustment moves by known location touched. A move that touches two counts twice unless
    ``distinct_moves``; the OR-join is written as an exploded equi-join."""
    df = window_of(moves.where("move_type = 'adjustment'"), "occurred_at", start, end)
    df = df.withColumn("location_id", F.explode(F.array_distinct(F.array_compact(F.array("from_location_id", "to_location_id")))))
    loc = locations.select(F.col("id").alias("location_id"), "warehouse_id")
    if warehouse_id is not None:
        loc = loc.where(F.col("warehouse_id") == warehouse_id)
    df = df.join(loc, "location_id")
    return df.dropDuplicates(["id"]) if distinct_moves else df


def adjustments_summary(moves: DataFrame, locations: DataFrame, **filters) -> DataFrame:
    """Number and quantity of adjustments."""
    return adjustments(moves, locations, **filters).agg(F.count(F.lit(1)).alias("n_moves"), F.coalesce(F.sum("qty"), F.lit(0.0)).alias("total_qty"))


def adjustments_by_reason(moves: DataFrame, locations: DataFrame, **filters) -> DataFrame:
    """The same by reason, null last."""
    return adjustments(moves, locations, **filters).groupBy("reason_code").agg(F.count(F.lit(1)).alias("n_moves"), F.sum("qty").alias("total_qty")).orderBy(F.asc_nulls_last("reason_code"))


def deltas(moves: DataFrame) -> DataFrame:
    """Signed quantities: + at the destination, - at the origin."""
    both = F.array(F.struct(F.col("to_location_id").alias("location_id"), F.col("qty").alias("delta")), F.struct(F.col("from_location_id").alias("location_id"), (-F.col("qty")).alias("delta")))
    return moves.select("id", "product_id", "occurred_at", F.explode(both).alias("d")).select("id", "product_id", "occurred_at", "d.*").where("location_id is not null")


def replay_balances(moves: DataFrame, balances: DataFrame) -> DataFrame:
    """Stock from the log against materialised stock; either side may be absent."""
    log = deltas(moves).groupBy("product_id", "location_id").agg(F.sum("delta").alias("replayed"))
    df = log.join(balances.select("product_id", "location_id", "on_hand"), ["product_id", "location_id"], "full_outer")
    return df.withColumn("diff", F.coalesce("on_hand", F.lit(0.0)) - F.coalesce("replayed", F.lit(0.0)))


def negative_stock_violations(moves: DataFrame, block: int = BLOCK) -> DataFrame:
    """First move of each key after which the running stock is below zero. Keys of more than ``block`` rows are
    summed in ranges."""
    sums = running(deltas(moves), ["product_id", "location_id"], ["occurred_at", "id", "delta"], {"running": F.col("delta")}, block=block)
    first = F.min(F.struct("occurred_at", "id", "delta", "running")).alias("first")
    return sums.where("running < 0").groupBy("product_id", "location_id").agg(first).select("product_id", "location_id", "first.occurred_at", "first.id", "first.running")


def apply_receipts(balances: DataFrame, receipts: DataFrame) -> DataFrame:
    """Merge of (product_id, location_id, qty) into balances: insert or add."""
    both = balances.select("product_id", "location_id", F.col("on_hand").alias("qty")).unionByName(receipts.select("product_id", "location_id", "qty"))
    return both.groupBy("product_id", "location_id").agg(F.sum("qty").alias("on_hand"))


def arrivals_due(shipments: DataFrame, po_lines: DataFrame, docks: DataFrame, as_of: str) -> DataFrame:
    """Receipt lines of shipments that have arrived, with the reason where none can be made.

    ``docks``: (warehouse_id, dock_id), one dock a warehouse.
    """
    due = shipments.where((F.col("status") == "in_transit") & (F.col("direction") == "inbound") & (F.coalesce("arrived_at", "shipped_at") <= at(as_of)))
    docks = docks.select(F.col("warehouse_id").alias("destination_warehouse_id"), "dock_id")
    due = due.join(docks, "destination_warehouse_id", "left")
    reject = F.when(F.col("purchase_order_id").isNull(), "no_purchase_order").when(F.col("destination_warehouse_id").isNull(), "no_destination").when(F.col("dock_id").isNull(), "no_dock")
    due = due.withColumn("reject", reject)
    lines = po_lines.select("purchase_order_id", F.col("id").alias("po_line_id"), "product_id", F.col("qty_ordered").alias("qty"))
    good = due.where("reject is null").join(lines, "purchase_order_id")
    cols = ["id", "purchase_order_id", "dock_id", "product_id", "qty", "reject"]
    bad = due.where("reject is not null").select("id", "purchase_order_id", "dock_id", F.lit(None).cast("string").alias("product_id"), F.lit(None).cast("double").alias("qty"), "reject")
    return good.select(cols).union(bad)


def allocate_fcfs(lines: DataFrame, stock: DataFrame, penalty_rate: float = 10.0, block: int = BLOCK) -> DataFrame:
    """First come, first served: each line gets what earlier ones left. lines: id, product_id, ts, qty;
    stock: product_id, stock. The fill in closed form: greatest(0, least(qty, stock - demand before)).
    Products of more than ``block`` lines are summed in ranges."""
    df = running(lines, ["product_id"], ["ts", "id"], {"before": F.col("qty")}, exclusive=True, block=block).join(stock, "product_id", "left")
    shipped = F.greatest(F.lit(0.0), F.least("qty", F.coalesce("stock", F.lit(0.0)) - F.col("before")))
    df = df.withColumn("shipped", shipped).withColumn("penalty", (F.col("qty") - F.col("shipped")) * penalty_rate)
    return df.withColumn("status", F.when(F.col("shipped") > 0, "shipped").otherwise("cancelled")).drop("before")


def reorder_review(products: DataFrame, docks: DataFrame, balances: DataFrame, reorder_point: float = 20.0, target: float = 100.0) -> DataFrame:
    """Keys below the reorder point with the quantity up to the target; no balance counts as zero.

    Every product is reviewed at every dock: the docks are exploded from one array, a dimension of
    one row a warehouse.
    """
    where = docks.agg(F.collect_set("dock_id").alias("docks"))
    keys = products.select(F.col("id").alias("product_id")).join(F.broadcast(where)).select("product_id", F.explode("docks").alias("location_id"))
    df = keys.join(balances.select("product_id", "location_id", "on_hand"), ["product_id", "location_id"], "left").withColumn("on_hand", F.coalesce("on_hand", F.lit(0.0)))
    return df.where(F.col("on_hand") < reorder_point).withColumn("order_qty", F.lit(target) - F.col("on_hand"))


def utilization_by_location(observations: DataFrame, locations: DataFrame, start: str, end: str, warehouse_id: str | None = None) -> DataFrame:
    """Observed stock against capacity: weighted mean by key, then summed by location; all locations stay."""
    seen = window_of(observations, "observed_at", start, end).where(~F.col("is_missing") & F.col("observed_qty").isNotNull())
    keys = seen.groupBy("location_id", "product_id").agg(
        weighted_mean(F.col("observed_qty"), F.col("confidence")).alias("qty_hat"), F.avg("confidence").alias("conf_hat"), F.count(F.lit(1)).alias("n")
    )
    by_loc = keys.groupBy("location_id").agg(F.sum("qty_hat").alias("observed_qty"), F.avg("conf_hat").alias("avg_confidence"), F.sum("n").alias("n_obs"))
    loc = locations if warehouse_id is None else locations.where(F.col("warehouse_id") == warehouse_id)
    loc = loc.select(F.col("id").alias("location_id"), "warehouse_id", "code", "capacity_units")
    df = loc.join(by_loc, "location_id", "left").withColumn("n_obs", F.coalesce("n_obs", F.lit(0)))
    df = df.withColumn("utilization", F.when(F.col("capacity_units") > 0, ratio(F.col("observed_qty"), F.col("capacity_units"))))
    return df.orderBy(F.desc_nulls_last("utilization"), F.asc("code"), F.asc("location_id"))
