"""Warehouses, locations, devices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import at, by_keys, labels, page, plus_hours, ratio
from ..functions.durable import written
from ..functions.forest import contracted
from ..functions.scan import BLOCK, running
from .inventory import utilization_by_location


def list_warehouses(warehouses: DataFrame, region: str | None = None, name_like: str | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    df = warehouses if region is None else warehouses.where(F.col("region") == region)
    df = df if name_like is None else df.where(F.col("name").ilike(f"%{name_like}%"))
    return page(df, [F.asc("name"), F.asc("id")], offset, limit)


def warehouse_by_id(warehouses: DataFrame, keys) -> DataFrame:
    return by_keys(warehouses, keys)


def list_locations(locations: DataFrame, warehouse_id: str | None = None, parent_id: str | None = None, type: str | None = None, code_like: str | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    df = locations
    for column, value in (("warehouse_id", warehouse_id), ("parent_location_id", parent_id), ("type", None if type is None else type.lower())):
        if value is not None:
            df = df.where(F.col(column) == value)
    df = df if code_like is None else df.where(F.col("code").ilike(f"%{code_like}%"))
    return page(df, [F.asc("code"), F.asc("id")], offset, limit)


def location_by_id(locations: DataFrame, keys) -> DataFrame:
    return by_keys(locations, keys)


def locations_tree(locations: DataFrame, paths: bool = False) -> DataFrame:
    """Forest by parent, of any depth: id, parent_id (null at a root), root_id, depth, code, capacity_units.

    A parent that is null or not in the set makes a root. Rows on a cycle, or below one, are left out. Memory is
    one row for each location; ``paths`` adds the ids from the root down, which a chain makes quadratic.
    """
    nodes = locations.select("id", F.col("parent_location_id").alias("parent"))
    tree = contracted(nodes).withColumn("depth", F.col("depth").cast("int")).join(locations.select("id", "parent_location_id", "code", "capacity_units"), "id")
    tree = tree.select("id", F.when(F.col("depth") > 0, F.col("parent_location_id")).alias("parent_id"), "root_id", "depth", "code", "capacity_units")
    return tree.join(paths_from_roots(tree), "id") if paths else tree


def paths_from_roots(tree: DataFrame) -> DataFrame:
    """(id, path): ids from the root. Every round doubles the part of each path that is known."""
    rounds = max(0, tree.agg(F.max("depth")).head()[0] or 0).bit_length()
    nodes = tree.select("id", F.col("parent_id").alias("up"), F.array("id").alias("path"))
    for _ in range(rounds):
        above = nodes.select(F.col("id").alias("up"), F.col("up").alias("further"), F.col("path").alias("before"))
        grown = nodes.where("up is not null").join(above, "up").select("id", F.col("further").alias("up"), F.concat("before", "path").alias("path"))
        nodes = written(nodes.where("up is null").union(grown), "paths")
    return nodes.select("id", "path")


def sibling_order(tree: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rank among siblings by (code, id); roots are siblings of each other."""
    return running(tree, ["parent_id"], ["code", "id"], {"sibling_rank": F.lit(1)}, block=block)


def subtree_rollup(tree: DataFrame) -> DataFrame:
    """Capacity and number of nodes below and at every node, of locations or of their tree."""
    parent = F.col("parent_id" if "parent_id" in tree.columns else "parent_location_id")
    nodes = tree.select("id", parent.alias("parent"), F.coalesce(F.col("capacity_units").cast("long"), F.lit(0)).alias("capacity_units"), F.lit(1).cast("long").alias("n_nodes"))
    return contracted(nodes, ["capacity_units", "n_nodes"]).select("id", "capacity_units", "n_nodes")


def capacity_utilization(observations: DataFrame, locations: DataFrame, snapshot_at: str | None = None, lookback_hours: float | None = None, start: str | None = None, end: str | None = None, warehouse_id: str | None = None) -> DataFrame:
    """Utilization of every location in a window given by exactly one of the two modes."""
    if (snapshot_at is None) == (start is None or end is None):
        raise ValueError("give either snapshot_at with lookback_hours, or start and end")
    if snapshot_at is not None:
        observations = observations.where((F.col("observed_at") >= plus_hours(at(snapshot_at), -(lookback_hours or 24))) & (F.col("observed_at") <= at(snapshot_at)))
    return utilization_by_location(observations, locations, start, end, warehouse_id)


def warehouse_utilization_total(utilization: DataFrame) -> DataFrame:
    """Observed total over capacity by warehouse; null without any observation."""
    df = utilization.groupBy("warehouse_id").agg(F.sum("observed_qty").alias("observed_qty"), F.sum("capacity_units").alias("capacity_units"), F.sum("n_obs").alias("n_obs"))
    return df.withColumn("utilization", F.when(F.col("capacity_units") > 0, ratio(F.col("observed_qty"), F.col("capacity_units"))))


def list_devices(devices: DataFrame, warehouse_id: str | None = None, device_type: str | None = None, status: str | None = None, offset: int = 0, limit: int | None = 50) -> DataFrame:
    df = devices
    for column, value in (("warehouse_id", warehouse_id), ("device_type", device_type and device_type.lower()), ("status", status and status.lower())):
        if value is not None:
            df = df.where(F.col(column) == value)
    return page(df, [F.asc("warehouse_id"), F.asc("id")], offset, limit)


def device_by_id(devices: DataFrame, keys) -> DataFrame:
    return by_keys(devices, keys)


def device_health(devices: DataFrame, observations: DataFrame, as_of: str, window_hours: float = 24) -> DataFrame:
    """Readings of each device in the window; all devices stay.

    A device without readings reports one null quantity, the null-extended row of the outer join.
    Readings are reduced before the join, so only one row a device meets it.
    """
    now = at(as_of)
    seen = observations.where((F.col("observed_at") >= plus_hours(now, -window_hours)) & (F.col("observed_at") <= now))
    per = seen.groupBy(F.col("device_id").alias("id")).agg(
        F.max("observed_at").alias("last_seen"),
        F.count(F.lit(1)).alias("n_obs"),
        F.sum(F.col("is_missing").cast("int")).alias("n_missing"),
        F.sum(F.col("observed_qty").isNull().cast("int")).alias("n_null"),
        # a mean of doubles depends on their order
        F.avg(F.col("confidence").cast("decimal(18,9)")).cast("double").alias("avg_confidence"),
    )
    zero = F.lit(0).cast("long")
    return devices.join(per, "id", "left").withColumns(
        {"n_obs": F.coalesce("n_obs", zero), "n_missing": F.coalesce("n_missing", zero), "n_null": F.coalesce("n_null", F.lit(1).cast("long"))}
    )


def check_window(hours) -> None:
    if isinstance(hours, bool) or not isinstance(hours, int | float) or not 1 <= hours <= 720:
        raise ValueError("window_hours must be a number from 1 to 720")


def device_anomaly_candidates(devices: DataFrame, observations: DataFrame, as_of: str, window_hours: float = 24) -> DataFrame:
    """Observed missing rate in the window, highest first, null last."""
    check_window(window_hours)
    df = device_health(devices, observations, as_of, window_hours).drop("last_seen", "n_null")
    df = df.withColumn("observed_missing_rate", ratio(F.col("n_missing"), F.nullif(F.col("n_obs"), F.lit(0))))
    return df.orderBy(F.desc_nulls_last("observed_missing_rate"), F.asc("id"))


def anomaly_labels(min_confidence: float) -> Column:
    """status, n_obs, observed_missing_rate, missing_rate, avg_confidence -> the anomalies of a device."""
    return labels(
        ((F.col("status") == "offline") & (F.col("n_obs") > 0), "offline_with_observations"),
        ((F.col("status") != "offline") & (F.col("n_obs") == 0), "online_without_observations"),
        (F.col("observed_missing_rate") > F.col("missing_rate"), "missing_rate_spike"),
        (F.round("avg_confidence", 9) < min_confidence, "low_confidence"),
    )


def device_anomalies(devices: DataFrame, observations: DataFrame, as_of: str, window_hours: float = 24, min_confidence: float = 0.5) -> DataFrame:
    """Devices with at least one anomaly label."""
    df = device_anomaly_candidates(devices, observations, as_of, window_hours)
    return df.withColumn("anomalies", anomaly_labels(min_confidence)).where(F.size("anomalies") > 0)
