"""Streaming twins of sensor queries; on the same rows they equal the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def stream_latest_snapshot(observations: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Latest reading of each (product, location) in update mode.

    Order: observed_at, then confidence (null lowest), then the smaller event_id. State is one row a key.
    """
    order = F.struct("observed_at", F.coalesce("confidence", F.lit(-1.0)), -F.col("event_id"))
    row = F.struct("event_id", "device_id", "observed_qty", "confidence", "is_missing")
    df = observations.withWatermark("observed_at", delay) if observations.isStreaming else observations
    out = df.groupBy("product_id", "location_id").agg(F.max_by(row, order).alias("r"), F.max("observed_at").alias("observed_at"))
    return out.select("product_id", "location_id", "observed_at", "r.*")


def stream_device_health(observations: DataFrame, delay: str = "1 hour", window: str = "24 hours", slide: str = "1 hour") -> DataFrame:
    """Counts and missing rate of each device in event-time windows; late rows past the watermark go."""
    df = observations.withWatermark("observed_at", delay) if observations.isStreaming else observations
    out = df.groupBy(F.window("observed_at", window, slide).alias("w"), "device_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(F.col("is_missing").cast("int")).alias("n_missing"), F.sum(F.col("observed_qty").isNull().cast("int")).alias("n_null"), F.avg("confidence").alias("avg_confidence"), F.max("observed_at").alias("last_seen")
    )
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "device_id", "n_obs", "n_missing", "n_null", "avg_confidence", "last_seen", F.try_divide("n_missing", "n_obs").alias("missing_rate"))


def stream_device_panes(observations: DataFrame, delay: str = "1 hour", pane: str = "1 hour") -> DataFrame:
    """Sums of each device in panes as long as the slide of its windows, for ``windows_of_panes``.

    State is one row a device and pane, where windows that overlap keep one each. A pane closes with the
    watermark, so ``delay`` also covers what windows still open need.
    """
    df = observations.withWatermark("observed_at", delay) if observations.isStreaming else observations
    out = df.groupBy(F.window("observed_at", pane).alias("w"), "device_id").agg(
        F.count(F.lit(1)).alias("n_obs"), F.sum(F.col("is_missing").cast("int")).alias("n_missing"), F.sum(F.col("observed_qty").isNull().cast("int")).alias("n_null"), F.sum("confidence").alias("confidence"), F.count("confidence").alias("n_confidence"), F.max("observed_at").alias("last_seen")
    )
    return out.select(F.col("w.start").alias("pane_start"), "device_id", "n_obs", "n_missing", "n_null", "confidence", "n_confidence", "last_seen")


def windows_of_panes(panes: DataFrame, hours: int = 24) -> DataFrame:
    """Panes of an hour as windows of ``hours`` that slide by one: the columns of ``stream_device_health``."""
    start = F.explode(F.sequence(F.lit(0), F.lit(hours - 1)))
    each = panes.withColumn("back", start).withColumn("window_start", F.timestamp_micros(F.unix_micros("pane_start") - F.col("back") * F.lit(3_600_000_000)))
    out = each.groupBy("window_start", "device_id").agg(
        F.sum("n_obs").alias("n_obs"), F.sum("n_missing").alias("n_missing"), F.sum("n_null").alias("n_null"), F.try_divide(F.sum("confidence"), F.sum("n_confidence")).alias("avg_confidence"), F.max("last_seen").alias("last_seen")
    )
    end = F.timestamp_micros(F.unix_micros("window_start") + F.lit(hours * 3_600_000_000))
    return out.select("window_start", end.alias("window_end"), "device_id", "n_obs", "n_missing", "n_null", "avg_confidence", "last_seen", F.try_divide("n_missing", "n_obs").alias("missing_rate"))


def run_to_table(stream: DataFrame, keys: list[str], folder: str) -> DataFrame:
    """Run an aggregate in update mode until its source is used up, and read its table.

    Every batch appends the rows that it changed to a folder of its own, so no batch rewrites what others
    wrote and one that is repeated replaces itself; reading keeps the row of the last batch of each key.
    State older than the stream's watermark is dropped.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")

    stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    rows = stream.sparkSession.read.parquet(f"{folder}/rows")
    last = Window.partitionBy(*keys).orderBy(F.desc("batch"))
    return rows.withColumn("rn", F.row_number().over(last)).where("rn = 1").drop("rn", "batch")
