"""Device anomalies over time, silent devices included: state with timers, one clock tick an hour.

A windowed aggregate says nothing of a device from which no row comes. Here every known device has a timer;
when the watermark passes a tick, the device reports on the window that ends there, rows or no rows.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.python import ship
from ..operators.topology import anomaly_labels

ship(__name__)

HOUR = 3_600_000
REPORT = "device_id string, as_of timestamp, n_obs long, n_missing long, confidence long, n_confidence long"

#: Confidences are summed as integers of this unit, so sums do not depend on the order of rows.
UNIT = 1_000_000_000


class Clock(StatefulProcessor):
    """Counts of each hour of a device, and a report at each tick from ``start`` on."""

    def __init__(self, start: int, window: int, step: int = HOUR):
        self.start, self.window, self.step = start, window, step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour long", "n_obs long, n_missing long, confidence long, n_confidence long")
        self.next = handle.getValueState("next", "tick long")

    def _wind(self, tick: int) -> None:
        self.next.update((tick,))
        self.handle.registerTimer(tick)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self._wind(self.start)

    def handleInputRows(self, key, rows, timerValues):
        for pdf in rows:
            hours = -(-pdf["at"] // self.step) * self.step  # a reading belongs to the hour that ends with it
            sums = pd.DataFrame({"h": hours, "n": 1, "m": pdf["missing"], "c": pdf["confidence"].fillna(0), "k": pdf["confidence"].notna().astype("int64")}).groupby("h").sum()
            for h, *new in sums.itertuples():
                old = self.hours.getValue((int(h),)) if self.hours.containsKey((int(h),)) else (0, 0, 0, 0)
                self.hours.updateValue((int(h),), tuple(int(a) + int(b) for a, b in zip(old, new, strict=True)))
        if not self.next.exists():
            self._wind(self.start)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, tick = timerValues.getCurrentWatermarkInMs(), self.next.get()[0]
        if tick > now:
            return
        held = {h[0]: tuple(map(int, v)) for h, v in self.hours.iterator()}
        out = []
        while tick <= now:
            inside = [v for h, v in held.items() if tick - self.window < h <= tick]
            out.append((key[0], pd.Timestamp(tick, unit="ms"), *(sum(v[i] for v in inside) for i in range(4))))
            tick += self.step
        for h in held:
            if h <= tick - self.window:
                self.hours.removeKey((h,))
        self._wind(tick)
        yield pd.DataFrame(out, columns=["device_id", "as_of", "n_obs", "n_missing", "confidence", "n_confidence"])

    def close(self) -> None:
        pass


def stream_device_anomalies(readings: DataFrame, devices: DataFrame, start: str, window_hours: int = 24, min_confidence: float = 0.5, delay: str = "1 hour") -> DataFrame:
    """Anomalies of every device at every full hour from ``start`` on, in append mode: id, as_of, n_obs,
    n_missing, observed_missing_rate, avg_confidence, anomalies.

    readings: device_id, observed_at, is_missing, confidence, a stream; devices: id, status, missing_rate, a
    table. At each tick a row equals that of the batch operator at that moment, but that a reading at the very
    start of the window is no longer in it. Ticks are reported once the watermark passes them, so readings up to
    ``delay`` late are in; later ones go. State is one count for each hour of the window and device. Needs
    the RocksDB state store (``spark.sql.streaming.stateStore.providerClass``).
    """
    moment = readings.sparkSession.range(1).select(F.unix_millis(F.lit(start).cast("timestamp"))).head()[0]
    whole = F.round(F.col("confidence") * UNIT).cast("long")
    rows = readings.where("observed_at is not null and device_id is not null").withWatermark("observed_at", delay)
    rows = rows.select(F.col("device_id"), "observed_at", F.unix_millis("observed_at").alias("at"), F.coalesce("is_missing", F.lit(False)).cast("long").alias("missing"), whole.alias("confidence"))
    known = devices.select(F.col("id").alias("device_id")).distinct()
    reports = rows.groupBy("device_id").transformWithStateInPandas(
        statefulProcessor=Clock(moment, window_hours * HOUR), outputStructType=REPORT, outputMode="Append", timeMode="EventTime", initialState=known.groupBy("device_id")
    )
    rate = F.try_divide(F.col("n_missing").cast("double"), F.col("n_obs"))
    mean = F.try_divide(F.col("confidence").cast("double"), F.col("n_confidence") * UNIT)
    met = reports.join(devices.select(F.col("id").alias("device_id"), "status", "missing_rate"), "device_id").withColumns({"observed_missing_rate": rate, "avg_confidence": mean})
    met = met.withColumn("anomalies", anomaly_labels(min_confidence)).where(F.size("anomalies") > 0)
    return met.select(F.col("device_id").alias("id"), "as_of", "n_obs", "n_missing", "observed_missing_rate", "avg_confidence", "anomalies")
