"""The stream of device anomalies against the batch operator at every hour."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from stockops.operators import topology
from stockops.streaming.silence import stream_device_anomalies

T0 = datetime(2024, 1, 1)
READING = "id string, device_id string, observed_at timestamp, observed_qty double, confidence double, is_missing boolean"


def test_stream_reports_silent_devices_at_every_hour(spark, tmp_path):
    rng = random.Random(7)
    devices = spark.createDataFrame([("a", "online", 0.2), ("b", "online", 0.0), ("c", "offline", 0.5), ("never", "online", 0.1), ("d", "online", 0.3)], "id string, status string, missing_rate double")
    rows = []
    for minute in range(0, 12 * 60, 7):
        for d in "abcd":
            if (d == "b" and minute > 200) or (d == "c" and not 300 < minute < 330) or rng.random() < 0.5:
                continue  # b falls silent, c speaks up once though offline
            late = rng.choice([0, 0, 25])
            rows.append((minute + late, (f"{d}{minute}", d, T0 + timedelta(minutes=minute, seconds=30), rng.choice([None, 1.0]), rng.choice([None, 0.1, 0.5, 0.9]), rng.random() < 0.25)))
    rows.append((13 * 60, ("end", "d", T0 + timedelta(hours=13, minutes=1), 1.0, 0.9, False)))
    rows = [r for _, r in sorted(rows, key=lambda x: x[0])]
    for k in range(0, len(rows), 30):
        spark.createDataFrame(rows[k : k + 30], READING).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{k:05d}")
    stream = spark.readStream.schema(READING).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = stream_device_anomalies(stream, devices, f"{T0 + timedelta(hours=1)}", window_hours=3, delay="1 hour")
        out.writeStream.outputMode("append").format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(provider)
    got = {}
    for r in spark.read.parquet(f"{tmp_path}/out").collect():
        assert got.setdefault((r.as_of, r.id), (r.n_obs, r.n_missing, r.avg_confidence and round(r.avg_confidence, 9), tuple(r.anomalies))) and True
    seen = spark.createDataFrame(rows, READING)
    hours = [T0 + timedelta(hours=h) for h in range(1, 13)]
    want = {}
    for at in hours:
        for r in topology.device_anomalies(devices, seen, f"{at}", 3).withColumn("avg_confidence", F.round("avg_confidence", 9)).collect():
            want[at, r.id] = (r.n_obs, r.n_missing, r.avg_confidence, tuple(r.anomalies))
    assert got == want
    assert ("online_without_observations",) == got[hours[0], "never"][3] == got[hours[-1], "b"][3]
