"""A stream whose rows come out of order against the sequential recursion."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.streaming import ordered

SCHEMA = "station_id string, slot bigint, x double, reset boolean"


def test_rows_out_of_order_give_the_sequential_levels(spark, tmp_path):
    rng, n, base = np.random.default_rng(1), 900, 144 * 19_000
    x = rng.normal(0, 1, n)
    x[::10] = np.nan
    arrival = np.arange(n)
    for i in range(0, n, 30):  # five hours out of order at most, within the watermark's six
        rng.shuffle(arrival[i : i + 30])
    path = str(tmp_path / "x")
    for part in np.array_split(arrival, 3):
        rows = [("a", base + int(i), None if np.isnan(x[i]) else float(x[i]), True if i == 400 else None if i % 7 else False) for i in part]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)
    stream = stream.withColumn("ts", F.timestamp_seconds(F.col("slot") * 600)).withWatermark("ts", "6 hours")
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ordered.PROVIDER)
    try:
        out = ordered.smoothed_in_order(stream, 0.3, 0.5).writeStream.format("parquet").option("path", str(tmp_path / "out"))
        out.option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.set(name, before)
    rows = spark.read.parquet(str(tmp_path / "out")).collect()
    got = {r["slot"] - base: r["level"] for r in rows}
    # The watermark ends six hours before the last row: five whole days are closed, each slot once.
    assert len(rows) == 720 and set(got) == set(range(720))
    level = 0.0
    for i in range(720):
        if i == 400:
            level = 0.0
        elif not np.isnan(x[i]):
            level = min(max(level + 0.3 * (x[i] - level), -0.5), 0.5)
        assert got[i] == pytest.approx(level)
