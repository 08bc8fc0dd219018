"""Selection trees, scans, calendars, noise, folds, station effects and leaf spreads on small built tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import noise
from tarnwatch.models import regression, soft_sensor
from tarnwatch.operators import calibration, grid, order_stats, recursions, splits
from tarnwatch.sources import readers, sinks


def test_pooled_nodes_equal_a_pooled_group(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(s, "ph", float(x)) for s, n in (("a", 700), ("b", 90), ("c", 1)) for x in rng.normal(len(s), 3, n)]
    rows += [(None, "ph", 1e9), ("a", "ph", None), ("b", "ph", float("nan"))] + [("b", "do", 2.5)] * 40 + [("a", "do", -0.0), ("a", "do", 0.0)]
    df = spark.createDataFrame(rows, "station_id string, sensor string, v double")
    known = [(s, k, x) for s, k, x in rows if s is not None and x is not None and x == x]
    for ranked in (20_000, 7):
        monkeypatch.setattr(order_stats, "RANKED", ranked)
        out = {(r["station_id"], r["sensor"]): r for r in order_stats.median_and_mad(df, ["station_id", "sensor"], "v", pooled="station_id").collect()}
        want = {}
        for s, k, x in known:
            want.setdefault((s, k), []).append(x)
            want.setdefault((order_stats.POOLED, k), []).append(x)
        assert set(out) == set(want)
        for key, xs in want.items():
            mid = np.median(xs)
            assert out[key]["n"] == len(xs) and out[key]["median"] == pytest.approx(mid) and out[key]["mad"] == pytest.approx(np.median(np.abs(np.array(xs) - mid)))


def test_extreme_values_do_not_overflow(spark):
    xs = [float("-inf"), -1.7e308, -5e-324, 0.0, 5e-324, 1e-300, 1.7e308, float("inf")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = order_stats.order_stats(df, [], "x", {f"r{i}": lambda n, i=i: F.lit(i) for i in range(len(xs))}).first()
    assert [got[f"r{i}"] for i in range(len(xs))] == xs


def test_scan_by_doubling_equals_the_loop():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 64, 1001):
        a = np.where(rng.random((n, 3)) < 0.1, 0.0, rng.random((n, 3)))
        b, cap = rng.normal(0, 1, (n, 3)), np.where(rng.random((n, 3)) < 0.5, np.inf, 0.7)
        level, want = np.full(3, 0.3), np.empty((n, 3))
        for i in range(n):
            level = np.clip(a[i] * level + b[i], -cap[i], cap[i])
            want[i] = level
        maps = (a, b, -cap, cap)
        np.testing.assert_allclose(recursions.applied(recursions.prefixes(maps), np.full(3, 0.3)), want, atol=1e-12)
        np.testing.assert_allclose(recursions.applied(recursions.composed(maps), np.full(3, 0.3))[0], want[-1], atol=1e-12)


def test_a_calendar_row_holds_one_stretch(spark, monkeypatch):
    monkeypatch.setattr(grid, "SPAN", 10)
    df = spark.createDataFrame([("a", -13), ("a", 27), ("b", 5)], "station_id string, slot bigint")
    got = sorted((r["station_id"], r["slot"]) for r in grid.calendar(df, "slot", beyond=2).collect())
    assert got == [("a", k) for k in range(-13, 30)] + [("b", k) for k in (5, 6, 7)]


def test_stray_days_are_named_and_left_out(spark):
    rows = [("a", f"2024-01-{d:02d} 10:00:00") for d in range(1, 11)] + [("a", "1970-01-01 00:00:07"), ("a", "2031-05-01 00:00:00"), ("b", "2015-02-02 01:00:00"), (None, "2000-01-01 00:00:00"), ("a", None)]
    df = spark.createDataFrame(rows, "station_id string, t string").select("station_id", F.col("t").cast("timestamp_ntz").alias("timestamp"))
    strays = grid.stray_days(df)
    assert sorted((r["station_id"], r["day"], r["readings"]) for r in strays.collect()) == [("a", 0, 1), ("a", 22400, 1)]
    assert grid.without_strays(df, strays).count() == len(rows) - 2


def test_noise_depends_on_keys_alone(spark):
    df = spark.range(20_000).select(F.col("id").alias("hour"), F.lit("s").alias("station_id"))
    one = df.select("hour", noise.normal(4, "rain", ["station_id", "hour"]).alias("z"), noise.uniform(4, "rain", ["hour"]).alias("u"))
    again = {r["hour"]: r["z"] for r in one.repartition(7).collect()}
    rows = one.collect()
    assert all(again[r["hour"]] == r["z"] for r in rows)
    z, u = np.array([r["z"] for r in rows]), np.array([r["u"] for r in rows])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03 and abs(np.mean(z < -1.2816) - 0.1) < 0.01 and abs(u.mean() - 0.5) < 0.01
    other = [r["z"] for r in df.select(noise.normal(5, "rain", ["station_id", "hour"]).alias("z")).collect()]
    assert abs(np.corrcoef(z, other)[0, 1]) < 0.05


def test_folds_are_whole_stretches(spark):
    df = spark.range(100).select(F.col("id").alias("slot"))
    out, n = splits.blocked_folds(df, "slot", 30, 5)
    assert n == 4 and {(r["slot"] // 30, r["fold"]) for r in out.collect()} == {(k, k) for k in range(4)}
    with pytest.raises(ValueError):
        splits.blocked_folds(df, "slot", 200)


def test_inbox_rows_count_in_file_order(spark, tmp_path):
    for name, temperature in (("b.csv", 2.0), ("a.csv", 1.0), ("c.csv", 3.0)):
        (tmp_path / name).write_text(f"station_id,timestamp,temperature,ph,turbidity,dissolved_oxygen\ns,2024-01-01 00:00,{temperature},7,1,8\n")
    rows = readers.read_readings(readers.read_inbox(spark, str(tmp_path), ["station_id", "timestamp", "temperature", "ph", "turbidity", "dissolved_oxygen"]))
    assert grid.first_per_slot(rows).first()["temperature"] == 1.0


def test_csv_results_keep_microseconds(spark, tmp_path):
    df = spark.sql("SELECT timestamp_ntz'2024-01-01 00:00:00.123456' AS t, timestamp'2024-01-01 00:00:00.654321Z' AS u")
    sinks.write_tables({"x": df}, str(tmp_path), "csv")
    assert spark.read.schema(df.schema).option("header", True).csv(str(tmp_path / "x")).collect() == df.collect()


def test_one_threshold_is_many_stretches(spark):
    asked = spark.range(60_000).select(F.col("id").cast("int").alias("i"), F.when(F.col("id") < 50_000, 0.5).otherwise(F.col("id") / 1e4).alias("t"))
    given = spark.range(1000).select((F.col("id") / 1000).alias("residual"))
    seen = []
    keep = calibration.materialise

    def watched(df, name="table"):
        out = keep(df, name)
        if name == "stretches":
            seen.extend(r["count"] for r in out.groupBy("_part").count().collect())
        return out

    calibration.materialise = watched
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = calibration.share_above(asked, "t", given).groupBy("p").count().collect()
    finally:
        calibration.materialise = keep
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {round(r["p"], 9): r["count"] for r in out} == {0.499: 50_000, 0.0: 10_000}
    assert max(seen) < 0.6 * 61_000 and len(seen) > 1


def test_two_hundred_stations_are_told_apart(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{k}", float(x), float(2 * x + k + rng.normal(0, 0.1))) for k in range(200) for x in rng.normal(0, 1, 60)]
    df = spark.createDataFrame(rows, "station_id string, x double, y double")
    model = regression.TrendPlusTrees(["x"], "y", trees=3, depth=3).fit(df)
    new = spark.createDataFrame([("s3", 0.0), ("s4", 0.0), ("s150", 0.0), ("unseen", 0.0), (None, 0.0)], "station_id string, x double")
    got = {r["station_id"]: r["p"] for r in regression.predict(model, new, "p", ["x"]).collect()}
    # Shrunken towards the mean of all stations, 99.5, by 20 rows in 80; the trees give some of it back.
    assert got["s3"] < got["s4"] < got["s150"] and got["s3"] < 35 and got["s150"] > 125
    assert abs(got["unseen"] - 99.5) < 15 and got["unseen"] == got[None]


def test_ranges_follow_the_conditions(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(8000):
        x, wind = rng.normal(), rng.random()
        rows.append(("a", float(x), float(wind), 1, float(x + rng.normal(0, 0.2 if wind < 0.5 else 2.0))))
    df = spark.createDataFrame(rows, "station_id string, x double, wind double, bucket int, y double")
    train, test = df.limit(6000), df.offset(6000)
    model = regression.QuantileTrees(["x", "wind"], {"y": "y"}, ["bucket"], trees=10, depth=3).fit(train)
    out = model.predict(test.withColumn("actual", F.col("y")), ["station_id", "wind", "actual"])
    halves = out.groupBy((F.col("wind") < 0.5).alias("calm")).agg(F.avg(F.col("actual").between(F.col("lo"), F.col("hi")).cast("int")).alias("c"), F.avg(F.col("hi") - F.col("lo")).alias("w")).collect()
    assert all(0.75 <= r["c"] <= 0.85 for r in halves)
    width = {r["calm"]: r["w"] for r in halves}
    assert width[False] > 3 * width[True]


def test_rows_without_a_station_are_left_out_in_turn_too(spark):
    rng = np.random.default_rng(5)
    rows = [(s, float(x), float(np.exp(x))) for s in ("a", "b", None) for x in rng.normal(0, 1, 30)]
    df = spark.createDataFrame(rows, "station_id string, x double, bod double")
    out = soft_sensor.unseen_station_scores(df, "bod", ["x"], "ridge").collect()
    assert {r["station_id"]: r["samples"] for r in out} == {"a": 30, "b": 30, None: 30}
