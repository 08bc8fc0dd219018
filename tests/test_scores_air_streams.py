"""Calibration coverage, score tables, air checks, the index, streams against their batch twins, sinks."""

from datetime import datetime as dt, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import hour_no
from tarnwatch.operators import air_qc, alerts, calibration, grid, incidents, naqi, scoring
from tarnwatch.sources import sinks
from tarnwatch.streaming import intake, smoothing, windows

T0 = dt(2024, 1, 1)


def test_offsets_restore_coverage(spark):
    rng = np.random.default_rng(1)
    actual = rng.normal(0, 1, 4000)
    rows = [("g" if i % 2 else "h", -0.5, 0.0, 0.5, float(a)) for i, a in enumerate(actual)] + [("tiny", -1.0, 0.0, 1.0, 0.0)] * 5 + [("g", None, None, None, 1.0)]
    fc = spark.createDataFrame(rows, "k string, lo double, mid double, hi double, actual double")
    offsets = calibration.fit_offsets(fc, ["k"])
    assert {r["k"] for r in offsets.collect()} == {"g", "h"}
    wide = calibration.apply_offsets(fc.filter("k <> 'tiny' and lo is not null"), offsets, ["k"])
    cover = wide.select(F.avg(F.col("actual").between(F.col("lo"), F.col("hi")).cast("double"))).first()[0]
    assert cover == pytest.approx(0.8, abs=0.03)


def test_offset_is_the_higher_order_statistic(spark):
    scores = np.arange(1.0, 41.0)
    fc = spark.createDataFrame([(0.0, 0.0, 0.0, float(s)) for s in scores], "lo double, mid double, hi double, actual double").withColumn("k", F.lit("a"))
    level = min(1.0, np.ceil(41 * 0.8) / 40)
    assert calibration.fit_offsets(fc, ["k"]).first()["offset"] == float(np.quantile(scores, level, method="higher"))


def test_alert_scores_by_lead(spark):
    rows = [(1, 3.0, 2.5, 4.5, 3.0, 5.0, 5.0, 0.9), (2, 5.0, 4.0, 6.0, 3.5, 5.0, None, 0.2), (3, 3.5, 3.0, 5.0, 4.5, 5.0, 5.0, 0.8), (5, 6.0, 5.0, 7.0, 6.0, 5.0, 5.0, 0.1)]
    df = spark.createDataFrame(rows, "days_ahead int, mid double, lo double, hi double, actual double, last_night double, week_mean double, p_below_alert double")
    got = {r["lead_group"]: r for r in scoring.nightly_alert_scores(df).collect()}
    a = got["all"]
    assert (a["events"], a["hits"], a["misses"], a["false_alarms"]) == (2, 1, 1, 1)
    assert a["probability_of_detection"] == 0.5 and a["false_alarm_ratio"] == 0.5 and a["critical_success_index"] == 0.333
    assert a["brier_score"] == pytest.approx((0.01 + 0.64 + 0.64 + 0.01) / 4, abs=1e-4)
    assert got["5-7 days"]["probability_of_detection"] is None
    report = {r["days_ahead"]: r for r in scoring.nightly_report(df).collect()}
    assert report[2]["mae_week_mean"] == 1.5  # falls back to last night


def test_hourly_report_uses_the_better_simple_rule(spark):
    rows = [("ph", 1, 7.0, 6.5, 7.5, 7.1, 7.4, 7.2), ("ph", 2, 7.0, 6.9, 7.05, 7.2, 7.0, None)]
    df = spark.createDataFrame(rows, "sensor string, horizon int, mid double, lo double, hi double, actual double, persistence double, same_hour_last_day double")
    r = scoring.hourly_report(df).first()
    assert r["mae"] == pytest.approx(0.15) and r["mae_persistence"] == pytest.approx(0.25) and r["mae_same_hour_yesterday"] == pytest.approx(0.15)
    assert r["skill"] == 0.0 and r["coverage_80"] == 0.5


def test_accuracy_of_an_unbiased_and_a_doubled_estimate(spark):
    rows = [("exact", 2.0, 2.0), ("exact", 4.0, 4.0), ("double", 2.0, 4.0), ("double", 4.0, 8.0)]
    got = {r["k"]: r for r in scoring.accuracy(spark.createDataFrame(rows, "k string, actual double, estimate double"), ["k"]).collect()}
    assert got["exact"]["r2_log"] == 1.0 and got["exact"]["median_ratio"] == 1.0
    assert got["double"]["median_ratio"] == 2.0 and got["double"]["median_abs_pct_error"] == 100.0 and got["double"]["mae"] == 3.0


def air_rows(no2=0.02, hours=48):
    rows = []
    for i in range(hours * 4):
        h = i // 4
        wave = float(30 + 10 * np.sin(h / 4) + (i % 4))
        pm25 = 900.0 if h == 30 else wave
        o3 = 0.03 if 10 <= h < 20 else 0.02 + 0.001 * (h % 7)
        rows.append(("s", T0 + timedelta(minutes=15 * i), wave / 2, pm25, pm25 * 1.5, pm25 * 2, 0.1 if h == 5 else no2 + 0.0005 * (h % 5), o3))
    return rows


AIR = "station_id string, timestamp timestamp_ntz, pm1 double, pm25 double, pm10 double, tsp double, no2 double, o3 double"


def test_air_checks(spark):
    out = air_qc.check_air(air_qc.air_hourly(spark.createDataFrame(air_rows(), AIR))).orderBy("hour").collect()
    assert out[5]["no2_flag"] == "at_sensor_limit" and out[5]["no2"] == pytest.approx(0.1 * 46.01 * 1000 / 24.45)
    assert out[30]["pm25_flag"] == "spike" and out[30]["pm25"] is None and out[31]["pm25_flag"] == ""
    assert out[14]["o3_flag"] == "" and out[15]["o3_flag"] == "stuck" and out[19]["o3"] is None and out[21]["o3_flag"] == ""
    flags = {r["pollutant"]: r["flags"] for r in air_qc.recent_flags(air_qc.check_air(air_qc.air_hourly(spark.createDataFrame(air_rows(), AIR)))).collect()}
    assert "spike" in flags["pm25"] and "no2" not in flags


def test_humidity_masks_fog_and_divides_growth(spark):
    hourly = air_qc.air_hourly(spark.createDataFrame(air_rows(), AIR))
    weather = spark.createDataFrame([(T0 + timedelta(hours=h), 97.0 if h == 3 else 50.0) for h in range(48)], "timestamp timestamp_ntz, relative_humidity double")
    out = air_qc.check_air(hourly, weather).orderBy("hour").collect()
    plain = air_qc.check_air(hourly).orderBy("hour").collect()
    assert out[3]["pm25"] is None and out[3]["pm25_flag"] == "too_humid"
    assert out[10]["pm25"] == pytest.approx(plain[10]["pm25"] / (1 + 0.4 / 1.65))


def test_index_needs_three_pollutants_one_particulate(spark):
    rows = [("a", 1, 100.0, 30.0, 40.0), ("a", 2, 100.0, None, 40.0), ("a", 3, 250.0, 90.0, 40.0)]
    df = spark.createDataFrame(rows, "station_id string, hour bigint, pm10 double, pm25 double, no2 double")
    out = naqi.naqi(df).orderBy("hour").collect()
    assert (out[0]["aqi"], out[0]["category"], out[0]["prominent_pollutant"]) == (100.0, "Satisfactory", "pm10")
    assert out[1]["aqi"] is None and out[1]["category"] == "insufficient data" and out[1]["prominent_pollutant"] == ""
    assert (out[2]["aqi"], out[2]["prominent_pollutant"]) == (200.0, "pm10")  # a tie goes to the first


def test_averaging_on_a_gap_free_clock(spark):
    rows = [("a", 1000 + h, 60.0, 1.0) for h in range(40) if not 18 <= h < 26]
    out = {r["hour"] - 1000: r for r in naqi.averaged(spark.createDataFrame(rows, "station_id string, hour bigint, pm25 double, co double")).collect()}
    assert len(out) == 40 and out[14]["pm25"] is None and out[15]["pm25"] == 60.0 and out[27]["pm25"] == 60.0
    assert out[4]["co"] is None and out[5]["co"] == 1.0 and out[39]["co"] == 1.0


def test_alert_selection_and_order(spark):
    df = spark.createDataFrame([("low", "a", "x"), ("high", "b", "y"), ("medium", "a", "z")], "severity string, station string, message string")
    got = [r["severity"] for r in alerts.most_severe_first(alerts.selected(df, "medium")).collect()]
    assert got == ["high", "medium"] and alerts.most_severe_first(df, 1).count() == 1


# ---------------------------------------------------------------------------- streams


def lake_rows(n=600):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(n):
        s = "a" if i % 3 else "b"
        rows.append((s, T0 + timedelta(minutes=4 * i), *[float(v) for v in rng.normal([20, 7, 3, 8], 0.1)], i))
    return rows


SCHEMA = "station_id string, timestamp timestamp_ntz, temperature double, ph double, turbidity double, dissolved_oxygen double, src_ord int"


def run(stream, spark, name, tmp_path, mode="append"):
    q = (stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
         .option("checkpointLocation", str(tmp_path / f"cp_{name}")).start())
    q.awaitTermination(120)
    return spark.table(name)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Readings as several files in arrival order."""
    path = tmp_path_factory.mktemp("stream")
    rows = lake_rows()
    for part in range(3):
        chunk = rows[part * 200 : (part + 1) * 200]
        spark.createDataFrame(chunk, SCHEMA).coalesce(1).write.mode("append").parquet(str(path / "in"))
    return path


def test_hourly_stream_equals_batch(spark, folder, tmp_path):
    schema = spark.read.parquet(str(folder / "in")).schema
    stream = windows.event_time(spark.readStream.schema(schema).parquet(str(folder / "in")))
    out = run(windows.hourly_means(stream, delay="48 hours"), spark, "hourly", tmp_path)
    got = {(r["station_id"], r["window"]["start"]): r["ph"] for r in out.collect()}
    df = spark.read.parquet(str(folder / "in")).withColumn("hour", hour_no(F.col("timestamp")))
    batch = df.groupBy("station_id", "hour").agg(F.when(F.count("ph") >= 3, F.avg("ph")).alias("ph")).collect()
    want = {(r["station_id"], dt(1970, 1, 1) + timedelta(hours=r["hour"])): r["ph"] for r in batch}
    # Windows still open when the input ends are not emitted; all emitted ones agree.
    assert all(got[k] == pytest.approx(want[k]) for k in got)


def test_closed_hours_are_emitted(spark, folder, tmp_path):
    schema = spark.read.parquet(str(folder / "in")).schema
    stream = windows.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
    out = run(windows.hourly_means(stream, delay="20 hours"), spark, "hourly_closed", tmp_path)
    assert out.count() > 10


def test_sliding_means_chain(spark, folder, tmp_path):
    schema = spark.read.parquet(str(folder / "in")).schema
    stream = windows.event_time(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in")))
    sliding = windows.sliding_means(windows.hourly_means(stream, ["ph"], delay="14 hours"), ["ph"], 8, 6)
    out = run(sliding, spark, "sliding", tmp_path).collect()
    assert all(r["ph"] is None or 6.5 < r["ph"] < 7.5 for r in out)


def test_dedupe_within_watermark(spark, folder, tmp_path):
    schema = spark.read.parquet(str(folder / "in")).schema
    stream = windows.event_time(spark.readStream.schema(schema).parquet(str(folder / "in")))
    twice = stream.union(windows.event_time(spark.readStream.schema(schema).parquet(str(folder / "in"))))
    out = run(windows.deduplicated(twice, ["station_id", "timestamp"], "100 hours"), spark, "dedup", tmp_path)
    assert out.count() == 600


def test_alarm_sessions_equal_batch_incidents(spark, tmp_path):
    slot0 = int((T0 - dt(1970, 1, 1)).total_seconds()) // 600
    marks = {2: "sensor_fault", 9: "needs_review", 17: "possible_event", 300: "sensor_fault"}
    rows = [("a", slot0 + i, T0 + timedelta(minutes=10 * i), marks.get(i, "normal"), "spike" if marks.get(i) == "sensor_fault" else "") for i in range(400)]
    df = spark.createDataFrame(rows, "station_id string, slot bigint, timestamp timestamp_ntz, verdict string, ph_fault string")
    df.coalesce(1).write.parquet(str(tmp_path / "flags"))
    stream = windows.event_time(spark.readStream.schema(df.schema).parquet(str(tmp_path / "flags")))
    # One late row closes the sessions before it.
    late = [("z", slot0, T0 + timedelta(days=30), "sensor_fault", "")]
    spark.createDataFrame(late, df.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "flags"))
    stream = windows.event_time(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "flags")))
    out = run(windows.alarm_sessions(stream, ["ph"], "1 minute"), spark, "sessions", tmp_path).filter("station_id = 'a'")
    got = sorted((r["start"], r["end"], r["verdicts"], r["sensors"]) for r in out.collect())
    want = sorted((r["start"], r["end"], r["verdicts"], r["sensors"]) for r in incidents.alarm_incidents(df, ["ph"]).collect())
    assert [g[2:] for g in got] == [w[2:] for w in want] and [g[:2] for g in got] == [w[:2] for w in want]


def test_state_equals_the_sequential_mean(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, 90)
    for part in range(3):
        rows = [("a", i, None if i % 10 == 3 else float(x[i]), i == 40) for i in range(part * 30, part * 30 + 30)]
        spark.createDataFrame(rows, "station_id string, slot bigint, x double, reset boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "x"))
    schema = spark.read.parquet(str(tmp_path / "x")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", False).parquet(str(tmp_path / "x"))
    got = {r["slot"]: r["level"] for r in run(smoothing.smoothed(stream, 0.3, 0.5), spark, "ewma", tmp_path).collect()}
    level = 0.0
    for i in range(90):
        if i == 40:
            level = 0.0
        elif i % 10 != 3:
            level = min(max(level + 0.3 * (x[i] - level), -0.5), 0.5)
        assert got[i] == pytest.approx(level)


def test_intake_appends_once_and_the_newest_copy_wins(spark, tmp_path):
    inbox, log = tmp_path / "inbox", str(tmp_path / "log")
    inbox.mkdir()
    cols = ["Device", "Time", "x"]
    (inbox / "a.csv").write_text("Device,Time,x\nd,2024-01-01 00:00,1\nd,2024-01-01 00:10,2\n")

    def take():
        intake.take_in(intake.inbox_stream(spark, str(inbox), cols), "Time", log, str(tmp_path / "cp")).awaitTermination(60)

    take()
    (inbox / "b.csv").write_text("Device,Time,x\nd,2024-01-01 00:10,3\nd,2024-01-02 00:00,4\n")
    take()
    take()
    got = {r["Time"]: r["x"] for r in intake.history(spark, log, "Device", "Time").collect()}
    assert got == {"2024-01-01 00:00": "1", "2024-01-01 00:10": "3", "2024-01-02 00:00": "4"}
    assert spark.read.parquet(log).count() == 4
    intake.compact(spark, log, "Device", "Time", str(tmp_path / "compacted"))
    assert spark.read.parquet(str(tmp_path / "compacted")).count() == 3


# ---------------------------------------------------------------------------- sinks


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "first"), ("a", 2, "second"), ("b", 1, "third")], "station_id string, line_no int, line string")
    written = sinks.write_tables({"kept": df, "empty": df.filter("false"), "none": None}, str(tmp_path / "run"))
    assert written == ["kept"] and spark.read.parquet(str(tmp_path / "run" / "kept")).count() == 3
    sinks.write_lines(df, str(tmp_path / "text"))
    assert [r["value"] for r in spark.read.text(str(tmp_path / "text")).collect()] and spark.read.text(str(tmp_path / "text")).count() == 3
    sinks.write_json(df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).filter("line = 'third'").count() == 1
    for run_name in ("r1", "r2"):
        sinks.append_scores(df, str(tmp_path / "scores"), run_name)
    assert spark.read.parquet(str(tmp_path / "scores")).groupBy("run").count().count() == 2


def test_hour_and_slot_helpers(spark):
    df = spark.createDataFrame([("a", 3, 1.0)], "station_id string, slot bigint, temperature double")
    assert grid.with_timestamp(df).first()["timestamp"] == dt(1970, 1, 1, 0, 30)
    assert K.SLOTS_PER_DAY == 144
