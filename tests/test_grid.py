"""Hand-made tables: dedupe, gaps, hourly means, interpolation, upserts, contracts."""

from datetime import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.operators import grid
from tarnwatch.operators.lab import clean_lab
from tarnwatch.operators.reports import prepare_report
from tarnwatch.sources import readers, vendor
from tarnwatch.sources.contracts import MissingColumns, require_columns

SCHEMA = "station_id string, timestamp string, temperature string, ph string, turbidity string, dissolved_oxygen string"


def readings(spark, rows):
    # The position in the list is the arrival order, as an exporting logger would number its rows.
    rows = [(*r, i) for i, r in enumerate(rows)]
    return readers.read_readings(spark.createDataFrame(rows, SCHEMA + ", pos int"), F.col("pos"))


def test_jitter_gap_duplicate_and_bad_time(spark):
    df = readings(spark, [
        ("a", "2024-01-01 00:00:04", "20", "7", "3", "8"),
        ("a", "2024-01-01 00:09:58", "21", "err", "3", "8"),
        ("a", "2024-01-01 00:10:03", "99", "7", "3", "8"),
        ("a", "2024-01-01 00:40:00", "22", "7", "<1", "8"),
        ("a", "never", "22", "7", "3", "8"),
    ])
    out = grid.with_timestamp(grid.slot_grid(df)).orderBy("timestamp").collect()
    assert [r["timestamp"] for r in out] == [dt(2024, 1, 1, 0, m) for m in (0, 10, 20, 30, 40)]
    assert [r["temperature"] for r in out] == [20.0, 21.0, None, None, 22.0]
    assert out[1]["ph"] is None and out[4]["turbidity"] == 0.5
    report = prepare_report(df).first().asDict()
    assert (report["rows_in"], report["bad_timestamp_dropped"], report["duplicates_dropped"], report["gap_rows_added"], report["rows_out"]) == (5, 1, 1, 2, 5)


def test_sparse_hours_stay_empty_per_sensor(spark):
    rows = []
    for i in range(12):
        temp = "20" if i < 6 or i == 6 else None
        rows.append(("a", f"2024-01-01 {i // 6:02d}:{i % 6 * 10:02d}:00", temp, "7", "3", "8"))
    out = grid.hourly_grid(readings(spark, rows)).orderBy("hour").collect()
    assert [r["temperature"] for r in out] == [20.0, None] and [r["ph"] for r in out] == [7.0, 7.0]


def weather(spark, hours):
    rows = [(dt(2024, 1, 1, h), float(h), 0.5, 0.0) for h in hours]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, air_temperature double, cloud_cover double, rain_mm double")


def test_interpolation_fills_three_hours_of_any_interior_gap(spark):
    w = grid.weather_grid(weather(spark, [0, 1, 4, 5, 10, 11]), K.WEATHER_LAKE).orderBy("hour").collect()
    got = [r["air_temperature"] for r in w]
    assert got[2:4] == pytest.approx([2.0, 3.0])  # a two-hour gap closes
    assert got[6:9] == pytest.approx([6.0, 7.0, 8.0]) and got[9] is None  # a four-hour gap fills its first three


def test_latest_copy_wins_by_arrival(spark):
    rows = [("a", "t1", 1.0, "f1", 1), ("a", "t1", 2.0, "f2", 0), ("a", "t2", 3.0, "f1", 2), ("a", "t2", 4.0, "f1", 3)]
    df = spark.createDataFrame(rows, "station string, stamp string, x double, f string, n int")
    out = {r["stamp"]: r["x"] for r in grid.latest_wins(df, ["station", "stamp"], ["f", "n"]).collect()}
    assert out == {"t1": 2.0, "t2": 4.0}


def test_faulty_values_are_masked(spark):
    df = spark.createDataFrame([(1.0, "drift"), (2.0, ""), (3.0, None)], "turbidity double, turbidity_fault string")
    assert [r["turbidity"] for r in grid.mask_faulty(df).collect()] == [None, 2.0, 3.0]
    assert grid.faulty_count(df).first()["turbidity_masked"] == 1


def test_missing_columns_are_named(spark):
    df = spark.createDataFrame([(1,)], "a int")
    with pytest.raises(MissingColumns, match="station_id"):
        require_columns(df, ["a", "station_id"], "lab data")
    with pytest.raises(ValueError, match="unit"):
        vendor.VendorMapping(oxygen_unit="ppm")


def test_vendor_export(spark):
    mapping = vendor.VendorMapping(
        columns={"station_id": "Device", "timestamp": "Time (UTC)", "temperature": "T", "ph": "pH", "turbidity": "Turb", "dissolved_oxygen": "DO"},
        stations={"b1": "north"}, oxygen_unit="percent", turbidity_unit="percent", turbidity_calibration=(2.0, -1.0),
        limits={"ph": (4.0, 9.0), "dissolved_oxygen": (None, 100.0)}, timezone="Asia/Kolkata",
    )
    rows = [
        (" b1 ", "2024-01-01T00:00:00Z", "20", "9.0", "5", "100"), ("b1", "2024-01-01T00:10:00Z", "20", "7", "0.2", "50"),
        ("b2", "bad", "20", "4", "5", "0"), ("b2", "2024-01-01T00:20:00Z", "20", "4", "5", "0"),
    ]
    raw = spark.createDataFrame(rows, "Device string, `Time (UTC)` string, T string, pH string, Turb string, DO string")
    out = vendor.normalise(raw, mapping).orderBy("timestamp").collect()
    assert [r["station_id"] for r in out] == ["north", "north", "b2"]
    assert out[0]["timestamp"] == dt(2024, 1, 1, 5, 30)
    assert out[0]["ph"] is None and out[0]["dissolved_oxygen"] is None and out[0]["turbidity"] == 9.0
    assert out[1]["dissolved_oxygen"] == pytest.approx(0.5 * 9.09 * 0.93, abs=0.01) and out[1]["turbidity"] == 0.0
    assert out[2]["ph"] is None and out[2]["dissolved_oxygen"] == 0.0
    counts = {(r["station_id"], r["sensor"]): r["readings"] for r in vendor.censor_counts(vendor.censored(vendor.renamed(raw, mapping), mapping)).collect()}
    assert counts == {("north", "ph"): 1, ("north", "dissolved_oxygen"): 1, ("b2", "ph"): 2}


def test_csv_folder_reads_in_arrival_order(spark, tmp_path):
    (tmp_path / "b.csv").write_text("station_id,timestamp,x\na,t1,new\n")
    (tmp_path / "a.csv").write_text("station_id,timestamp,x\na,t1,old\na,t2,only\n")
    df = readers.read_inbox(spark, str(tmp_path), ["station_id", "timestamp", "x"])
    out = {r["timestamp"]: r["x"] for r in grid.latest_wins(df, ["station_id", "timestamp"], readers.ARRIVAL).collect()}
    assert out == {"t1": "new", "t2": "only"}
    plain = readers.read_csv(spark, str(tmp_path / "a.csv"))
    assert plain.columns == ["station_id", "timestamp", "x"] and plain.count() == 2


def test_weather_payload(spark):
    text = '{"hourly": {"time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [10.5, null], "cloud_cover": [40, 100], "precipitation": [0, 1.5]}}'
    out = readers.weather_from_payload(spark.createDataFrame([(text,)], "payload string")).orderBy("timestamp").collect()
    assert out[0]["cloud_cover"] == pytest.approx(0.4) and out[1]["air_temperature"] is None and out[1]["rain_mm"] == 1.5
    assert out[0]["wind_speed"] is None


def test_grids_read_the_readings_once(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:04", "20", "7", "3", "8"), ("a", "2024-01-01 02:40:00", "22", "7", "3", "8"), ("b", "2024-01-01 00:30:00", "21", "7", "3", "8")]
    readings(spark, rows).write.parquet(str(tmp_path / "readings"))
    table = spark.read.parquet(str(tmp_path / "readings"))
    for made, n in ((grid.slot_grid(table), 18), (grid.hourly_grid(table, min_valid=1), 4)):
        assert made.count() == n
        assert made.inputFiles() and all("/slots-" in f for f in made.inputFiles())


def test_lab_text_is_parsed_before_it_is_filtered(spark, tmp_path):
    rows = [("a", "2024-01-01 00:00:00", "<1", 2), ("a", "2024-01-01 00:00:00", "3", 1), ("a", "2024-01-02 00:00:00", "n/a", 3), ("b", "never", "2", 4)]
    spark.createDataFrame(rows, "station_id string, timestamp string, bod string, src_ord int").write.parquet(str(tmp_path / "lab"))
    kept = clean_lab(readers.read_lab(spark.read.parquet(str(tmp_path / "lab")), "bod"), "bod")
    assert [(r["station_id"], r["bod"], r["src_ord"]) for r in kept.collect()] == [("a", 3.0, 1)]
    assert kept.inputFiles() and all("/lab-" in f for f in kept.inputFiles())
