"""Rule tests, verdicts, incidents, episode scores, metabolism, features that never look ahead."""

from datetime import datetime as dt, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import SLOT_US
from tarnwatch.operators import events, faults, forecast_features as ff, incidents, lake_qc, metabolism, soft_features, verdicts

S = K.LAKE_SENSORS
T0 = dt(2024, 1, 1)
SLOT0 = int((T0 - dt(1970, 1, 1)).total_seconds()) // 600
HOUR0 = SLOT0 // 6


def test_rule_tests_on_a_built_series(spark):
    rng = np.random.default_rng(0)
    x = (7.0 + rng.normal(0, 0.05, 200)).tolist()
    x[10] = None
    x[20] = -5.0
    x[50] = x[51] = 12.0
    for i in range(100, 140):
        x[i] = 7.1
    for i in range(160, 200):
        x[i] += 1.0
    rows = [("a", SLOT0 + i, v, 0.05) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "station_id string, slot bigint, ph double, scale_ph double")
    out = lake_qc.rule_tests(df, ["ph"]).orderBy("slot").collect()
    qc, reason = [r["ph_qc"] for r in out], [r["ph_reason"] for r in out]
    assert (qc[10], reason[10]) == (9, "missing") and (qc[20], reason[20]) == (4, "out_of_range")
    assert reason[50] == "spike" and qc[50] == 4
    assert reason[110] == "" and reason[111] == "flatline" and qc[111] == 3 and qc[123] == 4 and reason[140] != "flatline"
    assert reason[160] in ("rate_of_change", "spike") and qc[160] >= 3
    assert reason[5] == "" and qc[5] == 1


def test_season_band(spark):
    df = spark.createDataFrame([("a", SLOT0 + i, v, 1.0, 6.0, 8.0) for i, v in enumerate([7.0, 8.5, 7.0, None])],
                               "station_id string, slot bigint, ph double, scale_ph double, ph_low double, ph_high double")
    out = lake_qc.rule_tests(df, ["ph"], bands=True).orderBy("slot").collect()
    assert [r["ph_reason"] for r in out] == ["", "climatology", "", "missing"]


def test_isolate_picks_the_best_explanation(spark):
    own = {s: F.lit(v) for s, v in zip(S, (3.0, 2.0, 0.5, 2.0))}
    other = {s: [F.lit(a), F.lit(b), F.lit(None).cast("double")] for s, (a, b) in zip(S, ((0.4, 0.9), (0.2, 0.3), (0.0, 0.1), (5.0, 0.1)))}
    df = spark.range(1)
    assert df.select(verdicts.isolate(own, other)).first()[0] == "ph"
    calm = {s: F.lit(0.5) for s in S}
    assert df.select(verdicts.isolate(calm, other)).first()[0] == ""


def flagged(spark, verdict_list, start=SLOT0, step=1):
    rows = []
    for i, v in enumerate(verdict_list):
        fault = "spike" if v == "sensor_fault" else ""
        rows.append(("a", start + i * step, 20.0, 7.0, 3.0, 8.0, "", fault, "", "", v == "possible_event", v))
    cols = ", ".join(f"{s} double" for s in S) + ", " + ", ".join(f"{s}_fault string" for s in S)
    return spark.createDataFrame(rows, f"station_id string, slot bigint, {cols}, event boolean, verdict string")


def test_incidents_merge_up_to_seventy_minutes(spark):
    v = ["normal"] * 40
    v[2] = "sensor_fault"
    v[9] = "needs_review"  # exactly 70 minutes later: the same incident
    v[17] = "possible_event"  # 80 minutes later: a new one
    out = incidents.alarm_incidents(flagged(spark, v)).orderBy("start").collect()
    assert [(r["verdicts"], r["sensors"]) for r in out] == [("needs_review,sensor_fault", "ph"), ("possible_event", "")]
    assert out[0]["start"] == T0 + timedelta(minutes=20) and out[0]["end"] == T0 + timedelta(minutes=90)


def test_episode_scores(spark):
    v = ["normal"] * 200
    v[20] = "sensor_fault"
    v[60] = "possible_event"
    v[100] = "missing"
    table = flagged(spark, v)

    def at(i):
        return T0 + timedelta(minutes=10 * i)

    eps = [
        (1, "a", "spike", "ph", at(18), at(24)), (2, "a", "spike", "ph", at(21), at(30)), (3, "a", "event", "", at(58), at(70)),
        (4, "a", "dropout", "", at(95), at(105)), (5, "a", "event", "", at(10), at(25)), (6, "zz", "spike", "ph", at(0), at(9)),
    ]
    episodes = spark.createDataFrame(eps, "ep int, station_id string, kind string, sensor string, start timestamp_ntz, end timestamp_ntz")
    got = {r["ep"]: (r["detected"], r["delay_hours"], r["blamed_on_sensor"]) for r in incidents.episode_scores(table, episodes).collect()}
    assert got == {1: (True, 0.33, False), 2: (False, None, False), 3: (True, 0.33, False), 4: (True, 0.83, False), 5: (False, None, True), 6: (False, None, False)}
    explained = incidents.explained_incidents(incidents.alarm_incidents(table), episodes)
    score = incidents.incident_scores(explained, table).first()
    assert score["incidents"] == 2 and score["false_incidents"] == 0 and score["incident_precision"] == 1.0


def test_onset_rows_join_the_event(spark):
    n = 60
    rows = []
    for i in range(n):
        fault = "drift" if i in (30, 38) else "spike" if i == 39 else ""
        rows.append(("a", SLOT0 + i, 40 <= i < 46, fault, "", "", ""))
    df = spark.createDataFrame(rows, "station_id string, slot bigint, event boolean, " + ", ".join(f"{s}_fault string" for s in S))
    out = events.relabel_onsets(df).orderBy("slot").collect()
    assert out[30]["event"] and out[38]["event"] and out[30][f"{S[0]}_fault"] == ""
    assert not out[39]["event"] and out[39][f"{S[0]}_fault"] == "spike"
    late = [(*r[:2], 50 <= i < 55, *r[3:]) for i, r in enumerate(rows)]
    far = events.relabel_onsets(spark.createDataFrame(late, df.schema)).orderBy("slot").collect()
    assert not far[30]["event"] and far[38]["event"]


def test_injected_shapes(spark):
    rows = [("a", SLOT0 + i, 1.0, 1.0, 1.0, 1.0) for i in range(20)]
    grid = spark.createDataFrame(rows, "station_id string, slot bigint, " + ", ".join(f"{s} double" for s in S))

    def run(kind, sensor, size=1.0):
        e = spark.createDataFrame(
            [(1, "a", kind, sensor, T0 + timedelta(minutes=50), T0 + timedelta(minutes=140), size)],
            "ep int, station_id string, kind string, sensor string, start timestamp_ntz, end timestamp_ntz, size double",
        )
        return faults.apply_episodes(grid, e).orderBy("slot").toPandas()

    offset = run("offset", "ph", -1.0)
    assert (offset["ph"][5:15] == 0.5).all() and (offset["ph"][:5] == 1.0).all() and (offset["kind"][5:15] == "offset").all()
    drift = run("drift", "temperature")
    assert drift["temperature"][5] == 1.0 and drift["temperature"][14] == pytest.approx(2.5)
    wave = run("oscillation", "temperature")
    assert list(wave["temperature"][5:9]) == [2.0, 0.0, 2.0, 0.0]
    event = run("event", "")
    assert event["dissolved_oxygen"].min() == 0.0 and event["turbidity"].max() > 2.0 and (event["temperature"] == 1.0).all()
    assert run("dropout", "")[S][5:15].isna().all().all()


def test_nested_and_same_start_episodes(spark):
    rows = [("a", SLOT0 + i, 1.0, 1.0, 1.0, 1.0) for i in range(20)]
    grid = spark.createDataFrame(rows, "station_id string, slot bigint, " + ", ".join(f"{s} double" for s in S))
    at = lambda k: T0 + timedelta(minutes=10 * k)
    e = spark.createDataFrame(
        [(1, "a", "offset", "ph", at(2), at(14), 1.0), (2, "a", "dropout", "", at(5), at(7), 1.0), (3, "a", "drift", "ph", at(2), at(17), 1.0)],
        "ep int, station_id string, kind string, sensor string, start timestamp_ntz, end timestamp_ntz, size double",
    )
    out = faults.apply_episodes(grid, e).orderBy("slot").toPandas()
    assert list(out["kind"]) == [""] * 2 + ["offset"] * 3 + ["dropout"] * 3 + ["offset"] * 7 + ["drift"] * 3 + [""] * 2


def known_metabolism(k=0.08, r=0.3, p=1.0, days=30):
    """Hourly oxygen integrated from known rates at constant temperature."""
    sat = float(np.exp(-139.34411 + 1.575701e5 / 298.15 - 6.642308e7 / 298.15**2 + 1.2438e10 / 298.15**3 - 8.621949e11 / 298.15**4)) * 0.93
    out, do = [], 7.0
    for h in range(days * 24):
        out.append(do)
        hour = h % 24
        light = p * np.sin(np.pi * (hour + 0.5 - 6) / 13) if 6 <= hour < 19 else 0.0
        for _ in range(60):
            do += (light - r + k * (sat - do)) / 60
    return out


def test_metabolism_recovers_known_rates(spark):
    do = known_metabolism()
    hourly = spark.createDataFrame([("a", HOUR0 + i, 25.0, float(x)) for i, x in enumerate(do)], "station_id string, hour bigint, temperature double, dissolved_oxygen double")
    table = metabolism.daily_metabolism(hourly).toPandas().sort_values("day").iloc[10:]
    assert table["reaeration"].median() == pytest.approx(0.08, rel=0.1)
    assert table["respiration"].median() == pytest.approx(0.3, rel=0.1)
    daily = sum(np.sin(np.pi * (h + 0.5 - 6) / 13) for h in range(6, 19))
    assert table["gpp"].median() == pytest.approx(daily, rel=0.15)


@pytest.fixture(scope="module")
def hourly(spark):
    rng = np.random.default_rng(3)
    rows = []
    for s in ("a", "b"):
        for i in range(24 * 14):
            vals = [22 + 3 * np.sin(i / 24 * 6.28) + rng.normal(0, 0.1), 7.5, 4 + rng.random(), 7 + 2 * np.sin((i - 10) / 24 * 6.28)]
            rows.append((s, HOUR0 + i, *[None if rng.random() < 0.05 else float(v) for v in vals]))
    return spark.createDataFrame(rows, "station_id string, hour bigint, " + ", ".join(f"{s} double" for s in S)).cache()


def test_forecast_features_never_look_ahead(spark, hourly):
    cut = HOUR0 + 24 * 9
    later = F.col("hour") > cut
    changed = hourly.withColumns({s: F.when(later, F.lit(99.0)).otherwise(F.col(s)) for s in S})

    def rows(df):
        h = ff.working_hours(df)
        out = ff.hourly_rows(h, ff.origin_hours(h, 6).filter(F.col("hour") <= cut), [1, 24, 48])
        return out.select([c for c in out.columns if not c.startswith(("target_t", "target_p", "target_d", "actual_"))]).orderBy("station_id", "hour", "horizon").toPandas()

    a, b = rows(hourly), rows(changed)
    assert len(a) > 0
    for c in a.columns:
        assert a[c].equals(b[c]), c


def test_sample_features_never_look_ahead(spark, hourly):
    when = T0 + timedelta(days=9, hours=10, minutes=20)
    sample = spark.createDataFrame([("a", when), ("b", when), ("nowhere", when)], "station_id string, timestamp timestamp_ntz")
    later = F.col("hour") >= HOUR0 + 9 * 24 + 10
    changed = hourly.withColumns({s: F.when(later, F.lit(99.0)).otherwise(F.col(s)) for s in S})
    a, b = (soft_features.sample_features(sample, df).orderBy("station_id").toPandas() for df in (hourly, changed))
    assert list(a["station_id"]) == ["a", "b"]
    for c in a.columns:
        assert a[c].equals(b[c]), c
    assert a["now_temperature"].notna().all() and a["gpp"].notna().any()


def test_sparse_windows_are_skipped(spark, hourly):
    when = T0 + timedelta(days=14, hours=9)  # nine hours past the end: only 15 hours of the window exist
    sample = spark.createDataFrame([("a", when)], "station_id string, timestamp timestamp_ntz")
    assert soft_features.sample_features(sample, hourly).count() == 0
    assert soft_features.covered_samples(sample, hourly).count() == 0


def test_rain_timing(spark):
    rows = [(HOUR0 + i, 0.5, 20.0 if i == 100 else 5.0 if i == 200 else 0.0) for i in range(240)]
    w = spark.createDataFrame(rows, "hour bigint, cloud_cover double, rain_mm double")
    at = {r["hour"] - HOUR0: r for r in soft_features.rain_features(w).collect()}
    assert at[99]["hours_since_rain"] == 336 and at[100]["hours_since_rain"] == 1 and at[149]["hours_since_rain"] == 50
    assert at[123]["rain_24h"] == 20.0 and at[124]["rain_24h"] == 0.0 and at[205]["rain_7d"] == 25.0


def test_latest_complete_hour_must_be_recent(spark, hourly):
    h = ff.working_hours(hourly)
    end = HOUR0 + 24 * 14 - 1
    stale = h.withColumn("ph", F.when((F.col("station_id") == "a") & (F.col("hour") > end - 30), None).otherwise(F.col("ph")))
    got = {r["station_id"]: r["hour"] for r in ff.latest_complete_hour(stale).collect()}
    assert "a" not in got and end - 24 <= got["b"] <= end


def test_slots_are_ten_minutes():
    assert SLOT_US == 600_000_000
