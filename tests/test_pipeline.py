"""Models on built series, the whole chain from export to report, and the driver contract."""

from datetime import datetime as dt, timedelta

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tarnwatch import constants as K
from tarnwatch.models import classifier, importance, regression, soft_sensor
from tarnwatch.models.forest import IsolationForest
from tarnwatch.operators import calibration, grid, scoring
from tarnwatch.plans import daily, training
from tarnwatch.sources import vendor

T0 = dt(2024, 1, 1)
DAYS = 30
S = K.LAKE_SENSORS


@pytest.fixture(scope="module")
def export(spark):
    """Two stations at 10 minutes: a daily cycle, weather-driven oxygen, and one pH sensor that sticks out late."""
    rng = np.random.default_rng(11)
    rows, n = [], DAYS * 144
    for k, s in enumerate(("north", "south")):
        day = np.arange(n) / 144
        temp = 24 + 2 * np.sin(2 * np.pi * day) + 0.5 * np.sin(day / 5) + rng.normal(0, 0.03, n) + k
        oxy = 7.5 + 1.5 * np.sin(2 * np.pi * (day - 0.4)) + rng.normal(0, 0.05, n)
        ph = 7.8 + 0.15 * (oxy - 7.5) + rng.normal(0, 0.01, n)
        turb = np.exp(1.2 + 0.1 * np.sin(day) + rng.normal(0, 0.02, n))
        if s == "south":
            ph[-36:-6] += 2.0
        for i in range(n):
            rows.append((s, T0 + timedelta(minutes=10 * i), float(temp[i]), float(ph[i]), float(turb[i]), float(oxy[i]), len(rows)))
    return spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, temperature double, ph double, turbidity double, dissolved_oxygen double, src_ord int").cache()


@pytest.fixture(scope="module")
def weather(spark):
    rng = np.random.default_rng(4)
    rows = [(T0 + timedelta(hours=h), float(20 + 5 * np.sin(h / 24 * 6.28)), float(rng.random()), float(max(0, rng.normal(-2, 2)))) for h in range((DAYS + 8) * 24)]
    return spark.createDataFrame(rows, "timestamp timestamp_ntz, air_temperature double, cloud_cover double, rain_mm double").cache()


@pytest.fixture(scope="module")
def lab(spark):
    rng = np.random.default_rng(6)
    rows = []
    for s in ("north", "south"):
        for i in range(5, DAYS * 2 - 2):
            when = T0 + timedelta(hours=12 * i, minutes=20)
            rows.append((s, when, len(rows), f"{float(np.exp(rng.normal(0.8, 0.4))):.2f}", float(300 + 50 * rng.random()), float(10 * rng.random()), f"{float(np.exp(rng.normal(2, 0.5))):.1f}", "<2" if i % 9 == 0 else f"{float(np.exp(rng.normal(6, 1))):.0f}"))
    return spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, src_ord int, bod string, conductivity double, nitrate double, chlorophyll_a string, total_coliform string").cache()


@pytest.fixture(scope="module")
def models(spark, export, weather, lab):
    history = grid.slot_grid(export.filter(F.col("timestamp") < F.lit(T0 + timedelta(days=DAYS - 1))))
    return training.train(history, lab, weather, trees=3, depth=3, folds=2, passes=1, forest_trees=20, calibration_hours=240)


def test_training_covers_every_model(models):
    assert models.hourly and models.nightly and models.wqi and set(models.soft) == {"bod", "chlorophyll_a", "total_coliform"}
    assert models.skipped == {} and all(v >= K.DRIFT_MIN for v in models.detector.drift_limit.values())


def test_daily_run_blames_the_right_sensor_and_writes_a_report(spark, models, export, weather, tmp_path):
    mapping = vendor.VendorMapping(limits={"ph": (0.0, 14.0)})
    text = export.withColumns({c: F.col(c).cast("string") for c in ("timestamp", *S)})
    result = daily.daily_run(text, mapping, models, weather, window_hours=24)
    flags = result["flags"]
    blamed = flags.filter("station_id = 'south'").agg(*[F.count_if(F.col(f"{s}_fault") != "").alias(s) for s in S]).first().asDict()
    assert blamed["ph"] >= 10 and blamed["ph"] > max(blamed[s] for s in S if s != "ph")
    calm = flags.filter("station_id = 'north'").agg(F.avg((F.col("verdict") == "normal").cast("double"))).first()[0]
    assert calm > 0.8
    hourly = result["hourly"]
    assert hourly.filter("not (lo <= mid and mid <= hi)").count() == 0 and hourly.count() == 2 * 48 * 4
    nights = result["nightly"].toPandas()
    assert len(nights) >= 12 and nights["p_below_alert"].between(0, 1).all() and (nights["lo"] <= nights["hi"]).all()
    bod = result["bod"].toPandas()
    assert (bod["bod_lo"] <= bod["bod_hi"]).all() and set(bod["cpcb_class"]) <= {"A", "B", "C", "D", "E", "below E", "unknown"}
    assert (bod["p_above_2"] >= bod["p_above_3"] - 1e-12).all()
    written = daily.write_run(result, str(tmp_path / "run"))
    assert {"flags", "hourly", "nightly", "bod", "algae", "coliform"} <= set(written)
    sections = spark.read.json(str(tmp_path / "run" / "report_stations"))
    assert sections.count() == 2 and "lowest_oxygen" in str(sections.schema)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "run" / "report_text")).collect()]
    assert any(x.startswith("=== north") for x in lines) and any("Pre-dawn oxygen" in x for x in lines)
    assert any("Sensor fault on" in r["message"] for r in result["alerts"].collect())


def test_detection_is_repeatable(models, export, weather):
    rows = grid.slot_grid(export.filter(F.col("timestamp") >= F.lit(T0 + timedelta(days=DAYS - 9))))
    a, b = (models.detector.detect(rows, weather).orderBy("station_id", "slot").toPandas() for _ in range(2))
    assert a.equals(b)


def test_forecast_beats_persistence_at_six_hours(spark, models, export, weather):
    from tarnwatch.operators import forecast_features as ff

    hours = ff.working_hours(grid.hourly_grid(export))
    w = grid.weather_grid(weather, K.WEATHER_LAKE)
    last = hours.agg(F.max("hour")).first()[0]
    origins = ff.origin_hours(hours, 6, since=last - 200)
    fc = models.hourly.predict(hours, origins, w, horizons=[6])
    r = {x["sensor"]: x for x in scoring.hourly_report(fc).collect()}
    assert r["dissolved_oxygen"]["mae"] < r["dissolved_oxygen"]["mae_persistence"]
    assert 0.4 <= r["dissolved_oxygen"]["coverage_80"] <= 1.0


def test_trend_plus_trees_learns_a_curve(spark):
    rng = np.random.default_rng(0)
    rows = [("a" if i % 2 else "b", float(x), float(2 * x + np.sin(4 * x) + (i % 2))) for i, x in enumerate(rng.uniform(-2, 2, 600))]
    df = spark.createDataFrame(rows, "station_id string, x double, y double")
    model = regression.TrendPlusTrees(["x"], "y", trees=15, depth=4).fit(df)
    out = regression.predict(model, df.unionByName(spark.createDataFrame([("a", None, 1.0)], df.schema)), "p", ["x"])
    assert out.filter("p is null").count() == 1
    assert out.agg(F.sqrt(F.avg((F.col("p") - F.col("y")) ** 2))).first()[0] < 0.5


def test_forest_scores_an_outlier_highest(spark):
    rng = np.random.default_rng(0)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (600, 2)))] + [(9999, 9.0, -9.0)]
    df = spark.createDataFrame(rows, "i int, a double, b double")
    out = IsolationForest(["a", "b"], trees=50).fit(df, ["i"]).score(df)
    top = out.orderBy(F.desc("anomaly_score")).first()
    assert top["i"] == 9999 and 0.6 < top["anomaly_score"] <= 1.0


def test_time_split_never_trains_on_the_future(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(days=i), i) for i in range(50)], "station_id string, timestamp timestamp_ntz, i int")
    train, test = classifier.time_split(df, 0.2)
    assert train.agg(F.max("timestamp")).first()[0] < test.agg(F.min("timestamp")).first()[0] and test.count() == 10
    folds = classifier.with_week_folds(df, 3).groupBy(F.date_trunc("week", "timestamp")).agg(F.countDistinct("fold").alias("n"))
    assert folds.filter("n > 1").count() == 0


def test_soft_sensor_finds_the_signal(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        x, noise = rng.normal(), rng.normal()
        rows.append((["a", "b", "c"][i % 3], T0 + timedelta(hours=6 * i), float(x), float(noise), float(np.exp(1 + 0.8 * x + 0.1 * rng.normal()))))
    df = spark.createDataFrame(rows, "station_id string, timestamp timestamp_ntz, x double, z double, bod double")
    sensor = soft_sensor.SoftSensor("bod", ["x", "z"], folds=3, trees=10).fit(df)
    assert sensor.name in ("ridge", "components")
    out = sensor.estimate(df)
    assert out.agg(F.avg(F.col("bod").between(F.col("bod_lo"), F.col("bod_hi")).cast("double"))).first()[0] == pytest.approx(0.8, abs=0.08)
    assert out.filter("p_above_2 < p_above_3").count() == 0
    unseen = soft_sensor.unseen_station_scores(df, "bod", ["x", "z"], "ridge", folds=8)
    assert unseen.agg(F.max("mae")).first()[0] < 1.0


def test_permutation_hurts_only_the_informative_input(spark):
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(rng.normal(0, 1, (300, 2)))], "i int, a double, b double")

    def score(t):
        return t.agg((-F.avg(F.abs(F.col("a") - F.col("y")))).alias("score"))

    got = {r["feature"]: r["mean"] for r in importance.permutation_importance(df.withColumn("y", F.col("a")), ["a", "b"], ["i"], score, 2).collect()}
    assert got["a"] > 0.5 and abs(got["b"]) < 1e-9
    dealt = importance.permuted(df, "a", ["i"], 1)
    assert dealt.count() == 300 and dealt.agg(F.sum("a")).first()[0] == pytest.approx(df.agg(F.sum("a")).first()[0])


def test_weekly_offsets_use_only_verified_forecasts(spark):
    rows = [("g", h, -1.0, 0.0, 1.0, 2.0 if h < 500 else 9.0) for h in range(0, 1000)]
    fc = spark.createDataFrame(rows, "k string, hour bigint, lo double, mid double, hi double, actual double")
    weeks = {r["week"]: r["offset"] for r in calibration.weekly_offsets(fc, ["k"], "hour", 540, 1000).collect()}
    assert weeks[0] == 1.0  # origins up to 491 only: nothing unverified, nothing later
    assert set(weeks) == {0, 1, 2}


# ---------------------------------------------------------------------------- driver contract


def test_entry_and_registry(spark):
    df = entry.entry(spark)
    assert df.columns == ["station_id", "timestamp", *S] and df.count() > 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    assert set(sqls) <= set(queries) and len(queries) > 150
    assert all(callable(q) for q in queries.values())


@pytest.mark.parametrize("name", ["a6_parse_numeric", "c5_vendor_normalise", "d5_slot_grid", "d14_explained_incidents", "f13_reset_capped_ewma", "c21_naqi", "e16_daily_metabolism", "e17_conformal_offsets"])
def test_queries_agree_with_sql_on_the_smallest_tables(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = entry.queries()[name](spark, sf)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols

    def norm(rows):
        return sorted([tuple(str(int(x)) if isinstance(x, float) and x == int(x) else str(x) for x in r) for r in rows])

    mine = norm([[r[c] for c in cols] for r in df.collect()])
    theirs = norm([[r[rel.columns.index(c)] for c in cols] for r in rel.fetchall()])
    assert mine == theirs
