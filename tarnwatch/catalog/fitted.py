"""Queries with fitted or random parts, checked by shape only (I2, K1-K7, K10-K12, K14, K15, H18, E21 on models).

Model sizes are small here so that the check stays quick; every query still reads its whole tables.
"""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import water
from tarnwatch.functions.clock import from_day, from_hour
from tarnwatch.models import classifier, forecasters, importance, regression, soft_sensor
from tarnwatch.models.detector import LakeDetector
from tarnwatch.models.forest import IsolationForest
from tarnwatch.operators import calibration, grid, scoring, soft_features
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators.lineage import materialise
from tarnwatch.operators.splits import blocked_folds
from tarnwatch.sources import tables

from .detection import with_departures
from .evaluation import air_levels, lab_clean
from .forecasting import air_weather, hours
from .grading import wqi_inputs
from .lakes import features, hourly, weather
from .registry import register
from .windows import S, T0, dense_grid, stamped

SMALL = {"trees": 5, "depth": 3}


def _training_rows(spark, sf):
    rows = materialise(with_departures(spark, sf).select("station_id", "slot", *S, "candidate"), "departures")
    return materialise(blocked_folds(rows, "slot", K.CV_BLOCK_DAYS * K.SLOTS_PER_DAY)[0], "rows")


@register("k2_block_folds", f"""
SELECT station_id, {T0}, ((slot // 2016 - lo) % least(5, n))::INTEGER AS fold
FROM d_slot_grid, (SELECT min(slot // 2016) AS lo, count(DISTINCT slot // 2016) AS n FROM d_slot_grid)""")
def block_folds(spark, sf):
    return stamped(blocked_folds(dense_grid(spark, sf), "slot", K.CV_BLOCK_DAYS * K.SLOTS_PER_DAY)[0], ["fold"])


@register("k1_trend_plus_trees")
def trend_plus_trees(spark, sf):
    rows = _training_rows(spark, sf)
    inputs = ["temperature", "ph", "turbidity"]
    model = regression.TrendPlusTrees(inputs, "dissolved_oxygen", **SMALL).fit(rows)
    return regression.predict(model, rows, "predicted", inputs).select("station_id", "slot", "dissolved_oxygen", "predicted")


@register("k2_blocked_out_of_fold")
def blocked_out_of_fold(spark, sf):
    rows = _training_rows(spark, sf)
    inputs = ["temperature", "turbidity", "dissolved_oxygen"]
    trainer = regression.TrendPlusTrees(inputs, "ph", **SMALL)
    held = regression.out_of_fold(rows, trainer.fit, lambda m, part: regression.predict(m, part, "predicted", inputs), rows.agg(F.max("fold") + 1).first()[0])
    return held.select("station_id", "slot", "fold", "ph", "predicted")


@register("k4_isolation_forest")
def isolation_forest(spark, sf):
    rows = _training_rows(spark, sf).fillna(0.0, S)
    forest = IsolationForest(S, trees=50).fit(rows, ["station_id", "slot"])
    return forest.score(rows).select("station_id", "slot", "anomaly_score")


@register("k3_detector_verdicts")
def detector_verdicts(spark, sf):
    slots = dense_grid(spark, sf)
    detector = LakeDetector(trees=3, depth=3, folds=2, passes=1, forest_trees=25).fit(slots)
    return detector.detect(slots)


@register("i2_swapped_residuals")
def swapped_residuals(spark, sf):
    slots = dense_grid(spark, sf)
    detector = LakeDetector(trees=2, depth=2, folds=2, passes=1, forest_trees=10).fit(slots)
    out = detector.residuals(slots)
    return out.select("station_id", "slot", *[c for c in out.columns if c.startswith("z_")])


def _bounds(h):
    return h.agg(F.min("hour"), F.max("hour")).first()


@register("k6_hourly_forecast")
def hourly_forecast(spark, sf):
    h = materialise(hours(spark, sf), "hours")
    first, last = _bounds(h)
    cut = last - 240
    w = materialise(weather(spark, sf), "weather")
    model = forecasters.HourlyForecaster(["temperature", "dissolved_oxygen"], **SMALL).fit(h, cut, w, horizons=[1, 6, 24, 48], every=6)
    origins = ff.origin_hours(h, 6, since=cut)
    raw = materialise(model.working_forecast(h, origins, w, horizons=[1, 6, 24, 48], noisy=True), "forecast")
    model.calibrate(raw)
    out = model.finished(raw)
    return out.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", "sensor", "lo", "mid", "hi", "actual", "persistence", "same_hour_last_day")


@register("k5_quantile_coverage")
def quantile_coverage(spark, sf):
    out = hourly_forecast(spark, sf).filter("actual is not null")
    return scoring.hourly_report(out)


@register("e21_averaged_fitted_forecasts")
def averaged_fitted(spark, sf):
    h = materialise(hours(spark, sf), "hours")
    first, last = _bounds(h)
    members = [
        forecasters.HourlyForecaster(["dissolved_oxygen"], trees=t, depth=2, seed=t).fit(h, last - 240, horizons=[6, 24], every=6) for t in (3, 6)
    ]
    origins = ff.origin_hours(h, 12, since=last - 240)
    parts = [m.predict(h, origins, horizons=[6, 24]) for m in members]
    return calibration.averaged_quantiles(parts[0].unionByName(parts[1]), ["station_id", "hour", "horizon", "sensor"])


@register("k7_nightly_forecast")
def nightly_forecast(spark, sf):
    h = materialise(hours(spark, sf), "hours")
    first, last = _bounds(h)
    w = materialise(weather(spark, sf), "weather")
    cut = last - 240
    hourly_model = forecasters.HourlyForecaster(["dissolved_oxygen"], **SMALL).fit(h, cut, w, horizons=[6, 12, 24, 48], every=6)
    nights = materialise(ff.nightly_rows(h, w), "nights")
    issues = nights.select("station_id", (F.col("issue_day") * 24 + K.ISSUE_HOUR).alias("hour")).distinct()
    path = materialise(hourly_model.working_forecast(h, issues, w), "path")
    model = forecasters.NightlyForecaster(**SMALL).fit(h, cut, w)
    raw = materialise(model.working_forecast(h, w, path, nights), "nightly")
    out = model.calibrate(raw).finished(raw)
    return out.select("station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", "lo", "mid", "hi", "p_below_alert", "actual", "last_night", "week_mean")


@register("k6_air_forecast")
def air_forecast(spark, sf):
    levels = materialise(air_levels(spark, sf), "levels")
    first, last = _bounds(levels)
    cut = last - 168
    w = materialise(air_weather(spark, sf), "weather")
    model = forecasters.AirForecaster(**SMALL).fit_hourly(levels, cut, w, horizons=[1, 6, 24, 48], every=6)
    model.fit_daily(levels, cut // 24, w)
    issues = levels.filter(F.pmod("hour", F.lit(24)) == K.ISSUE_HOUR).select("station_id", "hour")
    path = materialise(model.hourly_forecast(levels, issues, w), "path")
    out = model.daily_outlook(levels, w, path)
    return out.select("station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", "pm25", "pm25_lo", "pm25_hi", "pm10", "pm_index", "pm_category", "p_poor_or_worse")


def _wqi_rows(spark, sf):
    rows = wqi_inputs(spark, sf).withColumn("wqi", water.wqi()).filter("wqi is not null")
    rows = rows.withColumn("temperature", F.col("conductivity") / 40)
    return rows.withColumn("wqi_class", water.wqi_class("wqi")).select("src_ord", "station_id", "timestamp", *S, "wqi_class")


@register("k10_wqi_classifier")
def wqi_classifier(spark, sf):
    train, test = classifier.time_split(materialise(_wqi_rows(spark, sf), "wqi"))
    model = classifier.WqiClassifier(folds=2, trees=10, depth=5).fit(train)
    return model.classify(test).select("src_ord", "wqi_class", "predicted_class", *[F.col(f"p_{c}").alias("p_" + c.replace(" ", "_").lower()) for c in K.WQI_CLASSES])


@register("k11_station_week_folds", """
SELECT src_ord, CASE WHEN epoch_us("timestamp") > (SELECT quantile_cont(epoch_us("timestamp")::DOUBLE, 0.8) FROM wqi_rows WHERE wqi IS NOT NULL) THEN -1
  ELSE (('0x' || substr(md5(station_id || '|' || strftime(date_trunc('week', "timestamp"), '%Y-%m-%d')), 1, 8))::BIGINT % 5)::INTEGER END AS fold
FROM wqi_rows WHERE wqi IS NOT NULL""")
def station_week_folds(spark, sf):
    train, test = classifier.time_split(_wqi_rows(spark, sf))
    parts = classifier.with_week_folds(train).select("src_ord", "fold").unionByName(test.select("src_ord", F.lit(-1).alias("fold")))
    return parts


@register("h18_latest_wqi_class")
def latest_wqi(spark, sf):
    from tarnwatch.functions.working import all_present
    from tarnwatch.operators.alerts import latest_per_station

    model = classifier.WqiClassifier(folds=2, trees=5, depth=4).fit(_wqi_rows(spark, sf))
    complete = hourly(spark, sf).filter(all_present(S))
    return model.classify(latest_per_station(complete, "hour")).select("station_id", from_hour(F.col("hour")).alias("hour"), "predicted_class")


def _soft_rows(spark, sf):
    lab = lab_clean(spark, sf).select("src_ord", "bod")
    return materialise(features(spark, sf).join(lab, "src_ord"), "soft_rows")


SOFT = [f"{k}_{s}" for s in S for k in ("now", "mean", "max")] + ["mean_do_deficit", "respiration", "rain_72h", "cloud_24h"]


@register("k12_soft_sensor")
def bod_soft_sensor(spark, sf):
    rows = _soft_rows(spark, sf)
    sensor = soft_sensor.SoftSensor("bod", SOFT, folds=3, trees=5).fit(rows)
    return sensor.estimate(rows).select("src_ord", "station_id", "bod", "bod_est", "bod_lo", "bod_hi", "p_above_2", "p_above_3")


@register("k14_unseen_station")
def unseen_station(spark, sf):
    lab = lab_clean(spark, sf)
    h = grid.hourly_grid(tables.readings(spark, sf), min_valid=1)
    rows = soft_features.sample_features(lab, h, weather(spark, sf))
    return soft_sensor.unseen_station_scores(rows, "bod", ["now_temperature", "mean_ph", "mean_turbidity", "mean_do_deficit", "rain_72h"], "ridge")


@register("k15_permutation_importance")
def permutation(spark, sf):
    rows = materialise(_wqi_rows(spark, sf), "wqi")
    model = classifier.WqiClassifier(folds=2, trees=5, depth=4).fit(rows)

    def score(df):
        return scoring.macro_f1(model.classify(df), "wqi_class", "predicted_class").select(F.col("macro_f1").alias("score"))

    return importance.permutation_importance(rows, S, ["src_ord"], score, repeats=2)
