"""Train every model the data allows, in the order they depend on each other, and keep their scores."""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.parse import parse_numeric
from tarnwatch.functions.water import wqi, wqi_class
from tarnwatch.functions.working import all_present
from tarnwatch.models.classifier import WqiClassifier, time_split
from tarnwatch.models.detector import LakeDetector
from tarnwatch.models.forecasters import HourlyForecaster, NightlyForecaster
from tarnwatch.models.soft_sensor import SoftSensor
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators import grid as grids
from tarnwatch.operators import soft_features
from tarnwatch.operators.lab import beside_sensors, clean_lab
from tarnwatch.operators.lineage import materialise
from tarnwatch.sources.readers import read_lab

BASE_INPUTS = [
    *[f"{k}_{s}" for s in K.LAKE_SENSORS for k in ("now", "mean", "min", "max")], "mean_do_deficit", "respiration", "reaeration",
    "night_temperature", "gpp", "nep", "do_amplitude", "log_respiration",
]
WEATHER_INPUTS = ["rain_72h", "cloud_24h"]
EXTRA_INPUTS = {
    "bod": [],
    "chlorophyll_a": ["log_gpp", "swing_ph"],
    "total_coliform": ["rain_24h", "rain_7d", "hours_since_rain", "log_rain_24h", "log_rain_72h", "log_rain_7d", "log_hours_since_rain"],
}


@dataclass
class Models:
    """What a daily run needs. A model that could not be trained is None, with the reason in `skipped`."""

    detector: LakeDetector
    hourly: HourlyForecaster | None = None
    nightly: NightlyForecaster | None = None
    soft: dict = field(default_factory=dict)
    wqi: WqiClassifier | None = None
    trained_until: int = 0
    skipped: dict = field(default_factory=dict)


def soft_inputs(target: str, weather: bool) -> list[str]:
    extra = EXTRA_INPUTS[target] if weather or target == "chlorophyll_a" else []
    return [*BASE_INPUTS, *(WEATHER_INPUTS if weather else []), *extra]


def soft_rows(samples: DataFrame, hourly: DataFrame, weather: DataFrame | None, target: str) -> DataFrame:
    rows = soft_features.sample_features(samples, hourly, weather)
    if target == "chlorophyll_a":
        return soft_features.algae_extras(rows)
    return soft_features.coliform_extras(rows) if target == "total_coliform" and weather is not None else rows


def wqi_training_rows(lab: DataFrame, hourly: DataFrame) -> DataFrame:
    """Lab samples beside the sensors' last complete hour, labelled by the index computed from lab values."""
    typed = lab.withColumns({c: parse_numeric(c) for c in ("bod", "conductivity", "nitrate")})
    rows = beside_sensors(typed, hourly)
    from tarnwatch.functions.water import label_columns

    rows = rows.withColumn("wqi", wqi(label_columns(rows.columns))).filter(F.col("wqi").isNotNull())
    return rows.withColumn("wqi_class", wqi_class("wqi"))


def train(grid: DataFrame, lab: DataFrame | None = None, weather_raw: DataFrame | None = None, trees: int = 40, depth: int = 5,
          folds: int = K.CV_FOLDS, passes: int = 2, forest_trees: int = K.FOREST_TREES, calibration_hours: int = 720,
          min_samples: int = K.READY_LAB_SAMPLES) -> Models:
    """Fit the detector, mask what it blames, and train everything else on the cleaned history."""
    grid = materialise(grid, "history")
    detector = LakeDetector(trees, depth, folds, passes, forest_trees).fit(grid, weather_raw)
    cleaned = grids.mask_faulty(materialise(detector.detect(grid, weather_raw), "flagged"))
    hourly = materialise(grids.on_calendar(grids.hourly_values(cleaned), "hour"), "hourly")
    weather = materialise(grids.weather_grid(weather_raw, K.WEATHER_LAKE), "weather") if weather_raw is not None else None
    hours = materialise(ff.working_hours(hourly), "hours")
    last = hours.agg(F.max("hour")).first()[0] + 1
    models = Models(detector, trained_until=last)

    cut = last - calibration_hours
    models.hourly = HourlyForecaster(trees=trees, depth=depth).fit(hours, cut, weather)
    origins = ff.origin_hours(hours, 3, since=cut)
    raw = materialise(models.hourly.working_forecast(hours, origins, weather, K.TRAIN_HORIZONS, noisy=True), "calibration")
    models.hourly.calibrate(raw)
    models.nightly = NightlyForecaster(trees, depth).fit(hours, cut, weather)
    recent = ff.nightly_rows(hours, weather).filter(F.col("issue_day") * 24 >= cut)
    models.nightly.calibrate(models.nightly.working_forecast(hours, weather, rows=recent))

    if lab is None:
        models.skipped = {m: "no lab results" for m in [*EXTRA_INPUTS, "wqi"]}
        return models
    for target in EXTRA_INPUTS:
        if target not in lab.columns:
            models.skipped[target] = f"no '{target}' column in the lab results"
            continue
        samples = clean_lab(read_lab(lab, target), target)
        rows = materialise(soft_rows(samples, hourly, weather, target), f"{target}_rows")
        n = rows.count()
        if n < min_samples:
            models.skipped[target] = f"only {n} lab samples have sensor data around them"
            continue
        models.soft[target] = SoftSensor(target, soft_inputs(target, weather is not None), trees=trees).fit(rows)
    rows = materialise(wqi_training_rows(lab, hourly), "wqi_rows")
    if rows.count() < min_samples:
        models.skipped["wqi"] = "too few lab samples beside complete sensor hours"
    else:
        models.wqi = WqiClassifier(trees=trees, depth=depth).fit(time_split(rows, 0.2)[0])
    return models


def complete_hours(hourly: DataFrame) -> DataFrame:
    return hourly.filter(all_present(K.LAKE_SENSORS))
