"""Forecasters: lake sensors by the hour, pre-dawn oxygen by the night, particulates by the hour and the day.

Each is a `QuantileTrees` on the feature rows of `operators`, plus conformal offsets from verified forecasts. The
horizon is an input, so one model per target answers for every lead time.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.odds import prob_below
from tarnwatch.functions.timing import horizon_bucket
from tarnwatch.functions.working import from_working
from tarnwatch.operators import air_features, blending, calibration
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators.lineage import materialise

from .regression import QuantileTrees

IDENTITY = {"station_id", "hour", "horizon", "target_hour", "issue_day", "days_ahead", "night_of", "day", "actual", "night_min_change"}


def feature_names(rows: DataFrame, extra=()) -> list[str]:
    """Every column that is neither identity nor outcome."""
    return [c for c in rows.columns if c not in IDENTITY and not c.startswith(("actual_", "target_p", "same_raw_"))
            and c not in extra and c not in {f"target_{s}" for s in K.LAKE_SENSORS}]


class HourlyForecaster:
    """Every sensor, every hour ahead, as an 80% range around a median."""

    def __init__(self, sensors=K.LAKE_SENSORS, trees: int = 40, depth: int = 5, seed: int = 42, noise: bool = True):
        self.sensors, self.trees, self.depth, self.seed, self.noise = list(sensors), trees, depth, seed, noise
        self.offsets = None

    def rows(self, hours: DataFrame, origins: DataFrame, horizons, weather: DataFrame | None, noisy: bool) -> DataFrame:
        out = ff.hourly_rows(hours, origins, horizons, weather)
        if weather is not None and noisy and self.noise:
            out = ff.noisy_weather(out, self.seed)
        return out.withColumn("bucket", horizon_bucket("horizon", K.LAKE_BUCKETS))

    def fit(self, hours: DataFrame, until: int, weather: DataFrame | None = None, horizons=K.TRAIN_HORIZONS, every: int = 3):
        """Learn from origins whose targets lie before hour `until`; nothing later is read."""
        past = hours.filter(F.col("hour") < until)
        rows = self.rows(past, ff.origin_hours(past, every, room=1), horizons, weather, noisy=True)
        rows = rows.filter(F.col("target_hour") < until)
        self.features = [*feature_names(rows, ("bucket",)), "horizon"]
        self.model = QuantileTrees(self.features, {s: f"target_{s}" for s in self.sensors}, ["bucket"], self.trees, self.depth, self.seed).fit(rows)
        return self

    def working_forecast(self, hours: DataFrame, origins: DataFrame, weather=None, horizons=None, noisy: bool = False) -> DataFrame:
        """Uncalibrated ranges and the readings to score them with, on the working scale, one row per sensor."""
        horizons = horizons or list(range(1, K.MAX_HORIZON + 1))
        rows = materialise(self.rows(hours, origins, horizons, weather, noisy), "forecast_rows")
        change = self.model.predict(rows, ["station_id", "hour", "horizon", "target_hour"])
        known = F.explode(
            F.array(*[
                F.struct(
                    F.lit(s).alias("sensor"), F.col(f"now_{s}").alias("now"), F.col(f"actual_{s}").alias("actual"),
                    (F.col(f"same_hour_last_day_{s}") + F.col(f"now_{s}")).alias("same_hour_last_day"),
                ) for s in self.sensors
            ])
        )
        seen = rows.select("station_id", "hour", "horizon", known.alias("k")).select("station_id", "hour", "horizon", "k.*")
        out = change.join(seen, ["station_id", "hour", "horizon", "sensor"])
        return out.withColumns({q: F.col("now") + F.col(q) for q in ("lo", "mid", "hi")})

    def calibrate(self, forecast: DataFrame) -> "HourlyForecaster":
        """Offsets per sensor and bucket from verified working-scale forecasts; groups with too few keep theirs."""
        found = calibration.fit_offsets(forecast, ["sensor", "bucket"])
        self.offsets = materialise(found if self.offsets is None else calibration.refreshed(self.offsets, found, ["sensor", "bucket"]), "offsets")
        return self

    def finished(self, forecast: DataFrame) -> DataFrame:
        """Calibrated, in each sensor's own units, with the simple forecasts beside it."""
        out = forecast if self.offsets is None else calibration.apply_offsets(forecast, self.offsets, ["sensor", "bucket"])
        out = out.withColumnRenamed("now", "persistence")
        turbid = F.col("sensor") == "turbidity"
        return out.withColumns(
            {c: F.when(turbid, from_working(c, "turbidity")).otherwise(F.col(c))
             for c in ("lo", "mid", "hi", "actual", "persistence", "same_hour_last_day")}
        )

    def predict(self, hours: DataFrame, origins: DataFrame, weather=None, horizons=None, noisy: bool = False) -> DataFrame:
        return self.finished(self.working_forecast(hours, origins, weather, horizons, noisy))


class NightlyForecaster:
    """Pre-dawn oxygen minimum of the coming nights and the chance it falls below the alert level."""

    def __init__(self, trees: int = 40, depth: int = 5, seed: int = 42):
        self.trees, self.depth, self.seed = trees, depth, seed
        self.offsets = None

    def fit(self, hours: DataFrame, until: int, weather: DataFrame | None = None) -> "NightlyForecaster":
        past = hours.filter(F.col("hour") < until)
        rows = ff.nightly_rows(past, weather).filter(F.col("night_of") * 24 + K.NIGHT_LAST <= until)
        self.features = [*feature_names(rows), "days_ahead"]
        self.model = QuantileTrees(self.features, {"night": "night_min_change"}, ["days_ahead"], self.trees, self.depth, self.seed).fit(rows)
        return self

    def working_forecast(self, hours: DataFrame, weather=None, path: DataFrame | None = None, rows: DataFrame | None = None) -> DataFrame:
        """Ranges of each issue's nights; with the hourly `path`, its minimum for the nights it covers."""
        rows = materialise(rows if rows is not None else ff.nightly_rows(hours, weather), "night_rows")
        change = self.model.predict(rows, ["station_id", "issue_day", "days_ahead", "night_of"]).drop("sensor")
        known = rows.select("station_id", "issue_day", "days_ahead", "last_night_min", "week_mean_night_min", "actual")
        out = change.join(known, ["station_id", "issue_day", "days_ahead"])
        out = out.withColumns({q: F.col("last_night_min") + F.col(q) for q in ("lo", "mid", "hi")})
        out = out.withColumn("week_mean", F.col("last_night_min") + F.col("week_mean_night_min"))
        out = out.withColumnRenamed("last_night_min", "last_night").drop("week_mean_night_min")
        return blending.prefer_path(out, path) if path is not None else out

    def calibrate(self, forecast: DataFrame) -> "NightlyForecaster":
        found = calibration.fit_offsets(forecast, ["days_ahead"])
        self.offsets = materialise(found if self.offsets is None else calibration.refreshed(self.offsets, found, ["days_ahead"]), "offsets")
        return self

    def finished(self, forecast: DataFrame, level: float = K.DO_ALERT) -> DataFrame:
        out = forecast if self.offsets is None else calibration.apply_offsets(forecast, self.offsets, ["days_ahead"])
        out = out.withColumn("p_below_alert", prob_below(level, "lo", "mid", "hi"))
        return out.withColumns({q: F.greatest(F.col(q), F.lit(0.0)) for q in ("lo", "mid", "hi")})


class AirForecaster:
    """PM2.5 and PM10 for the coming hours, and the coming days' means with what they mean for the index."""

    def __init__(self, targets=("pm25", "pm10"), trees: int = 40, depth: int = 5, seed: int = 42):
        self.targets, self.trees, self.depth, self.seed = list(targets), trees, depth, seed
        self.offsets = None

    def hourly_rows(self, levels, origins, horizons, weather=None):
        rows = air_features.hourly_rows(levels, origins, horizons, weather, self.targets)
        return rows.withColumn("bucket", horizon_bucket("horizon", K.AIR_BUCKETS))

    def fit_hourly(self, levels: DataFrame, until: int, weather=None, horizons=K.AIR_TRAIN_HORIZONS, every: int = 3) -> "AirForecaster":
        past = levels.filter(F.col("hour") < until)
        rows = self.hourly_rows(past, ff.origin_hours(past, every, history=168, room=1), horizons, weather)
        rows = rows.filter(F.col("target_hour") < until)
        self.hourly_features = [*feature_names(rows, ("bucket", *[f"target_{t}" for t in self.targets])), "horizon"]
        goals = {t: f"target_{t}" for t in self.targets}
        self.hourly = QuantileTrees(self.hourly_features, goals, ["bucket"], self.trees, self.depth, self.seed).fit(rows)
        return self

    def hourly_forecast(self, levels: DataFrame, origins: DataFrame, weather=None, horizons=None) -> DataFrame:
        """Log-scale ranges per station, origin, horizon and pollutant."""
        rows = materialise(self.hourly_rows(levels, origins, horizons or list(range(1, K.MAX_HORIZON + 1)), weather), "air_rows")
        change = self.hourly.predict(rows, ["station_id", "hour", "horizon", "target_hour"])
        seen = rows.select("station_id", "hour", "horizon", F.explode(F.array(*[
            F.struct(F.lit(t).alias("sensor"), F.col(f"now_{t}").alias("now"), F.col(f"actual_{t}").alias("actual")) for t in self.targets
        ])).alias("k")).select("station_id", "hour", "horizon", "k.*")
        out = change.join(seen, ["station_id", "hour", "horizon", "sensor"]).withColumnRenamed("sensor", "pollutant")
        return out.withColumns({q: F.col("now") + F.col(q) for q in ("lo", "mid", "hi")})

    def calibrate(self, forecast: DataFrame) -> "AirForecaster":
        found = calibration.fit_offsets(forecast, ["pollutant", "bucket"])
        self.offsets = materialise(found if self.offsets is None else calibration.refreshed(self.offsets, found, ["pollutant", "bucket"]), "offsets")
        return self

    def finished(self, forecast: DataFrame) -> DataFrame:
        """Concentrations, calibrated."""
        out = forecast if self.offsets is None else calibration.apply_offsets(forecast, self.offsets, ["pollutant", "bucket"])
        out = out.withColumnRenamed("now", "persistence")
        return out.withColumns({c: F.expm1(c) for c in ("lo", "mid", "hi", "actual", "persistence")})

    def fit_daily(self, levels: DataFrame, until_day: int, weather=None) -> "AirForecaster":
        rows = air_features.daily_rows(levels, weather, self.targets).filter(F.col("day") < until_day)
        self.daily_features = [*feature_names(rows, [f"target_{t}" for t in self.targets]), "days_ahead"]
        self.daily = QuantileTrees(self.daily_features, {t: f"target_{t}" for t in self.targets}, ["days_ahead"], self.trees, self.depth, self.seed).fit(rows)
        return self

    def daily_outlook(self, levels: DataFrame, weather=None, path: DataFrame | None = None) -> DataFrame:
        """Per station, issue and day ahead: ranges, index, category and the chance of Poor air."""
        rows = materialise(air_features.daily_rows(levels, weather, self.targets), "air_days")
        change = self.daily.predict(rows, ["station_id", "issue_day", "days_ahead", "day"])
        now = F.element_at(F.create_map(*[x for t in self.targets for x in (F.lit(t), F.col(f"last24_{t}"))]), F.col("sensor"))
        long = change.join(rows.select("station_id", "issue_day", "days_ahead", *[f"last24_{t}" for t in self.targets]), ["station_id", "issue_day", "days_ahead"])
        long = long.withColumns({q: now + F.col(q) for q in ("lo", "mid", "hi")}).drop(*[f"last24_{t}" for t in self.targets])
        if path is not None:
            parts = [
                blending.prefer_path_means(long.filter(F.col("sensor") == t), path.filter(F.col("pollutant") == t)) for t in self.targets
            ]
            long = parts[0]
            for p in parts[1:]:
                long = long.unionByName(p)
        keys = ["station_id", "issue_day", "days_ahead", "day"]
        cols = [
            F.max(F.when(F.col("sensor") == t, F.expm1(q))).alias(f"{t}_{q}" if q != "mid" else t) for t in self.targets for q in ("lo", "mid", "hi")
        ]
        wide = long.groupBy(*keys).agg(*cols)
        actual = rows.select("station_id", "issue_day", "days_ahead", *[
            c for t in self.targets for c in (F.expm1(f"actual_{t}").alias(f"{t}_actual"), F.expm1(f"last24_{t}").alias(f"{t}_last24h"))
        ])
        return blending.particulate_outlook(wide.join(actual, ["station_id", "issue_day", "days_ahead"]), self.targets)
