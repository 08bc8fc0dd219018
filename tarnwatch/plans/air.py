"""Air status: the index now, the last day's sensor flags, particulate forecasts, alerts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.clock import hour_no
from tarnwatch.models.forecasters import AirForecaster
from tarnwatch.operators import air_features, air_qc, alerts, naqi
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators.lineage import materialise


def air_status(readings: DataFrame, weather_raw: DataFrame | None = None, model: AirForecaster | None = None) -> dict[str, DataFrame]:
    """current, flags, and with a model hourly, daily; plus the alerts they raise."""
    checked = materialise(air_qc.check_air(air_qc.air_hourly(readings), weather_raw), "air_checked")
    current = naqi.current_index(naqi.naqi(naqi.averaged(checked)))
    out = {"checked": checked, "current": materialise(current, "air_current"), "flags": air_qc.recent_flags(checked)}
    if model is None:
        return out
    levels = materialise(air_features.log_levels(checked, model.targets), "levels")
    weather = weather_raw.withColumn("hour", hour_no(F.col("timestamp"))).drop("timestamp") if weather_raw is not None else None
    # A week of history behind the latest complete hour, and that hour no more than a day old.
    start = levels.groupBy("station_id").agg((F.min("hour") + 168).alias("_ready"))
    latest = ff.latest_complete_hour(levels, model.targets).join(start, "station_id").filter("hour >= _ready").drop("_ready")
    path = materialise(model.hourly_forecast(levels, latest, weather), "air_path")
    out["hourly"] = model.finished(path)
    daily = model.daily_outlook(levels, weather, path)
    today = latest.select("station_id", ff.issue_day("hour").alias("issue_day"), F.floor(F.col("hour") / 24).alias("_today"))
    out["daily"] = materialise(daily.join(today, ["station_id", "issue_day"]).filter("day >= _today").drop("_today"), "air_daily")
    out["alerts"] = alerts.air_alerts(out["current"], out["flags"], out["daily"])
    return out
