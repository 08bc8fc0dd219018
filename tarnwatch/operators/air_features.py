"""Particulate forecast rows: hourly (48 h) and daily (tomorrow and the day after), on the log scale."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import day_of_hour, from_day, from_hour, hour_of_day
from tarnwatch.functions.timing import cyclic, is_weekend
from tarnwatch.functions.working import at_least

from .chunks import framed
from .forecast_features import same_hour_offset
from .grid import on_calendar
from .lineage import materialise

TARGETS = ["pm25", "pm10"]
WEATHER = ["wind_speed", "boundary_layer_height", "relative_humidity", "air_temperature", "rain_mm"]


def log_levels(checked: DataFrame, targets=TARGETS) -> DataFrame:
    """Gap-free hourly log particle levels."""
    grid = on_calendar(checked.select("station_id", "hour", *targets), "hour")
    return grid.select("station_id", "hour", *[F.log1p(at_least(t, 0.0)).alias(t) for t in targets])


def level_means(levels: DataFrame, targets=TARGETS, extra=None) -> DataFrame:
    """Adds `day_<t>` and `week_<t>`: logs of the mean concentration over 24 hours and 7 days (16 and 72 known)."""

    def means(w):
        out = {}
        for t in targets:
            level = F.expm1(t)
            for name, span, least in (("day", 24, K.MIN_HOURS_24), ("week", 168, 72)):
                frame = w.rowsBetween(-(span - 1), 0)
                out[f"{name}_{t}"] = F.when(F.count(t).over(frame) >= least, F.log1p(F.avg(level).over(frame)))
        return out

    return framed(levels, ["station_id"], "hour", [means, *(extra or [])], before=167, after=K.MAX_HORIZON)


def _capped_log(height) -> Column:
    return F.ln(at_least(height, 10.0))


def hourly_weather(weather: DataFrame, columns=WEATHER) -> DataFrame:
    """Per hour the weather inputs: rain summed over the six hours up to then, mixing height on the log scale."""
    used = [c for c in columns if c in weather.columns]
    grid = on_calendar(weather.select("hour", *used).withColumn("_all", F.lit(0)), "hour", beyond=5, keys=("_all",))
    out = framed(
        grid, ["_all"], "hour", [lambda w: {"_rain": F.coalesce(F.sum("rain_mm").over(w.rowsBetween(-5, 0)), F.lit(0.0))}],
        before=5,
    )
    value = {"rain_mm": F.col("_rain"), "boundary_layer_height": _capped_log("boundary_layer_height")}
    return out.select("hour", *[value.get(c, F.col(c)).alias(c) for c in used])


def hourly_rows(levels: DataFrame, origins: DataFrame, horizons, weather: DataFrame | None = None, targets=TARGETS) -> DataFrame:
    """One row per origin and horizon with features, `actual_<t>` and `target_<t>` (change from the origin)."""
    row = F.struct(*targets)

    def gather(w):
        out = {f"_lag{k}_{t}": F.lag(t, k).over(w) for k in K.LAGS_HOURS for t in targets}
        out["_past"] = F.collect_list(row).over(w.rowsBetween(-23, 0))
        out["_next"] = F.collect_list(row).over(w.rowsBetween(1, K.MAX_HORIZON))
        return out

    rows = level_means(levels, targets, [gather]).join(origins, ["station_id", "hour"])
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    rows = rows.withColumns(
        {
            "target_hour": F.col("hour") + F.col("horizon"),
            "_same": F.get("_past", F.size("_past") - 1 - same_hour_offset("horizon")),
            "_goal": F.get("_next", F.col("horizon") - 1),
        }
    )
    feats: dict[str, Column] = {}
    for name, clock in (("issue", "hour"), ("target", "target_hour")):
        feats[f"{name}_hour_sin"], feats[f"{name}_hour_cos"] = cyclic(hour_of_day(F.col(clock)))
    feats["target_weekend"] = is_weekend(from_hour(F.col("target_hour"))).cast("double")
    for t in targets:
        now = F.col(t)
        feats[f"now_{t}"] = now
        for k in K.LAGS_HOURS:
            feats[f"lag{k}_{t}"] = F.col(f"_lag{k}_{t}") - now
        feats[f"day_mean_{t}"] = F.col(f"day_{t}") - now
        feats[f"week_mean_{t}"] = F.col(f"week_{t}") - now
        feats[f"same_hour_{t}"] = F.col(f"_same.{t}") - now
        feats[f"actual_{t}"] = F.col(f"_goal.{t}")
        feats[f"target_{t}"] = F.col(f"_goal.{t}") - now
    out = rows.select("station_id", "hour", "horizon", "target_hour", *[c.alias(n) for n, c in feats.items()])
    if weather is None:
        return out
    w = materialise(hourly_weather(weather), "air_weather")
    names = [c for c in w.columns if c != "hour"]
    here = w.select("hour", *[F.col(c).alias(f"now_{c}") for c in names])
    there = w.select(F.col("hour").alias("target_hour"), *[F.col(c).alias(f"target_{c}") for c in names])
    out = out.join(here, "hour", "left").join(there, "target_hour", "left")
    # No known hour means no known rain, which the sum reads as none.
    return out.fillna(0.0, ["now_rain_mm", "target_rain_mm"]) if "rain_mm" in names else out


def day_weather(weather: DataFrame, columns=WEATHER) -> DataFrame:
    """Per day: means of the weather, rain total, how high the day mixes and how low the night traps."""
    used = [c for c in columns if c in weather.columns]
    agg = []
    for c in used:
        if c == "boundary_layer_height":
            agg += [_capped_log(F.max(c)).alias("day_mixing_max"), _capped_log(F.min(c)).alias("night_mixing_min")]
        elif c == "rain_mm":
            agg.append(F.coalesce(F.sum(c), F.lit(0.0)).alias("day_rain_mm"))
        else:
            agg.append(F.avg(c).alias(f"day_{c}"))
    return weather.groupBy(day_of_hour(F.col("hour")).alias("day")).agg(*agg)


def daily_rows(levels: DataFrame, weather: DataFrame | None = None, targets=TARGETS, days_ahead=(1, 2)) -> DataFrame:
    """One row per 18:00 issue and day ahead: the last day's and week's levels, target-day weather, and the actual mean.

    `levels` is read three times (means, spans, actuals), so pass a written table.
    """
    means = level_means(levels, targets)
    first = levels.groupBy("station_id").agg(F.min("hour").alias("_start"))
    issued = means.filter(hour_of_day(F.col("hour")) == K.ISSUE_HOUR).join(first, "station_id")
    issued = issued.withColumn("issue_day", day_of_hour(F.col("hour")))
    issued = issued.filter(F.col("issue_day") >= day_of_hour(F.col("_start") + 24 * 7))
    rows = issued.withColumn("days_ahead", F.explode(F.array(*[F.lit(d) for d in days_ahead])))
    rows = rows.withColumn("day", F.col("issue_day") + F.col("days_ahead"))
    actual = levels.groupBy("station_id", day_of_hour(F.col("hour")).alias("day")).agg(
        *[
            F.when(F.count(t) >= K.MIN_HOURS_24, F.log1p(F.avg(F.expm1(t)))).alias(f"actual_{t}") for t in targets
        ]
    )
    rows = rows.join(actual, ["station_id", "day"], "left")
    out = rows.select(
        "station_id", "issue_day", "days_ahead", "day",
        is_weekend(from_day(F.col("day"))).cast("double").alias("target_weekend"),
        *[F.col(f"day_{t}").alias(f"last24_{t}") for t in targets],
        *[(F.col(f"week_{t}") - F.col(f"day_{t}")).alias(f"week_mean_{t}") for t in targets],
        *[f"actual_{t}" for t in targets],
        *[(F.col(f"actual_{t}") - F.col(f"day_{t}")).alias(f"target_{t}") for t in targets],
    )
    if weather is None:
        return out
    out = out.join(day_weather(weather), "day", "left")
    return out.fillna(0.0, ["day_rain_mm"]) if "rain_mm" in weather.columns else out
