"""Forecast rows: what is known at each origin, and the change to predict at each horizon (lake sensors).

On a gap-free clock everything an origin needs lies within a day behind and two days ahead of it, so bounded frames
per (station, chunk) gather it in one sort; horizons then explode from the row without another shuffle.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import day_of_hour, from_day, from_hour, hour_of_day
from tarnwatch.functions.noise import normal, uniform
from tarnwatch.functions.timing import cyclic
from tarnwatch.functions.water import oxygen_deficit
from tarnwatch.functions.working import all_present, clip, to_working

from .chunks import framed
from .grid import on_calendar
from .lineage import materialise

BEHIND, AHEAD = 23, K.MAX_HORIZON


def working_hours(hourly: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    return hourly.select("station_id", "hour", *[to_working(s, s).alias(s) for s in sensors])


def rolling_day(hours: DataFrame, sensors=K.LAKE_SENSORS, least: int = 12) -> DataFrame:
    """Adds day_mean/min/max per sensor over the last 24 hours, NULL with fewer than `least` values."""
    return framed(hours, ["station_id"], "hour", [lambda w: _day_stats(w, sensors, least)], before=BEHIND)


def _day_stats(w, sensors, least: int = 12) -> dict[str, Column]:
    day = w.rowsBetween(-BEHIND, 0)
    stats = {"mean": F.avg, "min": F.min, "max": F.max}
    return {
        f"day_{name}_{s}": F.when(F.count(s).over(day) >= least, f(s).over(day)) for name, f in stats.items() for s in sensors
    }


def origin_hours(hours: DataFrame, every: int, history: int = 24, room: int = K.MAX_HORIZON, since: int | None = None) -> DataFrame:
    """Origins every `every` hours from `history` hours into each station's clock, with `room` hours observed after.

    With `since` (an hour number) the count starts there instead, never before the history.
    """
    bounds = hours.groupBy("station_id").agg(F.min("hour").alias("_start"), F.max("hour").alias("_end"))
    first = F.col("_start") + history if since is None else F.greatest(F.col("_start") + history, F.lit(since))
    bounds = bounds.withColumn("_first", first).withColumn("_last", F.col("_end") - room)
    bounds = bounds.filter("_first <= _last")
    return bounds.select("station_id", F.explode(F.sequence("_first", "_last", F.lit(every).cast("bigint"))).alias("hour"))


def around(hours: DataFrame, sensors=K.LAKE_SENSORS, lags=K.LAGS_HOURS) -> DataFrame:
    """Each hour with its lags, day statistics and the sensor rows of the day behind (`_past`) and ahead (`_next`)."""
    row = F.struct(*sensors)

    def gather(w):
        out = {f"_lag{k}_{s}": F.lag(s, k).over(w) for k in lags for s in sensors}
        out.update(_day_stats(w, sensors))
        out["_past"] = F.collect_list(row).over(w.rowsBetween(-BEHIND, 0))
        out["_next"] = F.collect_list(row).over(w.rowsBetween(1, AHEAD))
        return out

    return framed(hours, ["station_id"], "hour", [gather], before=24, after=AHEAD)


def same_hour_offset(horizon) -> Column:
    """Hours back from the origin to the target's hour of day on the last known day (0..23)."""
    return (F.ceil(F.col(horizon) / 24) * 24 - F.col(horizon)).cast("int")


def weather_windows(weather: DataFrame) -> DataFrame:
    """Per hour: rain of the last 24 hours, cloud of the last 12, and the air temperatures of the next 48."""
    grid = on_calendar(weather.withColumn("_all", F.lit(0)), "hour", beyond=AHEAD, keys=("_all",))

    def windows(w):
        return {
            "rain_24h": F.sum("rain_mm").over(w.rowsBetween(-23, 0)),
            "cloud_12h": F.avg("cloud_cover").over(w.rowsBetween(-11, 0)),
            "_air_next": F.collect_list(F.struct("air_temperature")).over(w.rowsBetween(1, AHEAD)),
        }

    out = framed(grid, ["_all"], "hour", [windows], before=23, after=AHEAD)
    return out.select("hour", "rain_24h", "cloud_12h", F.col("air_temperature").alias("air"), "_air_next")


def _mean_of_first(values: Column, n: Column) -> Column:
    """Mean of the known ones among the first `n` of an array of structs."""
    known = F.filter(F.transform(F.slice(values, F.lit(1), n), lambda s: s["air_temperature"]), lambda x: x.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(known) > 0, total / F.size(known))


def hourly_rows(
    hours: DataFrame, origins: DataFrame, horizons, weather: DataFrame | None = None, sensors=K.LAKE_SENSORS
) -> DataFrame:
    """One row per origin and horizon: features, `actual_<s>` and `target_<s>` (change from the origin), working scale.

    `hours` is the gap-free working-scale clock (best a written table: origins are derived from it too), `origins`
    has station_id and hour.
    """
    rows = around(hours, sensors).join(origins, ["station_id", "hour"])
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(int(h)) for h in horizons])))
    rows = rows.withColumns(
        {
            "_at": F.col("hour") + F.col("horizon"),
            "_same": F.get("_past", F.size("_past") - 1 - same_hour_offset("horizon")),
            "_goal": F.get("_next", F.col("horizon") - 1),
        }
    )
    feats: dict[str, Column] = {}
    for name, clock in (("issue", "hour"), ("target", "_at")):
        feats[f"{name}_hour_sin"], feats[f"{name}_hour_cos"] = cyclic(hour_of_day(F.col(clock)))
    feats["do_deficit"] = oxygen_deficit()
    for s in sensors:
        now = F.col(s)
        feats[f"now_{s}"] = now
        for k in K.LAGS_HOURS:
            feats[f"lag{k}_{s}"] = F.col(f"_lag{k}_{s}") - now
        for stat in ("mean", "min", "max"):
            feats[f"day_{stat}_{s}"] = F.col(f"day_{stat}_{s}") - now
        feats[f"same_hour_last_day_{s}"] = F.col(f"_same.{s}") - now
        feats[f"actual_{s}"] = F.col(f"_goal.{s}")
        feats[f"target_{s}"] = F.col(f"_goal.{s}") - now
    out = rows.select(
        "station_id", "hour", "horizon", "_at", *[c.alias(n) for n, c in feats.items()]
    )
    if weather is None:
        return out.withColumnRenamed("_at", "target_hour")
    # One row per hour of weather, looked up at the origin and at the target.
    w = materialise(weather_windows(weather), "weather_windows")
    here = w.select("hour", F.col("rain_24h").alias("rain_past_24h"), F.col("cloud_12h").alias("cloud_past_12h"), "_air_next")
    there = w.select(
        F.col("hour").alias("_at"), F.col("cloud_12h").alias("cloud_before_target_12h"),
        F.col("rain_24h").alias("rain_before_target_24h"), F.col("air").alias("air_at_target"),
    )
    out = out.join(here, "hour", "left").join(there, "_at", "left")
    out = out.withColumn("air_mean_ahead", _mean_of_first(F.col("_air_next"), F.col("horizon")))
    return out.drop("_air_next").withColumnRenamed("_at", "target_hour")


def noisy_weather(rows: DataFrame, seed: int = 42) -> DataFrame:
    """Recorded weather ahead of the origin degraded into what a forecast would have said; error grows with lead.

    The numbers come from hashes of the seed, the column and (station, hour, horizon), so a row gets the same error in any
    order, partitioning or retry.
    """
    lead, keys = F.col("horizon").cast("double"), ["station_id", "hour", "horizon"]
    missed = uniform(seed, "missed", keys) < 0.05 + 0.004 * lead
    rain = F.col("rain_before_target_24h")
    changes = {
        "cloud_before_target_12h": clip(F.col("cloud_before_target_12h") + normal(seed, "cloud", keys) * (0.05 + 0.005 * lead), 0.0, 1.0),
        "rain_before_target_24h": F.when(missed & rain.isNotNull(), 0.0).otherwise(rain * F.exp(normal(seed, "rain", keys) * (0.3 + 0.01 * lead))),
        "air_at_target": F.col("air_at_target") + normal(seed, "air", keys) * (0.3 + 0.03 * lead),
        "air_mean_ahead": F.col("air_mean_ahead") + normal(seed, "air_mean", keys) * (0.3 + 0.03 * lead),
    }
    return rows.withColumns(changes)


def date_table(hours: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Per station and day: pre-dawn oxygen minimum, sensor means before the evening issue hour, and at that hour.

    One pass over the clock; adds the weekly mean of night minima and earlier nights over one row per day.
    """
    h = hour_of_day(F.col("hour"))
    night = (h >= K.NIGHT_FIRST) & (h < K.NIGHT_LAST)
    oxygen = F.when(night, F.col("dissolved_oxygen"))
    at_issue = h == K.ISSUE_HOUR
    days = hours.groupBy("station_id", day_of_hour(F.col("hour")).alias("day")).agg(
        F.when(F.count(oxygen) >= K.NIGHT_MIN_HOURS, F.min(oxygen)).alias("night_min"),
        *[F.avg(F.when(h < K.ISSUE_HOUR, F.col(s))).alias(f"day_mean_{s}") for s in sensors],
        *[F.max(F.when(at_issue, F.col(s))).alias(f"issue_{s}") for s in sensors],
        F.max(at_issue.cast("int")).alias("_issued"),
    )
    # One row per station and day: calendar-bounded, and gap-free because the hourly clock is.
    by_day = Window.partitionBy("station_id").orderBy("day")
    week = by_day.rowsBetween(-6, 0)
    return days.withColumns(
        {
            "week_mean": F.when(F.count("night_min").over(week) >= 4, F.avg("night_min").over(week)),
            "prev1": F.lag("night_min", 1).over(by_day),
            "prev2": F.lag("night_min", 2).over(by_day),
            "temperature_3d_ago": F.lag("day_mean_temperature", 3).over(by_day),
            "_first_day": F.min("day").over(Window.partitionBy("station_id")),
        }
    )


def daily_weather(weather: DataFrame) -> DataFrame:
    """Per day: daytime cloud, rain, three-day rain, air temperature."""
    h = hour_of_day(F.col("hour"))
    days = weather.groupBy(day_of_hour(F.col("hour")).alias("day")).agg(
        F.avg(F.when((h >= 6) & (h < 18), F.col("cloud_cover"))).alias("cloud_day"),
        F.sum("rain_mm").alias("rain_day"),
        F.avg("air_temperature").alias("air_day"),
    )
    # One row per day of the calendar.
    last3 = Window.partitionBy(F.lit(0)).orderBy("day").rangeBetween(-2, 0)
    return days.withColumn("rain_3day", F.sum("rain_day").over(last3))


def nightly_rows(hours: DataFrame, weather: DataFrame | None = None, sensors=K.LAKE_SENSORS) -> DataFrame:
    """One row per evening issue and night ahead (1..7), from a week into each station's history on."""
    days = date_table(hours, sensors)
    issued = days.filter((F.col("_issued") == 1) & (F.col("day") >= F.col("_first_day") + 7))
    rows = issued.withColumn("days_ahead", F.explode(F.sequence(F.lit(1), F.lit(K.NIGHTS_AHEAD))))
    rows = rows.withColumn("night_of", F.col("day") + F.col("days_ahead"))
    target = days.select("station_id", F.col("day").alias("night_of"), F.col("night_min").alias("actual"))
    rows = rows.join(target, ["station_id", "night_of"], "left")
    last = F.col("night_min")
    out = rows.select(
        "station_id", F.col("day").alias("issue_day"), "days_ahead", "night_of",
        last.alias("last_night_min"),
        (F.col("prev1") - last).alias("prev1_night_min"),
        (F.col("prev2") - last).alias("prev2_night_min"),
        (F.col("week_mean") - last).alias("week_mean_night_min"),
        oxygen_deficit("issue_temperature", "issue_dissolved_oxygen").alias("do_deficit"),
        *[F.col(f"issue_{s}").alias(f"now_{s}") for s in sensors],
        *[f"day_mean_{s}" for s in sensors],
        (F.col("day_mean_temperature") - F.col("temperature_3d_ago")).alias("temperature_trend_3d"),
        "actual",
        (F.col("actual") - last).alias("night_min_change"),
    )
    if weather is None:
        return out
    w = daily_weather(weather)
    today = w.select(F.col("day").alias("issue_day"), F.col("cloud_day").alias("cloud_day_today"))
    before = w.select(
        (F.col("day") + 1).alias("night_of"),
        *[F.col(c).alias(f"{c}_before_night") for c in ("cloud_day", "rain_day", "rain_3day", "air_day")],
    )
    return out.join(today, "issue_day", "left").join(before, "night_of", "left")


def latest_complete_hour(hours: DataFrame, sensors=K.LAKE_SENSORS, max_age: int = 24) -> DataFrame:
    """Each station's latest hour with every sensor; stations where it is more than a day old are left out."""
    latest = hours.groupBy("station_id").agg(
        F.max(F.when(all_present(sensors), F.col("hour"))).alias("hour"), F.max("hour").alias("_end")
    )
    return latest.filter(F.col("_end") - F.col("hour") <= max_age).drop("_end")


def issue_day(hour) -> Column:
    """The latest day whose 18:00 issue is not after this hour."""
    h = F.col(hour) if isinstance(hour, str) else hour
    return day_of_hour(h) - F.when(hour_of_day(h) >= K.ISSUE_HOUR, 0).otherwise(1)


def coming_nights(latest: DataFrame) -> DataFrame:
    """For each station's latest complete hour, the issue day and the nights ahead that are not already over."""
    rows = latest.withColumn("issue_day", issue_day("hour"))
    rows = rows.withColumn("days_ahead", F.explode(F.sequence(F.lit(1), F.lit(K.NIGHTS_AHEAD))))
    rows = rows.withColumn("night_of", F.col("issue_day") + F.col("days_ahead"))
    return rows.filter(F.col("night_of") * 24 + K.NIGHT_LAST > F.col("hour"))


def stamped(df: DataFrame, **clocks: str) -> DataFrame:
    """Replaces integer clocks by timestamps: `stamped(df, origin="hour", night="night_of:day")`."""
    out = df
    for name, spec in clocks.items():
        column, _, unit = spec.partition(":")
        stamp = from_day(F.col(column)) if unit == "day" else from_hour(F.col(column))
        out = out.withColumn(f"_{name}", stamp)
    return out.drop(*[s.partition(":")[0] for s in clocks.values()]).withColumnsRenamed({f"_{n}": n for n in clocks})
