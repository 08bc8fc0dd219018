"""What the sensors and the weather said before each sample time: inputs of the BOD, algae and coliform sensors.

Trailing windows are computed once per hour on the gap-free clock and looked up at the hour before the sample, so a
sample costs one equi-join row however many samples share an hour.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import day_no, from_hour, hour_no
from tarnwatch.functions.water import oxygen_deficit
from tarnwatch.functions.working import all_present, at_least, to_working

from .chunks import framed
from .grid import calendar, on_calendar
from .joins import as_of
from .lineage import materialise
from .metabolism import daily_metabolism

NIGHT_FEATURES = ["respiration", "reaeration", "night_temperature"]
DAY_FEATURES = ["gpp", "nep", "do_amplitude"]
NEED_HOURS = 17  # 70% of the 24 hours before the sample, rounded up
DAY_WIDTH = 366


def window_features(hourly: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Per station and hour, the summary of the 24 hours that end with it; continues a day past the last reading."""
    work = hourly.withColumns({s: to_working(s, s) for s in sensors}).withColumn("_deficit", oxygen_deficit())
    grid = on_calendar(work, "hour", beyond=K.WINDOW_HOURS)

    def summary(w):
        day = w.rowsBetween(-(K.WINDOW_HOURS - 1), 0)
        out = {"complete_hours": F.count(F.when(all_present(sensors), 1)).over(day)}
        for s in sensors:
            out[f"now_{s}"] = F.last(s, ignorenulls=True).over(day)
            out[f"mean_{s}"] = F.avg(s).over(day)
            out[f"min_{s}"] = F.min(s).over(day)
            out[f"max_{s}"] = F.max(s).over(day)
        out["mean_do_deficit"] = F.avg("_deficit").over(day)
        return out

    out = framed(grid, ["station_id"], "hour", [summary], before=K.WINDOW_HOURS - 1)
    return out.drop(*sensors, "_deficit")


def recent_metabolism(table: DataFrame, columns) -> DataFrame:
    """Per station and day with all `columns`: their mean over the last three such days (one row per day)."""
    last = Window.partitionBy("station_id").orderBy("day").rowsBetween(-(K.METABOLISM_DAYS - 1), 0)
    known = table.filter(all_present(columns))
    return known.select("station_id", "day", *[F.avg(c).over(last).alias(c) for c in columns])


def rain_features(weather: DataFrame) -> DataFrame:
    """Per hour, weather sums over the hours that end with it: rain of 1, 3 and 7 days, cloud, hours since a wet hour.

    `weather` is an hourly grid (`hour` and values); rows continue two weeks past its end.
    """
    grid = on_calendar(weather.withColumn("_all", F.lit(0)), "hour", beyond=K.DRY_SPELL_CAP_HOURS, keys=("_all",))

    def sums(w):
        def back(n):
            return w.rowsBetween(-(n - 1), 0)

        wet = F.last(F.when(F.col("rain_mm") >= K.WET_HOUR_MM, F.col("hour")), ignorenulls=True)
        since = F.col("hour") + 1 - wet.over(back(K.DRY_SPELL_CAP_HOURS))
        return {
            "rain_24h": F.sum("rain_mm").over(back(24)),
            "rain_72h": F.sum("rain_mm").over(back(72)),
            "rain_7d": F.sum("rain_mm").over(back(168)),
            "cloud_24h": F.avg("cloud_cover").over(back(24)),
            "hours_since_rain": F.coalesce(since, F.lit(K.DRY_SPELL_CAP_HOURS)).cast("double"),
        }

    out = framed(grid, ["_all"], "hour", [sums], before=K.DRY_SPELL_CAP_HOURS - 1)
    return out.select("hour", "rain_24h", "rain_72h", "rain_7d", "cloud_24h", "hours_since_rain")


def sample_features(samples: DataFrame, hourly: DataFrame, weather: DataFrame | None = None) -> DataFrame:
    """Samples (`station_id`, `timestamp`, anything else) with their features; too sparse a window drops the sample."""
    asked = samples.withColumn("hour", hour_no(F.col("timestamp")) - 1)
    out = asked.join(window_features(hourly), ["station_id", "hour"]).filter(F.col("complete_hours") >= NEED_HOURS)
    # Both as-of lookups read their two sides twice; these are sample-sized and one row per station and day.
    out = materialise(out, "samples")
    table = materialise(daily_metabolism(hourly), "metabolism")
    # A night counts once it has ended, a day once it is over.
    out = out.withColumns(
        {
            "_night": day_no(F.col("timestamp")) - F.when(F.hour("timestamp") >= K.NIGHT_END, 0).otherwise(1),
            "_day": day_no(F.col("timestamp")) - 1,
        }
    )
    for clock, columns in (("_night", NIGHT_FEATURES), ("_day", DAY_FEATURES)):
        facts = recent_metabolism(table, columns).withColumnRenamed("day", clock)
        found = as_of(out, facts, ["station_id"], clock, {"_m": F.struct(*columns)}, DAY_WIDTH)
        out = found.select("*", *[F.col(f"_m.{c}").alias(c) for c in columns]).drop("_m", clock)
    out = out.withColumn("log_respiration", F.ln(at_least("respiration", 1e-3)))
    if weather is not None:
        out = out.join(rain_features(weather), "hour", "left")
    return out.drop("hour", "complete_hours")


def algae_extras(features: DataFrame) -> DataFrame:
    """Production and the daily pH swing grow with algal biomass."""
    return features.withColumns(
        {"log_gpp": F.ln(at_least("gpp", 1e-3)), "swing_ph": F.col("max_ph") - F.col("min_ph")}
    )


def coliform_extras(features: DataFrame) -> DataFrame:
    """Rain timing on the log scale, for samples with weather; a sample outside the weather counts as a dry spell."""
    out = features.withColumn("hours_since_rain", F.coalesce("hours_since_rain", F.lit(float(K.DRY_SPELL_CAP_HOURS))))
    logs = {f"log_{c}": F.log1p(c) for c in ("rain_24h", "rain_72h", "rain_7d", "hours_since_rain")}
    return out.withColumns(logs)


def estimate_times(hourly: DataFrame) -> DataFrame:
    """One time a day per station at the usual sampling hour, once four days of history exist."""
    bounds = hourly.groupBy("station_id").agg(
        (F.min("hour") + (K.METABOLISM_DAYS + 1) * 24).alias("_first"), F.max("hour").alias("_last")
    )
    first_day = F.ceil((F.col("_first") - K.ESTIMATE_HOUR) / 24)
    last_day = F.floor((F.col("_last") - K.ESTIMATE_HOUR) / 24)
    days = bounds.filter(first_day <= last_day).select("station_id", F.explode(F.sequence(first_day, last_day)).alias("d"))
    return days.select("station_id", from_hour(F.col("d") * 24 + K.ESTIMATE_HOUR).alias("timestamp"))


def covered_samples(samples: DataFrame, hourly: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Samples with at least 70% complete sensor hours in the day before them."""
    flags = hourly.select("station_id", "hour", F.when(all_present(sensors), 1).alias("_ok"))
    grid = calendar(flags, "hour", beyond=K.WINDOW_HOURS).join(flags, ["station_id", "hour"], "left")

    def complete(w):
        return {"_n": F.count("_ok").over(w.rowsBetween(-(K.WINDOW_HOURS - 1), 0))}

    counted = framed(grid, ["station_id"], "hour", [complete], before=K.WINDOW_HOURS - 1).drop("_ok")
    asked = samples.withColumn("hour", hour_no(F.col("timestamp")) - 1)
    return asked.join(counted, ["station_id", "hour"]).filter(F.col("_n") >= NEED_HOURS).drop("_n", "hour")
