"""Lake metabolism from the daily oxygen curve (diel oxygen technique): reaeration, respiration, production.

Everything after the hour-to-hour steps is per station and date. Windows over dates see one row per station and day:
their size is bounded by the calendar, not by how many readings a station sends.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import day_of_hour, hour_of_day
from tarnwatch.functions.water import oxygen_deficit

from .chunks import framed

LIGHT_HOURS = K.DAY_END - K.DAY_START


def hourly_changes(hourly: DataFrame, pressure_atm: float = K.PRESSURE_ATM) -> DataFrame:
    """Each hour-to-hour step: oxygen change, mean saturation deficit and temperature; incomplete steps left out."""
    base = hourly.select("station_id", "hour", "temperature", "dissolved_oxygen").withColumn(
        "_deficit", oxygen_deficit(pressure_atm=pressure_atm)
    )

    def step(w):
        def following(c):
            return F.lead(c).over(w)

        return {
            "change": following("dissolved_oxygen") - F.col("dissolved_oxygen"),
            "deficit": (F.col("_deficit") + following("_deficit")) / 2,
            "mean_temperature": (F.col("temperature") + following("temperature")) / 2,
        }

    out = framed(base, ["station_id"], "hour", [step], after=1)
    out = out.select("station_id", "hour", "change", "deficit", F.col("mean_temperature").alias("temperature"))
    return out.dropna()


def night_sums(steps: DataFrame) -> DataFrame:
    """Per station and night (21:00-04:59 belongs to the date it ends on) the sums a regression needs."""
    h = hour_of_day(F.col("hour"))
    dark = steps.filter((h >= K.NIGHT_START) | (h < K.NIGHT_END))
    night = dark.groupBy("station_id", day_of_hour(F.col("hour") + (24 - K.NIGHT_START)).alias("day"))
    sums = night.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("deficit").alias("d"),
        F.sum("change").alias("c"),
        F.sum(F.col("deficit") * F.col("deficit")).alias("dd"),
        F.sum(F.col("deficit") * F.col("change")).alias("dc"),
        F.avg("temperature").alias("night_temperature"),
    )
    return sums.filter(F.col("n") >= K.MIN_NIGHT_STEPS)


def nightly_rates(sums: DataFrame) -> DataFrame:
    """Reaeration pooled over the last nights (each night with its own intercept) and each night's respiration.

    A pooled slope that is not positive falls back to the median of the earlier ones.
    """
    by_date = Window.partitionBy("station_id").orderBy("day")
    pool = by_date.rowsBetween(-(K.POOL_NIGHTS - 1), 0)
    out = sums.withColumns(
        {
            "_dd": F.col("dd") - F.col("d") * F.col("d") / F.col("n"),
            "_dc": F.col("dc") - F.col("d") * F.col("c") / F.col("n"),
        }
    )
    out = out.withColumns({"_dd": F.sum("_dd").over(pool), "_dc": F.sum("_dc").over(pool)})
    slope = F.when(F.col("_dd") > 1e-9, F.col("_dc") / F.col("_dd"))
    out = out.withColumn("_k", F.when(slope > 0, slope))
    earlier = F.percentile("_k", F.lit(0.5)).over(by_date.rowsBetween(Window.unboundedPreceding, -1))
    k = F.coalesce(F.col("_k"), earlier)
    out = out.withColumn("reaeration", F.when(k.isNotNull(), F.least(k, F.lit(K.MAX_REAERATION))))
    rate = (F.col("reaeration") * F.col("d") - F.col("c")) / F.col("n")
    return out.select("station_id", "day", "reaeration", rate.alias("respiration"), "night_temperature")


def daily_metabolism(hourly: DataFrame) -> DataFrame:
    """Per station and `day`: reaeration, respiration, night_temperature, gpp, do_amplitude and nep."""
    steps = hourly_changes(hourly)
    nights = nightly_rates(night_sums(steps))
    h = hour_of_day(F.col("hour"))
    light = steps.filter((h >= K.DAY_START) & (h < K.DAY_END)).withColumn("day", day_of_hour(F.col("hour")))
    # Production needs only that day's sums, so the day is summed before it meets the night's rates.
    sums = light.groupBy("station_id", "day").agg(
        F.count(F.lit(1)).alias("_n"), F.sum("change").alias("_c"), F.sum("deficit").alias("_d")
    )
    swing = hourly.groupBy("station_id", day_of_hour(F.col("hour")).alias("day")).agg(
        (F.max("dissolved_oxygen") - F.min("dissolved_oxygen")).alias("do_amplitude")
    )
    days = sums.join(swing, ["station_id", "day"], "left")
    table = nights.join(days, ["station_id", "day"], "outer")
    grown = F.col("_c") + F.col("_n") * F.col("respiration") - F.col("reaeration") * F.col("_d")
    enough = (F.col("_n") >= 0.7 * LIGHT_HOURS) & grown.isNotNull()
    table = table.withColumn("gpp", F.when(enough, F.greatest(grown, F.lit(0.0))))
    return table.withColumn("nep", F.col("gpp") - F.col("respiration") * 24).drop("_n", "_c", "_d")
