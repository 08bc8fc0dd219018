"""Where the hourly path and the nightly or daily forecast meet, and what a particulate forecast means for the index."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.airindex import aqi_category, sub_index
from tarnwatch.functions.clock import day_of_hour, hour_of_day
from tarnwatch.functions.odds import prob_below

QS = ("lo", "mid", "hi")


def path_minima(path: DataFrame) -> DataFrame:
    """Per station, origin hour and date, the least of each quantile over the night hours of an hourly path."""
    h = hour_of_day(F.col("target_hour"))
    night = path.filter((h >= K.NIGHT_FIRST) & (h < K.NIGHT_LAST))
    return night.groupBy("station_id", F.col("hour").alias("issue_hour"), day_of_hour(F.col("target_hour")).alias("night_of")).agg(
        *[F.min(q).alias(f"path_{q}") for q in QS]
    )


def prefer_path(nightly: DataFrame, path: DataFrame, horizon: int = K.MAX_HORIZON) -> DataFrame:
    """Nightly forecasts with the hourly path's minimum wherever the horizon covers the whole night.

    `nightly` has station_id, issue_day, night_of, lo, mid, hi; `path` has station_id, hour, target_hour, lo, mid, hi.
    """
    rows = nightly.withColumn("issue_hour", F.col("issue_day") * 24 + K.ISSUE_HOUR)
    out = rows.join(path_minima(path), ["station_id", "issue_hour", "night_of"], "left")
    covered = F.col("night_of") * 24 + (K.NIGHT_LAST - 1) <= F.col("issue_hour") + horizon
    known = covered & F.col("path_lo").isNotNull() & F.col("path_mid").isNotNull() & F.col("path_hi").isNotNull()
    out = out.withColumns({q: F.when(known, F.col(f"path_{q}")).otherwise(F.col(q)) for q in QS})
    return out.drop("issue_hour", *[f"path_{q}" for q in QS])


def path_day_means(path: DataFrame) -> DataFrame:
    """Per station, origin hour and days ahead, the mean level of each quantile of an hourly path (log scale)."""
    ahead = day_of_hour(F.col("target_hour")) - day_of_hour(F.col("hour"))
    return path.groupBy("station_id", F.col("hour").alias("issue_hour"), ahead.alias("days_ahead")).agg(
        *[F.log1p(F.avg(F.expm1(q))).alias(f"path_{q}") for q in QS]
    )


def prefer_path_means(daily: DataFrame, path: DataFrame, horizon: int = K.MAX_HORIZON) -> DataFrame:
    """Daily forecasts (log scale) with the hourly path's mean for the days the horizon covers whole."""
    rows = daily.withColumn("issue_hour", F.col("issue_day") * 24 + K.ISSUE_HOUR)
    means = path_day_means(path).withColumn("days_ahead", F.col("days_ahead").cast(daily.schema["days_ahead"].dataType))
    out = rows.join(means, ["station_id", "issue_hour", "days_ahead"], "left")
    covered = F.col("days_ahead") * 24 + 23 - K.ISSUE_HOUR <= horizon
    known = covered & F.col("path_lo").isNotNull() & F.col("path_mid").isNotNull() & F.col("path_hi").isNotNull()
    out = out.withColumns({q: F.when(known, F.col(f"path_{q}")).otherwise(F.col(q)) for q in QS})
    return out.drop("issue_hour", *[f"path_{q}" for q in QS])


def index_at(pollutant: str, index: float) -> float:
    """The concentration at which a pollutant alone reaches an index value."""
    edges, points = K.INDEX_EDGES, K.BREAKPOINTS[pollutant]
    for (y0, y1), (x0, x1) in zip(zip(edges, edges[1:]), zip(points, points[1:])):
        if index <= y1:
            return x0 + (index - y0) * (x1 - x0) / (y1 - y0)
    return float(points[-1])


def particulate_outlook(daily: DataFrame, targets=("pm25", "pm10"), poor: float = K.POOR_INDEX) -> DataFrame:
    """Adds pm_index, pm_category, p_poor_or_worse and actual_pm_index to daily ranges.

    Per target `t` the input has t, t_lo, t_hi and t_actual as concentrations. Either pollutant can make a day poor;
    the larger chance is the lower bound that is reported.
    """
    import math

    indices = [sub_index(t, t) for t in targets]
    actual = [sub_index(f"{t}_actual", t) for t in targets]
    chances = [
        F.lit(1.0)
        - prob_below(math.log1p(index_at(t, poor)), F.log1p(f"{t}_lo"), F.log1p(t), F.log1p(f"{t}_hi"))
        for t in targets
    ]
    known = F.lit(True)
    for c in chances:
        known = known & c.isNotNull()
    out = daily.withColumns(
        {
            "pm_index": F.bround(F.greatest(*indices), 0),
            "p_poor_or_worse": F.when(known, F.round(F.greatest(*chances), 3)),
            "actual_pm_index": F.greatest(*actual),
        }
    )
    return out.withColumn("pm_category", aqi_category("pm_index"))
