"""Weather as a lake feels it: remembered rain, slow air temperature, recent cloud."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import hour_no

from .chunks import HOUR_CHUNK
from .grid import on_calendar
from .recursions import clipped_scan, decaying_sum


def weather_memory(weather: DataFrame, rain_hours=K.RAIN_MEMORY_HOURS, air_hours=K.AIR_MEMORY_HOURS,
                   cloud_hours: int = K.CLOUD_MEMORY_HOURS) -> DataFrame:
    """Per hour `rain_<h>h` (log of the rain remembered over h hours), `air_<h>h` and `cloud_<h>h` (weighted means)."""
    has_air = {"air_temperature", "cloud_cover"} <= set(weather.columns)
    used = ["rain_mm", "air_temperature", "cloud_cover"] if has_air else ["rain_mm"]
    hours = weather.groupBy(hour_no(F.col("timestamp")).alias("hour")).agg(*[F.avg(c).alias(c) for c in used])
    grid = on_calendar(hours.withColumn("_all", F.lit(0)), "hour", keys=("_all",))
    scans, out = {}, {}
    for h in rain_hours:
        scans[f"_rain_{h}"] = decaying_sum(F.col("rain_mm"), math.exp(-1 / h))
        out[f"rain_{h}h"] = F.log1p(F.col(f"_rain_{h}"))
    if has_air:
        for column, h, name in [("air_temperature", h, f"air_{h}h") for h in air_hours] + [
            ("cloud_cover", cloud_hours, f"cloud_{cloud_hours}h")
        ]:
            fade = math.exp(-1 / h)
            scans[f"_n_{name}"] = decaying_sum(F.col(column), fade)
            scans[f"_d_{name}"] = decaying_sum(F.col(column).isNotNull().cast("double"), fade)
            out[name] = F.try_divide(F.col(f"_n_{name}"), F.col(f"_d_{name}"))
    levels = clipped_scan(grid, ["_all"], "hour", scans, HOUR_CHUNK)
    return levels.select("hour", *[c.alias(n) for n, c in out.items()])
