"""National Air Quality Index: regulatory averaging on a gap-free clock, sub-indices, index, category."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.airindex import aqi_advice, aqi_category, enough_pollutants, prominent, sub_indices

from .chunks import framed
from .grid import on_calendar


def index_pollutants(df: DataFrame) -> list[str]:
    return [p for p in K.BREAKPOINTS if p in df.columns]


def averaged(checked: DataFrame) -> DataFrame:
    """Per station and hour, each pollutant averaged the way its index is defined, ending at that hour."""
    ps = index_pollutants(checked)
    clock = on_calendar(checked.select("station_id", "hour", *ps), "hour")

    def means(w):
        out = {}
        for p in ps:
            span, least = (8, K.MIN_HOURS_8) if p in K.EIGHT_HOUR else (24, K.MIN_HOURS_24)
            frame = w.rowsBetween(-(span - 1), 0)
            out[f"_{p}"] = F.when(F.count(p).over(frame) >= least, F.avg(p).over(frame))
        return out

    def worst(w):
        day = w.rowsBetween(-23, 0)
        return {p: F.max(f"_{p}").over(day) if p in K.EIGHT_HOUR else F.col(f"_{p}") for p in ps}

    out = framed(clock, ["station_id"], "hour", [means, worst], before=7 + 23)
    return out.select("station_id", "hour", *ps)


def naqi(concentrations: DataFrame) -> DataFrame:
    """Adds rounded sub-indices `si_<p>`, `aqi`, `category` and `prominent_pollutant`.

    The sub-indices travel as one array, so the index, its category and the pollutant behind it each mention them
    once: a filter on any of these stays small when the optimizer moves it below the projection.
    """
    ps = index_pollutants(concentrations)
    out = concentrations.withColumns({"_subs": sub_indices(ps), "_enough": enough_pollutants(ps)})
    subs = F.col("_subs")
    out = out.withColumns(
        {
            **{f"si_{p}": F.bround(subs[i], 0) for i, p in enumerate(ps)},
            "aqi": F.when(F.col("_enough"), F.bround(F.array_max(subs), 0)),
            "prominent_pollutant": F.when(F.col("_enough"), prominent(subs, ps)).otherwise(""),
        }
    )
    return out.withColumn("category", aqi_category("aqi")).drop("_subs", "_enough")


def current_index(index: DataFrame) -> DataFrame:
    """Each station's latest hour that has an index, with its advice."""
    cols = [c for c in index.columns if c != "station_id"]
    rated = index.filter(F.col("aqi").isNotNull())
    latest = rated.groupBy("station_id").agg(F.max_by(F.struct(*cols), "hour").alias("r")).select("station_id", "r.*")
    return latest.withColumn("advice", aqi_advice("category"))
