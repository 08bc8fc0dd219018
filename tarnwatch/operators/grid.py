"""Regular clocks: first-wins dedupe, gap-free 10-minute and hourly grids, hourly means, short-gap interpolation."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import day_no, from_hour, from_slot, hour_no, nearest_slot

from .chunks import HOUR_CHUNK, carry_last, carry_next
from .lineage import materialise

SPAN = 4_096  # clock steps that one row of a calendar is expanded to
STRAY_GAP_DAYS = 366


def first_per_slot(readings: DataFrame, order: str = "src_ord", sensors=K.LAKE_SENSORS) -> DataFrame:
    """One row per station and 10-minute slot: the reading that arrived first, missing values and all.

    A hash aggregate with map-side combining, so a logger that repeats itself never makes a hot sort. Rows without
    a time are dropped.
    """
    snapped = readings.withColumn("slot", nearest_slot(F.col("timestamp"))).filter(F.col("slot").isNotNull())
    return snapped.groupBy("station_id", "slot").agg(*[F.min_by(s, order).alias(s) for s in sensors])


def calendar(df: DataFrame, clock: str, beyond: int = 0, keys=("station_id",)) -> DataFrame:
    """Every clock step of each key from its first to its last (plus `beyond` steps).

    A span is cut into rows of at most `SPAN` steps, dealt over the tasks, and the steps are made from those: no row
    ever holds more than one stretch's steps, however long a key's history is.
    """
    bounds = df.groupBy(*keys).agg(F.min(clock).alias("_lo"), (F.max(clock) + beyond).alias("_hi"))
    cut = bounds.withColumn("_part", F.explode(F.sequence(F.floor(F.col("_lo") / SPAN), F.floor(F.col("_hi") / SPAN))))
    begin, end = F.greatest("_lo", F.col("_part") * SPAN), F.least("_hi", F.col("_part") * SPAN + SPAN - 1)
    cut = cut.select(*keys, begin.cast("bigint").alias("_begin"), end.cast("bigint").alias("_end")).repartition(*keys, "_begin")
    return cut.select(*keys, F.explode(F.sequence("_begin", "_end")).alias(clock))


def on_calendar(df: DataFrame, clock: str, beyond: int = 0, keys=("station_id",), span_of: DataFrame | None = None) -> DataFrame:
    """The table with its gaps as rows of NULLs.

    `span_of` names a cheaper table with the same keys and clock to take each key's span from, so that `df` itself
    is computed once.
    """
    return calendar(df if span_of is None else span_of, clock, beyond, keys).join(df, [*keys, clock], "left")


def stray_days(readings: DataFrame, gap: int = STRAY_GAP_DAYS) -> DataFrame:
    """(station_id, day, readings) of days whose readings lie outside of their station's own span of time.

    A logger that lost its clock writes days years away, which would spread a calendar over all the years between. Days that
    are at most `gap` days apart belong together; the stretch with the most readings (of equal ones the latest) is the
    station's own, and all others are strays. One row per station and day is windowed, whatever the number of readings.
    """
    timed = readings.filter(F.col("timestamp").isNotNull() & F.col("station_id").isNotNull())
    days = timed.groupBy("station_id", day_no(F.col("timestamp")).alias("day")).agg(F.count(F.lit(1)).alias("readings"))
    by_day = Window.partitionBy("station_id").orderBy("day")
    opens = F.coalesce((F.col("day") - F.lag("day").over(by_day) > gap).cast("int"), F.lit(0))
    days = days.withColumn("_opens", opens)
    days = materialise(days.withColumn("_stretch", F.sum("_opens").over(by_day.rowsBetween(Window.unboundedPreceding, 0))), "days")
    size = days.groupBy("station_id", "_stretch").agg(F.sum("readings").alias("_n"))
    own = size.groupBy("station_id").agg(F.max_by("_stretch", F.struct("_n", "_stretch")).alias("_own"))
    return days.join(own, "station_id").filter("_stretch <> _own").select("station_id", "day", "readings")


def without_strays(readings: DataFrame, strays: DataFrame) -> DataFrame:
    """The readings that are not on a stray day (see `stray_days`); readings without a time or station stay."""
    away = strays.select(F.col("station_id").alias("_s"), F.col("day").alias("_d"))
    return readings.join(away, (F.col("station_id") == F.col("_s")) & (day_no(F.col("timestamp")) == F.col("_d")), "left_anti")


def slot_grid(readings: DataFrame, order: str = "src_ord") -> DataFrame:
    """station_id, slot and the four sensors on a gap-free 10-minute grid.

    The deduplicated rows are written once: station spans come from them, and whoever reads the grid again does not
    read the readings again.
    """
    return on_calendar(materialise(first_per_slot(readings, order), "slots"), "slot")


def hourly_values(slots: DataFrame, min_valid: int = K.MIN_PER_HOUR, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Hourly means per station from slotted readings; a sensor with fewer than `min_valid` readings stays NULL."""
    hourly = slots.groupBy("station_id", F.floor(F.col("slot") / 6).alias("hour"))
    return hourly.agg(*[F.when(F.count(s) >= min_valid, F.avg(s)).alias(s) for s in sensors])


def hourly_grid(readings: DataFrame, min_valid: int = K.MIN_PER_HOUR, beyond: int = 0, order: str = "src_ord") -> DataFrame:
    """station_id, hour and sensor means on a gap-free hourly grid."""
    slots = materialise(first_per_slot(readings, order), "slots")
    hours = slots.select("station_id", F.floor(F.col("slot") / 6).alias("hour"))
    return on_calendar(hourly_values(slots, min_valid), "hour", beyond, span_of=hours)


def with_timestamp(df: DataFrame) -> DataFrame:
    """Replaces the integer clock (`slot` or `hour`) by the timestamp it stands for."""
    if "slot" in df.columns:
        return df.withColumn("timestamp", from_slot(F.col("slot"))).drop("slot")
    return df.withColumn("timestamp", from_hour(F.col("hour"))).drop("hour")


def mask_faulty(readings: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Values an earlier detector run blamed on a faulty sensor (`<sensor>_fault` not empty) become NULL."""
    known = [s for s in sensors if f"{s}_fault" in readings.columns]
    return readings.withColumns({s: F.when(F.coalesce(F.col(f"{s}_fault"), F.lit("")) == "", F.col(s)) for s in known})


def faulty_count(readings: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    known = [s for s in sensors if f"{s}_fault" in readings.columns]
    return readings.agg(*[F.count_if(F.coalesce(F.col(f"{s}_fault"), F.lit("")) != "").alias(f"{s}_masked") for s in known])


def latest_wins(df: DataFrame, keys, arrival) -> DataFrame:
    """Upsert: of rows with equal `keys`, the one that arrived last. `arrival` lists the order columns."""
    payload = [c for c in df.columns if c not in keys]
    newest = df.groupBy(*keys).agg(F.max_by(F.struct(*payload), F.struct(*arrival)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def earliest_wins(df: DataFrame, keys, arrival) -> DataFrame:
    payload = [c for c in df.columns if c not in keys]
    oldest = df.groupBy(*keys).agg(F.min_by(F.struct(*payload), F.struct(*arrival)).alias("_row"))
    return oldest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def weather_grid(weather: DataFrame, columns, fill_hours: int = 3, arrival: Column | None = None) -> DataFrame:
    """Hourly weather on a gap-free clock; the first `fill_hours` hours of an interior gap are interpolated.

    Returns `hour` and `columns`. Hours may repeat in the input; the first row of an hour counts.
    """
    hours = weather.withColumn("hour", hour_no(F.col("timestamp"))).filter(F.col("hour").isNotNull())
    hours = hours.withColumn("_ord", arrival if arrival is not None else F.col("timestamp"))
    # One row per hour, read for the span and for the values: written once, as is the calendar, which two carries read.
    hours = materialise(hours.groupBy("hour").agg(*[F.min_by(c, "_ord").alias(c) for c in columns]), "hours")
    grid = materialise(on_calendar(hours.withColumn("_all", F.lit(0)), "hour", keys=("_all",)), "weather_hours")
    points = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("hour").alias("h"), F.col(c).alias("v"))) for c in columns}
    grid = carry_last(grid, ["_all"], "hour", {f"_p_{c}": p for c, p in points.items()}, HOUR_CHUNK)
    grid = carry_next(grid, ["_all"], "hour", {f"_n_{c}": p for c, p in points.items()}, HOUR_CHUNK)

    def filled(c):
        p, n = F.col(f"_p_{c}"), F.col(f"_n_{c}")
        done = F.col("hour") - p["h"]
        line = p["v"] + (n["v"] - p["v"]) * (done / F.nullif(n["h"] - p["h"], F.lit(0)))
        return F.coalesce(F.col(c), F.when((done <= fill_hours) & n["h"].isNotNull(), line)).alias(c)

    return grid.select("hour", *[filled(c) for c in columns])


