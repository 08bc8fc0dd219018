"""Monitoring tables derived from the star-schema test data's `events`, so every operator can run on them.

`value` has two decimals, so every measure is integer arithmetic on hundredths followed by one division: any SQL
engine reproduces the tables bit for bit. All of these are narrow projections of one scan except `weather`, which
is one partial aggregate per hour.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch.functions.clock import day_no, from_hour, hour_no


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.withColumn("v", F.round(F.col("value") * 100).cast("bigint"))


def _mod(expr, n):
    return F.expr(f"({expr}) % {n}")


def readings(spark, sf_dir) -> DataFrame:
    """Lake readings with unrelated random values; `src_ord` is the order in which rows arrived."""
    e = _events(spark, sf_dir).filter("event_type <> 'signup'")
    return e.select(
        F.concat(F.lit("st"), _mod("user_id", 4)).alias("station_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("src_ord"),
        (15 + _mod("v", 2000) / 100).alias("temperature"),
        (6 + _mod("7 * v", 350) / 100).alias("ph"),
        (_mod("v", 6000) / 100).alias("turbidity"),
        F.when(F.col("event_type") != "error", _mod("13 * v", 1400) / 100).alias("dissolved_oxygen"),
    )


def dense(spark, sf_dir) -> DataFrame:
    """Lake readings with a daily cycle, stuck, spiking, out-of-range and drifting sensors and multi-sensor events.

    One station holds 7/8 of the rows, so the skewed case is the normal case here.
    """
    e = (
        _events(spark, sf_dir)
        .withColumn("d", day_no(F.col("ts")))
        .withColumn("h", F.hour("ts"))
        .withColumn("tri", F.abs(12 - F.col("h")))
        .withColumn("pollution", F.when(F.expr("d % 9 = 4 and h between 8 and 13"), 1).otherwise(0))
        # Hours since 06:00: oxygen rises for ten of them, then falls ever more slowly through the night.
        .withColumn("s", F.expr("(h + 18) % 24"))
        .withColumn("daylight", F.expr("case when s <= 10 then 35 * s else (24 - s) * (24 - s) * 350 div 196 end"))
    )
    return e.select(
        F.when(_mod("user_id", 8) < 7, "st0").otherwise("st1").alias("station_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("src_ord"),
        (
            F.expr(
                "case when d % 4 = 1 and h between 6 and 15 then 2150 when event_id % 97 = 0 then 3900 + v % 40 "
                "else 2400 - 30 * tri + v % 40 end"
            )
            / 100
        ).alias("temperature"),
        (F.expr("case when event_id % 211 = 0 then 1500 else 780 - 6 * tri + (7 * v) % 20 + 60 * pollution end") / 100).alias(
            "ph"
        ),
        (F.expr("500 + v % 60 + 3000 * pollution") / 100).alias("turbidity"),
        F.when(
            F.expr("event_type <> 'error'"),
            F.expr("550 + daylight + (13 * v) % 30 - 450 * pollution - 40 * greatest(d % 10 - 5, 0)") / 100,
        ).alias("dissolved_oxygen"),
    )


def weather(spark, sf_dir) -> DataFrame:
    """One row per hour that has events."""
    e = _events(spark, sf_dir)
    total = {k: F.expr(f"sum({k} * v)") for k in (1, 3, 5, 7, 11)}
    s = e.groupBy(hour_no(F.col("ts")).alias("hour")).agg(*[c.alias(f"s{k}") for k, c in total.items()])
    return s.select(
        from_hour(F.col("hour")).alias("timestamp"),
        (15 + _mod("s3", 2000) / 100).alias("air_temperature"),
        (_mod("s1", 101) / 100).alias("cloud_cover"),
        (F.expr("greatest(s1 % 1000 - 700, 0)") / 100).alias("rain_mm"),
        (1 + _mod("s7", 900) / 100).alias("wind_speed"),
        (20 + _mod("s11", 80)).cast("double").alias("relative_humidity"),
        (100 + _mod("s5", 2400)).cast("double").alias("boundary_layer_height"),
    )


def weather_gappy(spark, sf_dir) -> DataFrame:
    """Weather with two-hour and six-hour holes."""
    w = weather(spark, sf_dir).withColumn("hour", hour_no(F.col("timestamp")))
    return w.filter("not (hour % 37 in (5, 6)) and not (hour % 53 between 10 and 15)").drop("hour")


def lab(spark, sf_dir) -> DataFrame:
    """Irregular lab samples; measures arrive as text with detection limits and junk."""
    e = _events(spark, sf_dir).filter("event_type = 'signup'")
    return e.select(
        F.concat(F.lit("st"), _mod("user_id", 4)).alias("station_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("src_ord"),
        F.expr("case when v % 10 = 0 then '<1' when v % 17 = 0 then 'n/a' else cast(1 + v % 9 as string) end").alias("bod"),
        (250 + _mod("v", 900)).cast("double").alias("conductivity"),
        (_mod("3 * v", 4000) / 100).alias("nitrate"),
        F.expr("case when v % 11 = 0 then '<0.5' else cast(1 + v % 60 as string) end").alias("chlorophyll_a"),
        F.expr("case when v % 13 = 0 then '<2' else cast(10 + (v * v) % 9000 as string) end").alias("total_coliform"),
    )


def air(spark, sf_dir) -> DataFrame:
    """Air readings: gases in ppm with a saturating NO2, a negative SO2, a stuck O3, lone PM2.5 peaks and an outage."""
    e = (
        _events(spark, sf_dir)
        .withColumn("d", day_no(F.col("ts")))
        .withColumn("h", F.hour("ts"))
        .filter("not (d % 11 = 5 and h between 2 and 8)")
    )
    return e.select(
        F.concat(F.lit("air"), _mod("user_id", 2)).alias("station_id"),
        F.col("ts").alias("timestamp"),
        F.col("event_id").alias("src_ord"),
        (_mod("v", 600) / 10).alias("pm1"),
        (F.expr("case when d % 5 = 3 and h = 12 then 9000 + v % 100 when d % 10 < 4 then 900 + v % 1500 else v % 1500 end") / 10).alias("pm25"),
        (_mod("v", 3000) / 10).alias("pm10"),
        (_mod("v", 4000) / 10).alias("tsp"),
        (F.expr("case when d % 6 = 2 and h between 3 and 15 then 50 else (3 * v) % 120 end") / 1000).alias("o3"),
        (_mod("v", 101) / 1000).alias("no2"),
        (_mod("7 * v", 400) / 100).alias("co"),
        (F.expr("case when d % 7 = 1 and h < 3 then -40 else (5 * v) % 60 - 5 end") / 1000).alias("so2"),
    )


def episodes(spark, sf_dir) -> DataFrame:
    """Maintenance log: known fault and event periods (`ep` identifies the row)."""
    e = _events(spark, sf_dir).filter("event_type = 'purchase' and event_id % 5 = 0")
    return e.select(
        F.col("event_id").alias("ep"),
        F.concat(F.lit("st"), _mod("user_id", 4)).alias("station_id"),
        F.expr("case event_id % 3 when 0 then 'spike' when 1 then 'offset' else 'event' end").alias("kind"),
        F.expr(
            "case when event_id % 3 = 2 then '' when event_id % 2 = 0 then 'ph' else 'dissolved_oxygen' end"
        ).alias("sensor"),
        F.col("ts").alias("start"),
        F.expr("ts + interval 6 hours").alias("end"),
    )


def vendor_export(spark, sf_dir) -> DataFrame:
    """Readings the way a vendor writes them: own column names, padded device names, UTC text times, junk cells."""
    e = _events(spark, sf_dir).filter("event_type <> 'signup'")

    def hundredths(expr):
        return F.expr(f"concat(({expr}) div 100, '.', lpad(({expr}) % 100, 2, '0'))")

    return e.select(
        F.concat(F.lit(" Buoy-"), _mod("user_id", 4), F.lit(" ")).alias("Device"),
        F.expr("case when event_id % 50 = 0 then 'bad time' else date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\") end").alias(
            "Time (UTC)"
        ),
        hundredths("1500 + v % 2000").alias("Water Temp"),
        hundredths("400 + (7 * v) % 501").alias("pH"),
        hundredths("v % 10000").alias("Turbidity %"),
        F.when(F.col("event_type") == "error", "err").otherwise(hundredths("(130 * v) % 12001")).alias("DO %"),
        F.col("event_id").alias("src_ord"),
    )


def weather_payload(spark, sf_dir) -> DataFrame:
    """One JSON document of parallel arrays per day of weather (cloud in percent, every seventh hour's cloud null)."""
    w = weather(spark, sf_dir).withColumn("hour", hour_no(F.col("timestamp")))
    row = F.struct(
        F.date_format("timestamp", "yyyy-MM-dd'T'HH:mm").alias("time"),
        F.col("air_temperature").alias("temperature_2m"),
        F.expr("case when hour % 7 <> 0 then round(cloud_cover * 100) end").alias("cloud_cover"),
        F.col("rain_mm").alias("precipitation"),
        F.col("wind_speed").alias("wind_speed_10m"),
        F.col("relative_humidity").alias("relative_humidity_2m"),
        F.col("boundary_layer_height"),
    )
    days = w.groupBy(F.to_date("timestamp").alias("day")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    fields = ["time", "temperature_2m", "cloud_cover", "precipitation", "wind_speed_10m", "relative_humidity_2m",
              "boundary_layer_height"]
    hourly = F.struct(*[F.col(f"rows.{f}").alias(f) for f in fields])
    return days.select(
        F.to_json(F.struct(hourly.alias("hourly")), {"ignoreNullFields": "false"}).alias("payload")
    )


def graded_rows(spark, sf_dir) -> DataFrame:
    """One row per event with the inputs the grading functions take: oxygen, pH, chances, concentrations."""
    e = _events(spark, sf_dir)
    return e.select(
        F.col("event_id").alias("src_ord"),
        F.when(_mod("event_id", 29) != 0, _mod("13 * v", 1400) / 100).alias("oxygen"),
        (5.5 + _mod("7 * v", 400) / 100).alias("ph"),
        (_mod("3 * v", 101) / 100).alias("p_bod_2"),
        (_mod("5 * v", 101) / 100).alias("p_bod_3"),
        (_mod("11 * v", 101) / 100).alias("p_coliform_50"),
        (_mod("17 * v", 101) / 100).alias("p_coliform_500"),
        (_mod("19 * v", 101) / 100).alias("p_coliform_5000"),
        (1 + _mod("v", 900) / 10).alias("chlorophyll"),
        (_mod("v * v", 9000)).cast("double").alias("coliform"),
        (_mod("v", 72) - 12).alias("horizon"),
    )
