"""Queries for parsing, vendor exports, dedupe, upserts, grids and hourly means (sections A, B4, C1-C7, D1-D7, E1)."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_hour, from_slot, nearest_slot
from tarnwatch.functions.parse import local_time, parse_numeric, parse_time
from tarnwatch.functions.water import do_percent_to_mgl, mask_out_of_range
from tarnwatch.functions.working import r9, to_working, from_working
from tarnwatch.operators import grid
from tarnwatch.sources import readers, tables, vendor
from tarnwatch.sources.contracts import require_columns

from .oracle import CTES, cte
from .registry import register

S = K.LAKE_SENSORS
MAPPING = vendor.VendorMapping(
    columns={"station_id": "Device", "timestamp": "Time (UTC)", "temperature": "Water Temp", "ph": "pH",
             "turbidity": "Turbidity %", "dissolved_oxygen": "DO %"},
    stations={"Buoy-0": "north", "Buoy-1": "south"},
    oxygen_unit="percent",
    turbidity_unit="percent",
    turbidity_calibration=(0.5, -2.0),
    limits={"ph": (4.0, 9.0), "dissolved_oxygen": (None, 100.0)},
    timezone="Asia/Kolkata",
)

SAT = """exp(-139.34411 + 1.575701e5 / ({t} + 273.15) - 6.642308e7 / pow({t} + 273.15, 2) + 1.2438e10 / pow({t} + 273.15, 3)
 - 8.621949e11 / pow({t} + 273.15, 4))"""


def saturation(t: str, pressure=1.0) -> str:
    return f"({SAT.format(t=t)} * {pressure})"


def rounded(cols, prefix=""):
    return ", ".join(f"round({prefix}{c}, 9) + 0.0 AS {c}" for c in cols)


cte("vendor_export", """
SELECT ' Buoy-' || (user_id % 4) || ' ' AS device,
  CASE WHEN event_id % 50 = 0 THEN 'bad time' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS time_utc, event_id,
  CASE WHEN event_id % 50 <> 0 THEN date_trunc('second', ts) + INTERVAL 330 MINUTE END AS local_ts,
  (1500 + v % 2000) / 100.0::DOUBLE AS temp, (400 + (7 * v) % 501) / 100.0::DOUBLE AS ph,
  (v % 10000) / 100.0::DOUBLE AS turb_pct,
  CASE WHEN event_type <> 'error' THEN ((130 * v) % 12001) / 100.0::DOUBLE END AS do_pct,
  CASE user_id % 4 WHEN 0 THEN 'north' WHEN 1 THEN 'south' ELSE 'Buoy-' || (user_id % 4) END AS station_id
FROM ev WHERE event_type <> 'signup'""")
cte("vendor_censored", """
SELECT *, ph <= 4.0 OR ph >= 9.0 AS ph_hit, coalesce(do_pct >= 100.0, false) AS do_hit FROM vendor_export""")
# Half-even snapping to 10-minute slots, written with DuckDB's own half-even rounding.
cte("slot_readings", """
SELECT *, CAST(round_even(epoch_us("timestamp") / 600000000.0, 0) AS BIGINT) AS slot FROM readings""")
cte("slot_first", """
SELECT station_id, slot, temperature, ph, turbidity, dissolved_oxygen FROM slot_readings
QUALIFY row_number() OVER (PARTITION BY station_id, slot ORDER BY src_ord) = 1""")
cte("slot_calendar", """
SELECT station_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM slot_first GROUP BY station_id""")
cte("slot_grid", """
SELECT c.station_id, c.slot, f.temperature, f.ph, f.turbidity, f.dissolved_oxygen
FROM slot_calendar c LEFT JOIN slot_first f USING (station_id, slot)""")
cte("hour_values", """
SELECT station_id, slot // 6 AS hour,
""" + ", ".join(f"CASE WHEN count({s}) >= 3 THEN avg({s}) END AS {s}" for s in S) + """
FROM slot_first GROUP BY ALL""")
cte("hour_calendar", """
SELECT station_id, unnest(generate_series(min(hour), max(hour))) AS hour FROM hour_values GROUP BY station_id""")
cte("hour_grid", """
SELECT c.station_id, c.hour, f.temperature, f.ph, f.turbidity, f.dissolved_oxygen
FROM hour_calendar c LEFT JOIN hour_values f USING (station_id, hour)""")
# The same chain over the dense, skewed readings.
for name in ("slot_readings", "slot_first", "slot_calendar", "slot_grid", "hour_values", "hour_calendar", "hour_grid"):
    sql = CTES[name]
    for inner in ("slot_readings", "slot_first", "slot_calendar", "hour_values", "hour_calendar"):
        sql = sql.replace(inner, f"d_{inner}")
    cte(f"d_{name}", sql.replace("FROM readings", "FROM dense"))


@register("a4_weather_payload", """
SELECT "timestamp", round(air_temperature, 9) AS air_temperature,
  CASE WHEN CAST(epoch("timestamp") AS BIGINT) // 3600 % 7 <> 0 THEN round(cloud_cover, 9) END AS cloud_cover,
  round(rain_mm, 9) AS rain_mm, round(wind_speed, 9) AS wind_speed, relative_humidity, boundary_layer_height FROM weather""")
def weather_payload(spark, sf):
    w = readers.weather_from_payload(tables.weather_payload(spark, sf))
    return w.select("timestamp", *[r9(name).alias(name) for name, _ in K.WEATHER_VARIABLES.values()])


@register("a6_parse_numeric", """
SELECT src_ord,
  CASE WHEN bod LIKE '<%' THEN try_cast(substr(bod, 2) AS DOUBLE) / 2 ELSE try_cast(bod AS DOUBLE) END AS bod,
  CASE WHEN chlorophyll_a LIKE '<%' THEN try_cast(substr(chlorophyll_a, 2) AS DOUBLE) / 2 ELSE try_cast(chlorophyll_a AS DOUBLE) END AS chlorophyll_a,
  CASE WHEN total_coliform LIKE '<%' THEN try_cast(substr(total_coliform, 2) AS DOUBLE) / 2 ELSE try_cast(total_coliform AS DOUBLE) END AS total_coliform
FROM lab""")
def parse_lab(spark, sf):
    return tables.lab(spark, sf).select(
        "src_ord", *[parse_numeric(c).alias(c) for c in ("bod", "chlorophyll_a", "total_coliform")]
    )


@register("a7_time_coercion", """
SELECT trim(device) AS device, count(*) AS rows_in, count(*) FILTER (event_id % 50 = 0) AS bad_timestamp_dropped,
  min(try_strptime(time_utc, '%Y-%m-%dT%H:%M:%SZ')) AS first_time, max(try_strptime(time_utc, '%Y-%m-%dT%H:%M:%SZ')) AS last_time
FROM vendor_export GROUP BY 1""")
def time_coercion(spark, sf):
    raw = tables.vendor_export(spark, sf).withColumn("t", parse_time("Time (UTC)"))
    return raw.groupBy(F.trim("Device").alias("device")).agg(
        F.count(F.lit(1)).alias("rows_in"),
        F.count_if(F.col("t").isNull()).alias("bad_timestamp_dropped"),
        F.min("t").alias("first_time"),
        F.max("t").alias("last_time"),
    )


@register("a8_local_time", """
SELECT event_id AS src_ord, local_ts FROM vendor_export""")
def zone_conversion(spark, sf):
    return tables.vendor_export(spark, sf).select("src_ord", local_time("Time (UTC)", K.TIMEZONE).alias("local_ts"))


@register("a9_contract_checked_scan", """
SELECT station_id, count(*) AS readings, count(dissolved_oxygen) AS with_oxygen FROM readings GROUP BY 1""")
def contract_checked(spark, sf):
    df = require_columns(tables.readings(spark, sf), K.READING_COLUMNS, "sensor data")
    return df.groupBy("station_id").agg(
        F.count(F.lit(1)).alias("readings"), F.count("dissolved_oxygen").alias("with_oxygen")
    )


@register("c1_vendor_rename", """
SELECT event_id AS src_ord, station_id, local_ts AS "timestamp", temp AS temperature, ph, turb_pct AS turbidity, do_pct AS dissolved_oxygen
FROM vendor_export""")
def vendor_rename(spark, sf):
    return vendor.renamed(tables.vendor_export(spark, sf), MAPPING).select("src_ord", "station_id", "timestamp", *S)


@register("c2_censor_at_limit", """
SELECT event_id AS src_ord, CASE WHEN NOT ph_hit THEN ph END AS ph, CASE WHEN NOT do_hit THEN do_pct END AS dissolved_oxygen,
  ph_hit AS ph_at_limit, do_hit AS dissolved_oxygen_at_limit
FROM vendor_censored""")
def censor_rows(spark, sf):
    df = vendor.censored(vendor.renamed(tables.vendor_export(spark, sf), MAPPING), MAPPING)
    return df.select("src_ord", "ph", "dissolved_oxygen", "ph_at_limit", "dissolved_oxygen_at_limit")


@register("c2_censor_counts", """
SELECT station_id, 'ph' AS sensor, count(*) AS readings FROM vendor_censored WHERE ph_hit GROUP BY 1
UNION ALL SELECT station_id, 'dissolved_oxygen', count(*) FROM vendor_censored WHERE do_hit GROUP BY 1""")
def censor_counts(spark, sf):
    return vendor.censor_counts(vendor.censored(vendor.renamed(tables.vendor_export(spark, sf), MAPPING), MAPPING))


@register("c2_ingest_report", """
SELECT count(*) AS "rows", count(*) FILTER (event_id % 50 = 0) AS rows_without_time, 0::BIGINT AS temperature_at_limit,
  count(*) FILTER (ph_hit) AS ph_at_limit, 0::BIGINT AS turbidity_at_limit, count(*) FILTER (do_hit) AS dissolved_oxygen_at_limit
FROM vendor_censored""")
def ingest_report(spark, sf):
    return vendor.ingest_report(tables.vendor_export(spark, sf), MAPPING)


@register("c3_oxygen_saturation", f"""
SELECT src_ord, round({saturation('temperature')}, 9) AS saturation, round({saturation('temperature', 0.93)}, 9) AS at_altitude FROM readings""")
def oxygen_saturation(spark, sf):
    from tarnwatch.functions.water import do_saturation

    return tables.readings(spark, sf).select(
        "src_ord",
        r9(do_saturation("temperature")).alias("saturation"),
        r9(do_saturation("temperature", K.PRESSURE_ATM)).alias("at_altitude"),
    )


@register("c4_percent_to_mgl", f"""
SELECT event_id AS src_ord, round(do_pct / 100.0 * {saturation('temp', 0.93)}, 9) AS mg_l FROM vendor_export""")
def percent_to_mgl(spark, sf):
    df = vendor.renamed(tables.vendor_export(spark, sf), MAPPING)
    return df.select("src_ord", r9(do_percent_to_mgl("dissolved_oxygen", "temperature", K.PRESSURE_ATM)).alias("mg_l"))


@register("c5_vendor_normalise", f"""
SELECT event_id AS src_ord, station_id, local_ts AS "timestamp", round(temp, 9) AS temperature,
  round(CASE WHEN NOT ph_hit THEN ph END, 9) AS ph, round(greatest(0.5 * turb_pct - 2.0, 0.0), 9) + 0.0 AS turbidity,
  round(CASE WHEN NOT do_hit THEN do_pct END / 100.0 * {saturation('temp', 0.93)}, 9) AS dissolved_oxygen
FROM vendor_censored WHERE event_id % 50 <> 0""")
def vendor_normalise(spark, sf):
    df = vendor.normalise(tables.vendor_export(spark, sf), MAPPING)
    return df.select("src_ord", "station_id", "timestamp", *[r9(s).alias(s) for s in S])


@register("c7_physical_range", """
SELECT station_id, count(*) FILTER (temperature NOT BETWEEN 0 AND 45) AS temperature, count(*) FILTER (ph NOT BETWEEN 0 AND 14) AS ph,
  count(*) FILTER (ph BETWEEN 0 AND 14) AS ph_kept, round(avg(ph) FILTER (ph BETWEEN 0 AND 14), 9) AS ph_mean
FROM dense GROUP BY 1""")
def physical_range(spark, sf):
    df = tables.dense(spark, sf)
    masked = df.withColumns({f"ok_{s}": mask_out_of_range(s, s) for s in S})

    def lost(s):
        return F.count_if(F.col(s).isNotNull() & F.col(f"ok_{s}").isNull()).alias(s)

    return masked.groupBy("station_id").agg(
        lost("temperature"), lost("ph"), F.count("ok_ph").alias("ph_kept"), r9(F.avg("ok_ph")).alias("ph_mean")
    )


@register("c8_working_scale", """
SELECT src_ord, round(ln(1 + greatest(turbidity, 0)), 9) + 0.0 AS working, round(turbidity, 9) + 0.0 AS back, ph FROM readings""")
def working_scale(spark, sf):
    df = tables.readings(spark, sf).withColumn("w", to_working("turbidity", "turbidity"))
    return df.select(
        "src_ord", r9("w").alias("working"), r9(from_working("w", "turbidity")).alias("back"), to_working("ph", "ph").alias("ph")
    )


@register("c33_recent_rows", """
SELECT src_ord FROM readings WHERE "timestamp" > (SELECT max("timestamp") FROM readings) - INTERVAL 5 DAY""")
def recent_rows(spark, sf):
    from tarnwatch.operators.recent import recent

    return recent(tables.readings(spark, sf), "timestamp", days=5).select("src_ord")


@register("c34_mask_faulty", """
SELECT src_ord, CASE WHEN src_ord % 7 <> 0 THEN turbidity END AS turbidity, ph FROM readings""")
def mask_faulty(spark, sf):
    df = tables.readings(spark, sf).withColumn("turbidity_fault", F.expr("case when src_ord % 7 = 0 then 'drift' when src_ord % 2 = 0 then '' end"))
    return grid.mask_faulty(df).select("src_ord", "turbidity", "ph")


@register("c34_masked_count", """
SELECT count(*) FILTER (src_ord % 7 = 0) AS turbidity_masked FROM readings""")
def masked_count(spark, sf):
    df = tables.readings(spark, sf).withColumn("turbidity_fault", F.expr("case when src_ord % 7 = 0 then 'drift' when src_ord % 2 = 0 then '' end"))
    return grid.faulty_count(df)


@register("c35_nearest_slot", """
SELECT src_ord, make_timestamp(CAST(round_even(epoch_us("timestamp") / 600000000.0, 0) AS BIGINT) * 600000000) AS slot FROM readings""")
def snap(spark, sf):
    return tables.readings(spark, sf).select("src_ord", from_slot(nearest_slot(F.col("timestamp"))).alias("slot"))


@register("d1_first_wins_dedupe", f"""
SELECT station_id, make_timestamp(slot * 600000000) AS "timestamp", {', '.join(S)} FROM slot_first""")
def dedupe_first(spark, sf):
    return grid.with_timestamp(grid.first_per_slot(tables.readings(spark, sf)))


@register("d1_prepare_report", """
SELECT a.rows_in, a.duplicates_dropped, g.n - a.kept AS gap_rows_added, g.n AS rows_out, g.lo AS first_time, g.hi AS last_time
FROM (SELECT count(*) AS rows_in, count(*) - (SELECT count(*) FROM slot_first) AS duplicates_dropped, (SELECT count(*) FROM slot_first) AS kept FROM readings) a,
 (SELECT count(*) AS n, make_timestamp(min(slot) * 600000000) AS lo, make_timestamp(max(slot) * 600000000) AS hi FROM slot_grid) g""")
def prepare_report(spark, sf):
    from tarnwatch.operators.reports import prepare_report as report

    return report(tables.readings(spark, sf)).drop("bad_timestamp_dropped", "stations")


@register("d2_full_row_dedupe", """
SELECT DISTINCT temperature, ph, turbidity FROM readings""")
def full_row_dedupe(spark, sf):
    return tables.readings(spark, sf).select("temperature", "ph", "turbidity").dropDuplicates()


@register("d3_history_upsert", """
SELECT station_id, stamp, max_by(temperature, (f, src_ord)) AS temperature, max(f) AS from_file FROM (
  SELECT station_id, strftime("timestamp", '%Y-%m-%d %H:00') AS stamp, temperature, src_ord, CAST(src_ord % 3 AS BIGINT) AS f FROM readings)
GROUP BY 1, 2""")
def history_upsert(spark, sf):
    rows = tables.readings(spark, sf).select(
        "station_id", F.date_format("timestamp", "yyyy-MM-dd HH:00").alias("stamp"), "temperature", "src_ord",
        (F.col("src_ord") % 3).alias("from_file"),
    )
    parts = [rows.filter(F.col("from_file") == f) for f in range(3)]
    history = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return grid.latest_wins(history, ["station_id", "stamp"], ["from_file", "src_ord"]).drop("src_ord")


@register("d4_weather_merge", """
SELECT "timestamp", CASE WHEN fresh THEN air_temperature + 1 ELSE air_temperature END AS air_temperature FROM (
  SELECT *, "timestamp" > (SELECT max("timestamp") FROM weather) - INTERVAL 200 HOUR AS fresh FROM weather)""")
def weather_merge(spark, sf):
    from tarnwatch.operators.recent import recent

    stored = tables.weather(spark, sf).select("timestamp", "air_temperature", F.lit(0).alias("version"))
    fresh = recent(tables.weather(spark, sf), "timestamp", hours=200)
    fresh = fresh.select("timestamp", (F.col("air_temperature") + 1).alias("air_temperature"), F.lit(1).alias("version"))
    return grid.latest_wins(stored.unionByName(fresh), ["timestamp"], ["version"]).drop("version")


@register("d5_slot_grid", f"""
SELECT station_id, make_timestamp(slot * 600000000) AS "timestamp", {', '.join(S)} FROM slot_grid""")
def slot_grid(spark, sf):
    return grid.with_timestamp(grid.slot_grid(tables.readings(spark, sf)))


# Every 1,009th reading comes from a clock that was reset nine years back.
cte("strayed", """
SELECT * REPLACE (CASE WHEN src_ord % 1009 = 7 THEN "timestamp" - INTERVAL 3300 DAY ELSE "timestamp" END AS "timestamp") FROM readings""")
cte("stray_days", """
SELECT station_id, CAST(datediff('day', TIMESTAMP '1970-01-01', "timestamp") AS BIGINT) AS day, count(*) AS readings FROM strayed WHERE "timestamp" < TIMESTAMP '2020-01-01' GROUP BY 1, 2""")


def strayed(spark, sf):
    moved = F.when(F.col("src_ord") % 1009 == 7, F.col("timestamp") - F.make_dt_interval(F.lit(3300))).otherwise(F.col("timestamp"))
    return tables.readings(spark, sf).withColumn("timestamp", moved)


@register("d5_stray_clocks", "SELECT station_id, day, readings FROM stray_days")
def stray_clocks(spark, sf):
    return grid.stray_days(strayed(spark, sf))


@register("d5_grid_without_strays", """
SELECT station_id, min("timestamp") AS first_time, max("timestamp") AS last_time, count(*) AS slots, count(temperature) AS filled FROM (
  SELECT c.station_id, make_timestamp(c.slot * 600000000) AS "timestamp", f.temperature FROM
   (SELECT station_id, unnest(generate_series(min(slot), max(slot))) AS slot FROM slot_readings WHERE src_ord % 1009 <> 7 GROUP BY 1) c
   LEFT JOIN (SELECT station_id, slot, temperature FROM slot_readings WHERE src_ord % 1009 <> 7 QUALIFY row_number() OVER (PARTITION BY station_id, slot ORDER BY src_ord) = 1) f USING (station_id, slot))
GROUP BY 1""")
def grid_without_strays(spark, sf):
    rows = strayed(spark, sf)
    slots = grid.with_timestamp(grid.slot_grid(grid.without_strays(rows, grid.stray_days(rows))))
    return slots.groupBy("station_id").agg(
        F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"), F.count(F.lit(1)).alias("slots"), F.count("temperature").alias("filled")
    )


@register("e1_hourly_mean", f"""
SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", {rounded(S)} FROM hour_grid""")
def hourly_mean(spark, sf):
    hourly = grid.with_timestamp(grid.hourly_grid(tables.readings(spark, sf)))
    return hourly.select("station_id", "timestamp", *[r9(s).alias(s) for s in S])


@register("d6_hourly_grid_skewed", f"""
SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", {rounded(S)} FROM d_hour_grid""")
def hourly_grid_skewed(spark, sf):
    hourly = grid.with_timestamp(grid.hourly_grid(tables.dense(spark, sf)))
    return hourly.select("station_id", "timestamp", *[r9(s).alias(s) for s in S])


cte("gappy_hours", """
SELECT hour, g.air_temperature, g.cloud_cover, g.rain_mm FROM
 (SELECT unnest(generate_series(min(h), max(h))) AS hour FROM (SELECT CAST(epoch("timestamp") AS BIGINT) // 3600 AS h FROM weather_gappy)) c
 LEFT JOIN (SELECT CAST(epoch("timestamp") AS BIGINT) // 3600 AS hour, * FROM weather_gappy) g USING (hour)""")


def _interpolated(c):
    return f"""coalesce({c}, CASE WHEN hour - p_{c}.h <= 3 AND n_{c}.h IS NOT NULL THEN
      p_{c}.x + (n_{c}.x - p_{c}.x) * ((hour - p_{c}.h) / (n_{c}.h - p_{c}.h)::DOUBLE) END) AS {c}"""


cte("filled_weather", "SELECT hour, " + ", ".join(_interpolated(c) for c in K.WEATHER_LAKE) + " FROM (SELECT *, " + ", ".join(
    f"""last_value(CASE WHEN {c} IS NOT NULL THEN {{'h': hour, 'x': {c}}} END IGNORE NULLS) OVER (ORDER BY hour ROWS UNBOUNDED PRECEDING) AS p_{c},
    first_value(CASE WHEN {c} IS NOT NULL THEN {{'h': hour, 'x': {c}}} END IGNORE NULLS) OVER (ORDER BY hour ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n_{c}"""
    for c in K.WEATHER_LAKE) + " FROM gappy_hours)")


@register("d7_weather_interpolation", """
SELECT make_timestamp(hour * 3600000000) AS "timestamp", round(air_temperature, 9) + 0.0 AS air_temperature,
  round(cloud_cover, 9) + 0.0 AS cloud_cover, round(rain_mm, 9) + 0.0 AS rain_mm FROM filled_weather""")
def weather_interpolation(spark, sf):
    w = grid.weather_grid(tables.weather_gappy(spark, sf), K.WEATHER_LAKE)
    return w.select(from_hour(F.col("hour")).alias("timestamp"), *[r9(c).alias(c) for c in K.WEATHER_LAKE])
