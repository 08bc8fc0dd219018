"""Queries for readiness, alerts and the report."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.working import all_present, r9
from tarnwatch.operators import air_qc, alerts, grading, incidents, naqi, readiness
from tarnwatch.operators.lineage import materialise
from tarnwatch.sources import tables, vendor

from . import airquality
from .detection import judged
from .evaluation import air_daily, nightly_forecasts
from .grading import _sql_cpcb, sql_category, _ADVICE
from .intake import MAPPING
from .lakes import hourly
from .oracle import cte
from .registry import register
from .windows import S, dense_grid

_ISO = "'%Y-%m-%dT%H:%M'"


@register("e3_station_coverage", "SELECT station_id, round((max(slot) - min(slot)) / 144.0::DOUBLE, 1) AS days, " + ", ".join(f"round(count({s}) / count(*)::DOUBLE, 3) AS {s}" for s in S) + " FROM d_slot_grid GROUP BY 1")
def station_coverage(spark, sf):
    return readiness.coverage(dense_grid(spark, sf))


cte("span", "SELECT min(d)::DOUBLE AS d FROM (SELECT (max(slot) - min(slot)) / 144.0 AS d FROM d_slot_grid GROUP BY station_id)")


@register("e4_model_readiness", """
WITH_CTES SELECT 'anomaly detector' AS model, d >= 88 AS ready, printf('%.0f', d) || ' days per station; needs 88 (28 to learn, 60 to test)' AS reason FROM span
UNION ALL SELECT 'forecaster', d >= 150, printf('%.0f', d) || ' days; needs 150 (60 history, 30 calibration, 60 test)' FROM span
UNION ALL SELECT 'weather', s > 0.95, 'covers ' || printf('%.0f%%', s * 100) || ' of the readings'' time span' FROM (SELECT avg(CASE WHEN slot BETWEEN lo * 6 AND hi * 6 THEN 1.0 ELSE 0.0 END) AS s
  FROM d_slot_grid, (SELECT min(hour) AS lo, max(hour) AS hi FROM gappy_hours))
UNION ALL SELECT 'BOD soft sensor', count(*) >= 38, count(*) || ' lab samples with sensor data around them; needs 38' FROM sample_windows
UNION ALL SELECT 'algae soft sensor', count(*) >= 38, count(*) || ' lab samples with sensor data around them; needs 38' FROM sample_windows
UNION ALL SELECT 'coliform nowcast', count(*) >= 38, count(*) || ' lab samples with sensor data around them; needs 38' FROM sample_windows
UNION ALL SELECT 'air quality', d >= 135, printf('%.0f', d) || ' days per station; needs 135 (45 history, 30 calibration, 60 test)' FROM (
  SELECT min((hi - lo) / 86400000000.0) AS d FROM (SELECT epoch_us(max("timestamp")) AS hi, epoch_us(min("timestamp")) AS lo FROM air GROUP BY station_id))
UNION ALL SELECT 'air weather', false, 'weather lacks wind_speed and boundary_layer_height'
UNION ALL SELECT 'WQI classifier', count(*) >= 50, count(*) || ' lab samples; needs 50' FROM lab""".replace("WITH_CTES ", ""))
def model_readiness(spark, sf):
    w = tables.weather_gappy(spark, sf).select("timestamp", *K.WEATHER_LAKE)
    return readiness.readiness(dense_grid(spark, sf), hourly(spark, sf), tables.lab(spark, sf), w, tables.air(spark, sf))



# ---------------------------------------------------------------------------- estimates to alert on

cte("estimates", """
SELECT station_id, "timestamp", bod_n AS bod, bod_n * 0.5 + 0.01 AS bod_lo, bod_n * 1.5 + 0.02 AS bod_hi, ((src_ord * 3) % 101) / 100.0::DOUBLE AS p_above_2, ((src_ord * 7) % 101) / 100.0::DOUBLE AS p_above_3,
  chl_n AS chlorophyll_a, ((src_ord * 11) % 101) / 100.0::DOUBLE AS p_above_12, ((src_ord * 13) % 101) / 100.0::DOUBLE AS p_above_24,
  col_n AS total_coliform, ((src_ord * 17) % 101) / 100.0::DOUBLE AS p_above_50, ((src_ord * 19) % 101) / 100.0::DOUBLE AS p_above_500, ((src_ord * 23) % 101) / 100.0::DOUBLE AS p_above_5000,
  conductivity / 100 AS dissolved_oxygen, 6 + (src_ord % 40) / 10.0::DOUBLE AS ph, src_ord FROM lab_numbers WHERE bod_n IS NOT NULL AND chl_n IS NOT NULL AND col_n IS NOT NULL""")


def estimates(spark, sf):
    """Lab rows dressed as soft-sensor estimates: a value, a range and the odds of each limit."""
    from tarnwatch.functions.parse import parse_numeric

    df = tables.lab(spark, sf).withColumns({c: parse_numeric(c) for c in ("bod", "chlorophyll_a", "total_coliform")})
    df = df.filter(all_present(["bod", "chlorophyll_a", "total_coliform"]))

    def odds(k):
        return ((F.col("src_ord") * k) % 101) / 100

    return df.select(
        "station_id", "timestamp", "src_ord", "bod", (F.col("bod") * 0.5 + 0.01).alias("bod_lo"), (F.col("bod") * 1.5 + 0.02).alias("bod_hi"),
        odds(3).alias("p_above_2"), odds(7).alias("p_above_3"), "chlorophyll_a", odds(11).alias("p_above_12"), odds(13).alias("p_above_24"),
        "total_coliform", odds(17).alias("p_above_50"), odds(19).alias("p_above_500"), odds(23).alias("p_above_5000"),
        (F.col("conductivity") / 100).alias("dissolved_oxygen"), (6 + (F.col("src_ord") % 40) / 10).alias("ph"),
    )


@register("j14_cpcb_regrade", f"""
SELECT src_ord, {_sql_cpcb({50.0: '(1 - coalesce(c50, 0.5))', 500.0: '(1 - c500)', 5000.0: '(1 - c5000)'}).replace('p_bod_2', '(1 - p_above_2)').replace('p_bod_3', '(1 - p_above_3)')}
FROM (SELECT e.src_ord, e.dissolved_oxygen AS oxygen, e.ph, e.p_above_2, e.p_above_3, c.p_above_50 AS c50, c.p_above_500 AS c500, c.p_above_5000 AS c5000 FROM estimates e
  JOIN (SELECT * FROM estimates WHERE src_ord % 3 <> 0) c USING (station_id, "timestamp")) UNION ALL
SELECT src_ord, {_sql_cpcb(None).replace('p_bod_2', '(1 - p_above_2)').replace('p_bod_3', '(1 - p_above_3)')} FROM (SELECT *, dissolved_oxygen AS oxygen FROM estimates WHERE src_ord % 3 = 0)""")
def cpcb_regrade(spark, sf):
    e = estimates(spark, sf)
    out = grading.graded_with_coliform(e.drop("p_above_50", "p_above_500", "p_above_5000"), e.filter("src_ord % 3 <> 0"))
    return out.select("src_ord", "cpcb_class", r9("cpcb_confidence").alias("cpcb_confidence"), "cpcb_not_assessed")


cte("latest_estimates", 'SELECT * FROM estimates QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY "timestamp" DESC) = 1')


@register("e24_latest_estimate", 'SELECT station_id, "timestamp", bod, p_above_3 FROM latest_estimates')
def latest_estimate(spark, sf):
    return alerts.latest_per_station(estimates(spark, sf), "timestamp").select("station_id", "timestamp", "bod", "p_above_3")


cte("estimate_alerts", """
SELECT 'medium' AS severity, station_id AS station, 'BOD likely above the CPCB Class B/C limit of 3 mg/L: ' || printf('%.1f', bod) || ' mg/L (' || printf('%.1f', bod_lo) || '-' || printf('%.1f', bod_hi) || ')' AS message
FROM estimates WHERE p_above_3 >= 0.5
UNION ALL SELECT 'high', station_id, 'Possible algal bloom: chlorophyll-a likely above 24 ug/L (' || printf('%.0f', chlorophyll_a) || '); look for scum and confirm cyanobacteria with a microscope count' FROM estimates WHERE p_above_24 >= 0.5
UNION ALL SELECT 'medium', station_id, 'Chlorophyll-a likely above the WHO Alert Level 1 threshold of 12 ug/L (' || printf('%.0f', chlorophyll_a) || ')' FROM estimates WHERE p_above_24 < 0.5 AND p_above_12 >= 0.5
UNION ALL SELECT 'high', station_id, 'Total coliform likely above 5000 MPN/100 mL (' || printf('%.0f', total_coliform) || '), the CPCB Class C limit: likely sewage or runoff; take a lab sample and warn water users' FROM estimates WHERE p_above_5000 >= 0.5
UNION ALL SELECT 'medium', station_id, 'Total coliform likely above 500 MPN/100 mL (' || printf('%.0f', total_coliform) || '), the CPCB bathing (Class B) limit' FROM estimates WHERE p_above_5000 < 0.5 AND p_above_500 >= 0.5""")


def lab_alerts(df):
    whole = df.withColumn("chlorophyll_a", F.bround("chlorophyll_a", 0))
    return alerts.union([alerts.bod_alerts(df), alerts.algae_alerts(whole), alerts.coliform_alerts(df)])


@register("j10_estimate_alerts", "SELECT severity, station, message FROM estimate_alerts")
def estimate_alerts(spark, sf):
    # Every sample is graded here, not only the latest, so each rule meets many values.
    return lab_alerts(estimates(spark, sf))


cte("stale_rows", f"""
SELECT 'medium' AS severity, station_id AS station, 'No recent sensor data: check power and the GSM link' AS message FROM (
  SELECT station_id, max(slot) AS hi, max(slot) FILTER (ph IS NOT NULL AND slot % 1000 < 500) AS seen FROM d_slot_grid GROUP BY 1) WHERE seen IS NULL OR seen < hi - 18""")


@register("j10_stale_alerts", "SELECT * FROM stale_rows")
def stale_alerts(spark, sf):
    # Half of the clock is blanked, so stations differ in how long they have been silent.
    df = dense_grid(spark, sf)
    return alerts.stale_alerts(df.select("station_id", "slot", F.when(F.col("slot") % 1000 < 500, F.col("ph")).alias("ph")), ["ph"])


cte("incident_messages", f"""
SELECT 'high' AS severity, station_id AS station, 'Possible pollution event ' || strftime("start", {_ISO}) || ' to ' || strftime("end", {_ISO}) || ': several sensors changed together' AS message FROM incident_rows WHERE verdicts LIKE '%possible_event%'
UNION ALL SELECT 'medium', station_id, 'Sensor fault on ' || CASE WHEN sensors = '' THEN 'a sensor' ELSE sensors END || ' ' || strftime("start", {_ISO}) || ' to ' || strftime("end", {_ISO}) || ': check or clean it' FROM incident_rows WHERE verdicts LIKE '%sensor_fault%'
UNION ALL SELECT 'low', station_id, 'Unusual readings ' || strftime("start", {_ISO}) || ' to ' || strftime("end", {_ISO}) || ': worth a look' FROM incident_rows WHERE verdicts = 'needs_review'""")


@register("j10_incident_alerts", "SELECT * FROM incident_messages")
def incident_alerts(spark, sf):
    return alerts.incident_alerts(incidents.alarm_incidents(judged(spark, sf)))


@register("j10_oxygen_night_alerts", """
SELECT CASE WHEN days_ahead <= 2 THEN 'high' ELSE 'medium' END AS severity, station_id AS station,
  'Oxygen may fall below 6 mg/L before dawn on ' || strftime(make_timestamp(night_of * 86400000000), '%Y-%m-%d') || ' (chance ' || printf('%.0f%%', p * 100) || ')' AS message
FROM (SELECT *, round(least(p_below_alert + 0.0013, 1), 2) AS p FROM nightly_fc) WHERE p >= 0.5""")
def oxygen_night_alerts(spark, sf):
    # Shifted off the ties the two engines would print differently.
    shifted = F.least(F.col("p_below_alert") + 0.0013, F.lit(1.0))
    nights = nightly_forecasts(spark, sf).withColumn("p_below_alert", F.round(shifted, 2))
    return alerts.oxygen_alerts(nights, 6.0)


cte("limit_hits", "SELECT station_id, 'ph' AS sensor, count(*) AS n FROM vendor_censored WHERE ph_hit GROUP BY 1 UNION ALL SELECT station_id, 'dissolved_oxygen', count(*) FROM vendor_censored WHERE do_hit GROUP BY 1")


@register("j12_limit_and_forecast_notes", """
SELECT 'low' AS severity, station_id AS station, sensor || ' sat at the sensor''s range limit (' || CASE sensor WHEN 'ph' THEN '4.0-9.0' ELSE '-100.0' END || ') on ' || n || ' readings in this report''s data: the lake went beyond what the sensor can measure' AS message FROM limit_hits
UNION ALL SELECT 'medium', station_id, 'No forecast today: not every sensor has reported in the last 24 hours' FROM (SELECT DISTINCT station_id FROM readings WHERE station_id NOT IN (SELECT station_id FROM latest_hours))""")
def limit_and_forecast_notes(spark, sf):
    from tarnwatch.operators import forecast_features as ff

    raw = vendor.censored(vendor.renamed(tables.vendor_export(spark, sf), MAPPING), MAPPING)
    limits = alerts.sensor_limit_notes(vendor.censor_counts(raw), MAPPING.limits)
    able = ff.latest_complete_hour(ff.working_hours(hourly(spark, sf)))
    return limits.unionByName(alerts.no_forecast_notes(tables.readings(spark, sf), able))


@register("j13_sensor_health", " UNION ALL ".join(
    f"SELECT station_id, '{s}' AS sensor, count(*) FILTER ({s}_fault <> '') AS faulty_readings, coalesce(string_agg(DISTINCT {s}_fault, ',' ORDER BY {s}_fault) FILTER ({s}_fault <> ''), '') AS fault_types FROM judged GROUP BY 1" for s in S))
def sensor_health(spark, sf):
    return alerts.sensor_health(judged(spark, sf))


_NAMES = "CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in K.POLLUTANT_NAMES.items()) + " END"
cte("air_flag_sets", "SELECT DISTINCT station_id, pollutant FROM (" + " UNION ALL ".join(
    f"SELECT station_id, '{p}' AS pollutant, {p}_flag AS flag FROM air_checked WHERE hour > (SELECT max(hour) - 24 FROM air_checked)" for p in airquality.P) + ") WHERE flag = 'at_sensor_limit'")


@register("j11_air_alerts", f"""
SELECT CASE category WHEN 'Poor' THEN 'medium' ELSE 'high' END AS severity, station_id AS station,
  'Air quality ' || category || ' (AQI ' || printf('%.0f', aqi) || ', mainly ' || {_NAMES.replace('{x}', 'prominent_pollutant')} || '): ' || {_ADVICE} AS message
FROM (SELECT *, {sql_category('aqi')} AS category FROM naqi_rows WHERE aqi IS NOT NULL) WHERE category IN ('Poor', 'Very Poor', 'Severe')
UNION ALL SELECT 'low', station_id, string_agg(n, ', ' ORDER BY n) || ' reached the top of the sensor''s range: the true level was higher than reported' FROM (SELECT station_id, {_NAMES.replace('{x}', 'pollutant')} AS n FROM air_flag_sets) GROUP BY 2
UNION ALL SELECT 'medium', station_id, 'Air likely Poor or worse on ' || strftime(make_timestamp((issue_day + days_ahead) * 86400000000), '%Y-%m-%d') || ' (chance ' || printf('%.0f%%', c * 100) || '; PM2.5 around ' || printf('%.0f', pm25) || ' ug/m3): consider advisories for outdoor activity'
FROM (SELECT *, round(p_poor_or_worse, 2) AS c FROM air_outlook) WHERE c >= 0.5""")
def air_alerts(spark, sf):
    from tarnwatch.functions.airindex import aqi_advice

    checked = materialise(airquality.checked(spark, sf), "air_checked")
    index = naqi.naqi(naqi.averaged(checked)).filter("aqi is not null").withColumn("advice", aqi_advice("category"))
    flags = air_qc.recent_flags(checked)
    daily = air_daily(spark, sf).withColumns({"p_poor_or_worse": F.round("p_poor_or_worse", 2), "day": F.col("issue_day") + F.col("days_ahead")})
    return alerts.air_alerts(index, flags, daily)


@register("g2_alerts_by_severity", """
SELECT severity, station, message, row_number() OVER (ORDER BY CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, station, message) AS place FROM (
  SELECT DISTINCT * FROM estimate_alerts WHERE severity IN ('high', 'medium')) QUALIFY place <= 20""")
def alerts_by_severity(spark, sf):
    chosen = alerts.selected(lab_alerts(estimates(spark, sf)).distinct(), "medium")
    top = alerts.most_severe_first(chosen, 20)
    from pyspark.sql import Window

    # Twenty rows are numbered, after the top-k.
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(alerts.severity_rank(), "station", "message"))
    return top.withColumn("place", place.cast("bigint"))


@register("g1_sorted_readings", 'SELECT src_ord, station_id, "timestamp" FROM readings')
def sorted_readings(spark, sf):
    return tables.readings(spark, sf).select("src_ord", "station_id", "timestamp").orderBy("station_id", "timestamp")


@register("e26_value_counts", """
SELECT station_id, verdict, count(*) AS n FROM judged GROUP BY 1, 2""")
def value_counts(spark, sf):
    return judged(spark, sf).groupBy("station_id", "verdict").agg(F.count(F.lit(1)).alias("n"))


@register("e24_latest_reading", "SELECT station_id, make_timestamp(slot * 600000000) AS \"time\", " + ", ".join(S) + """ FROM d_slot_grid WHERE temperature IS NOT NULL OR ph IS NOT NULL OR turbidity IS NOT NULL OR dissolved_oxygen IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY slot DESC) = 1""")
def latest_reading(spark, sf):
    return alerts.latest_readings(dense_grid(spark, sf))


@register("j16_weather_short", """
SELECT avg(CASE WHEN rain_mm IS NULL OR air_temperature IS NULL OR cloud_cover IS NULL THEN 1.0 ELSE 0.0 END) > 0.1 AS weather_short FROM
  (SELECT unnest(generate_series(max(hour) - 60, max(hour) + 48)) AS hour FROM gappy_hours) LEFT JOIN gappy_hours USING (hour)""")
def weather_short(spark, sf):
    from tarnwatch.functions.clock import hour_no

    w = tables.weather_gappy(spark, sf).withColumn("hour", hour_no(F.col("timestamp")))
    last = w.agg(F.max("hour")).first()[0]
    return readiness.weather_short(w, last - 60, last + 48, K.WEATHER_LAKE)
