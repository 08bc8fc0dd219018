"""Queries for air checks and the index."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_hour
from tarnwatch.functions.working import r9
from tarnwatch.operators import air_qc, naqi
from tarnwatch.operators.chunks import framed
from tarnwatch.operators.grid import on_calendar
from tarnwatch.sources import tables

from .grading import _sql_mass, _sql_sub_index, sql_category
from .oracle import cte
from .registry import register

P = ["pm1", "pm25", "pm10", "tsp", "o3", "no2", "co", "so2"]
GAS = ["o3", "no2", "co", "so2"]
IDX = list(K.BREAKPOINTS)
H0 = 'make_timestamp(hour * 3600000000) AS "timestamp"'
AW = "OVER (PARTITION BY station_id ORDER BY hour)"
C25 = "OVER (PARTITION BY station_id ORDER BY hour ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)"


def hourly(spark, sf):
    return air_qc.air_hourly(tables.air(spark, sf))


def at_hour(df, cols):
    return df.select("station_id", from_hour(F.col("hour")).alias("timestamp"), *cols)


cte("air_hours", 'SELECT station_id, epoch_us("timestamp") // 3600000000 AS hour, ' + ", ".join(
    f"CASE WHEN count({p}) >= 2 THEN avg({p}) END AS {p}, coalesce(bool_or({p} >= {K.CEILING[p]}), false) AS {p}_at_limit" for p in P)
    + " FROM air GROUP BY ALL")
cte("air_floored", "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {g} >= -3 * {K.DETECTION_LIMIT[g]} THEN greatest({g}, 0) END AS {g}" for g in GAS) + "), " + ", ".join(
    f"coalesce({g} < -3 * {K.DETECTION_LIMIT[g]}, false) AS {g}_neg" for g in GAS) + " FROM air_hours")
cte("air_mid", "SELECT *, " + ", ".join(
    f"CASE WHEN count({p}) {C25} >= 6 THEN median({p}) {C25} END AS {p}_mid, coalesce({p} = lag({p}) {AW}, false) AS {p}_same" for p in P) + " FROM air_floored")
cte("air_spread", "SELECT *, " + ", ".join(
    f"CASE WHEN count(abs({p} - {p}_mid)) {C25} >= 6 THEN median(abs({p} - {p}_mid)) {C25} * 1.4826 END AS {p}_spread" for p in P) + " FROM air_mid")
cte("air_z", "SELECT *, " + ", ".join(
    f"CASE WHEN {p}_spread IS NOT NULL THEN ({p} - {p}_mid) / greatest({p}_spread, 1e-9) END AS {p}_z" for p in P) + " FROM air_spread")
_B5 = AW[:-1] + " ROWS 4 PRECEDING)"
cte("air_shape", "SELECT *, " + ", ".join(
    f"coalesce({p}_z > 8 AND coalesce(lag({p}_z) {AW}, 0) < 4 AND coalesce(lead({p}_z) {AW}, 0) < 4, false) AS {p}_lone, "
    f"(count(*) {_B5} = 5 AND bool_and({p}_same) {_B5}) AS {p}_stuck" for p in P) + " FROM air_z")


@register("e2_air_hourly_limits", f"SELECT station_id, {H0}, {', '.join(f'round({p}, 9) + 0.0 AS {p}, {p}_at_limit' for p in P)} FROM air_hours")
def air_hourly(spark, sf):
    return at_hour(hourly(spark, sf), [*[r9(p).alias(p) for p in P], *[f"{p}_at_limit" for p in P]])


@register("f2_stuck_sensor", f"SELECT station_id, {H0}, {', '.join(f'{p}_stuck AS stuck_{p}' for p in ('o3', 'no2', 'pm25'))} FROM air_shape")
def stuck(spark, sf):
    ps = ("o3", "no2", "pm25")
    return at_hour(air_qc.shape_flags(hourly(spark, sf), {p: p for p in ps}), [f"stuck_{p}" for p in ps])


@register("f19_isolated_spike", f"SELECT station_id, {H0}, pm25_lone AS lone_pm25, pm10_lone AS lone_pm10 FROM air_shape")
def isolated_spike(spark, sf):
    return at_hour(air_qc.shape_flags(hourly(spark, sf), {"pm25": "pm25", "pm10": "pm10"}), ["lone_pm25", "lone_pm10"])


def _sql_flag(p):
    neg = f"WHEN {p}_neg THEN 'negative' " if p in GAS else ""
    return f"CASE WHEN {p}_at_limit THEN 'at_sensor_limit' WHEN {p}_lone THEN 'spike' WHEN {p}_stuck AND {p} IS NOT NULL THEN 'stuck' {neg}ELSE '' END"


cte("air_flagged", f"SELECT *, {', '.join(f'{_sql_flag(p)} AS {p}_f' for p in P)} FROM air_shape")
cte("air_kept", f"SELECT * REPLACE ({', '.join(f'''CASE WHEN {p}_f NOT IN ('stuck', 'spike') THEN {p} END AS {p}''' for p in P)}) FROM air_flagged")
_GROWTH = "CASE WHEN rh <= 0 THEN 1 WHEN rh IS NULL THEN 1 ELSE 1 + (0.4 / 1.65) / (1 / (least(rh, 95) / 100) - 1) END"
PM = K.PARTICLES
cte("air_humid", f"""
SELECT k.* REPLACE ({', '.join(f"k.{p} / ({_GROWTH}) AS {p}" for p in PM)}), coalesce(rh > 95, false) AS foggy
FROM air_kept k LEFT JOIN (SELECT CAST(epoch("timestamp") AS BIGINT) // 3600 AS whour, relative_humidity AS rh FROM weather) w ON k.hour = w.whour""")
cte("air_clear", "SELECT * REPLACE (" + ", ".join(f"CASE WHEN NOT foggy THEN {p} END AS {p}" for p in PM) + ", " + ", ".join(
    f"CASE WHEN foggy AND {p} IS NOT NULL THEN 'too_humid' ELSE {p}_f END AS {p}_f" for p in PM) + ") FROM air_humid")
_WRONG = {(a, b): f"coalesce({a} > {b} + 5 + 0.15 * {b}, false)" for a, b in zip(PM, PM[1:])}


def _sql_order(p):
    return " OR ".join(c for pair, c in _WRONG.items() if p in pair)


cte("air_checked", "SELECT station_id, hour, " + ", ".join(PM) + ", " + ", ".join(f"{_sql_mass(g)} AS {g}" for g in GAS) + ", " + ", ".join(
    f"CASE WHEN ({_sql_order(p)}) AND {p}_f = '' THEN 'size_order' ELSE {p}_f END AS {p}_flag" for p in PM) + ", " + ", ".join(
    f"{g}_f AS {g}_flag" for g in GAS) + " FROM air_clear")


def checked(spark, sf):
    return air_qc.check_air(hourly(spark, sf), tables.weather(spark, sf))


@register("c12_humidity_correction", f"""
SELECT station_id, {H0}, {', '.join(f"round(CASE WHEN NOT foggy THEN {p} / ({_GROWTH}) END, 9) AS {p}" for p in PM)}
FROM (SELECT a.*, rh, coalesce(rh > 95, false) AS foggy FROM air_hours a LEFT JOIN (SELECT CAST(epoch("timestamp") AS BIGINT) // 3600 AS whour, relative_humidity AS rh FROM weather) w ON a.hour = w.whour)""")
def humidity(spark, sf):
    out = air_qc.humidity_corrected(hourly(spark, sf), tables.weather(spark, sf), PM)
    return at_hour(out, [r9(F.when(~F.col("_foggy"), F.col(p))).alias(p) for p in PM])


@register("c13_size_order", f"SELECT station_id, {H0}, {', '.join(f'({_sql_order(p)}) AS {p}' for p in PM)} FROM air_hours")
def size_order(spark, sf):
    return at_hour(hourly(spark, sf), [c.alias(p) for p, c in air_qc.size_order_flags(PM).items()])


@register("c10_air_check", f"SELECT station_id, {H0}, {', '.join(f'round({p}, 9) + 0.0 AS {p}, {p}_flag' for p in P)} FROM air_checked")
def air_check(spark, sf):
    return at_hour(checked(spark, sf), [*[r9(p).alias(p) for p in P], *[f"{p}_flag" for p in P]])


@register("e27_recent_flags", "SELECT station_id, pollutant, string_agg(DISTINCT flag, ',' ORDER BY flag) AS flags FROM (" + " UNION ALL ".join(
    f"SELECT station_id, '{p}' AS pollutant, {p}_flag AS flag FROM air_checked WHERE hour > (SELECT max(hour) - 24 FROM air_checked)" for p in P)
    + ") WHERE flag <> '' GROUP BY 1, 2")
def recent_flags(spark, sf):
    return air_qc.recent_flags(checked(spark, sf))


cte("air_clock", "SELECT c.station_id, c.hour, " + ", ".join(f"a.{p}" for p in IDX) + """ FROM
  (SELECT station_id, unnest(generate_series(min(hour), max(hour))) AS hour FROM air_checked GROUP BY 1) c LEFT JOIN air_checked a USING (station_id, hour)""")


def _back(n):
    return AW[:-1] + f" ROWS {n - 1} PRECEDING)"


cte("air_eight", "SELECT *, " + ", ".join(f"CASE WHEN count({p}) {_back(8)} >= 6 THEN avg({p}) {_back(8)} END AS {p}_8" for p in K.EIGHT_HOUR) + " FROM air_clock")
cte("air_averaged", "SELECT station_id, hour, " + ", ".join(
    f"max({p}_8) {_back(24)} AS {p}" if p in K.EIGHT_HOUR else f"CASE WHEN count({p}) {_back(24)} >= 16 THEN avg({p}) {_back(24)} END AS {p}" for p in IDX) + " FROM air_eight")


@register("f18_naqi_averaging", f"SELECT station_id, {H0}, {', '.join(f'round({p}, 9) + 0.0 AS {p}' for p in IDX)} FROM air_averaged")
def naqi_averaging(spark, sf):
    return at_hour(naqi.averaged(checked(spark, sf)), [r9(p).alias(p) for p in IDX])


cte("air_subs", "SELECT station_id, hour, " + ", ".join(f"{_sql_sub_index(p, p)} AS {p}" for p in IDX) + " FROM air_averaged")
_COUNT = " + ".join(f"CASE WHEN {p} IS NOT NULL THEN 1 ELSE 0 END" for p in IDX)
_TOP = f"greatest({', '.join(IDX)})"
# Compared after rounding to 9 digits, because the two engines' averages may differ in the last bit.
cte("naqi_rows", f"""
SELECT *, CASE WHEN enough THEN round_even(round(top, 9), 0) END AS aqi,
  CASE WHEN enough THEN CASE {' '.join(f"WHEN {p} = top THEN '{p}'" for p in IDX)} END ELSE '' END AS prominent_pollutant
FROM (SELECT *, {_TOP} AS top, ({_COUNT}) >= 3 AND (pm25 IS NOT NULL OR pm10 IS NOT NULL) AS enough FROM air_subs)""")


@register("c21_naqi", f"""
SELECT station_id, {H0}, {', '.join(f'round_even({p}, 0) + 0.0 AS si_{p}' for p in IDX)}, aqi, {sql_category('aqi')} AS category, prominent_pollutant FROM naqi_rows""")
def naqi_rows(spark, sf):
    return at_hour(
        naqi.naqi(naqi.averaged(checked(spark, sf))), [*[f"si_{p}" for p in IDX], "aqi", "category", "prominent_pollutant"]
    )


@register("e24_current_index", f"""
SELECT station_id, {H0}, aqi, {sql_category('aqi')} AS category, prominent_pollutant FROM naqi_rows WHERE aqi IS NOT NULL
QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY hour DESC) = 1""")
def current_index(spark, sf):
    out = naqi.current_index(naqi.naqi(naqi.averaged(checked(spark, sf))))
    return at_hour(out, ["aqi", "category", "prominent_pollutant"])


@register("f17_rolling_means", f"""
SELECT station_id, {H0}, round(CASE WHEN count(pm25) {_back(24)} >= 16 THEN avg(pm25) {_back(24)} END, 9) AS day_mean,
  round(CASE WHEN count(pm25) {_back(168)} >= 72 THEN avg(pm25) {_back(168)} END, 9) AS week_mean FROM air_clock""")
def rolling_means(spark, sf):
    clock = on_calendar(checked(spark, sf).select("station_id", "hour", "pm25"), "hour")

    def means(w):
        day, week = w.rowsBetween(-23, 0), w.rowsBetween(-167, 0)
        return {
            "day_mean": F.when(F.count("pm25").over(day) >= 16, F.avg("pm25").over(day)),
            "week_mean": F.when(F.count("pm25").over(week) >= 72, F.avg("pm25").over(week)),
        }

    out = framed(clock, ["station_id"], "hour", [means], before=167)
    return at_hour(out, [r9("day_mean").alias("day_mean"), r9("week_mean").alias("week_mean")])
