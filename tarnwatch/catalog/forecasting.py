"""Queries for forecast inputs."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_day, from_hour, hour_no
from tarnwatch.operators import air_features
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators.chunks import framed
from tarnwatch.operators.lineage import materialise
from tarnwatch.sources import tables

from . import airquality
from .intake import saturation
from .lakes import hourly, weather
from .oracle import cte
from .registry import register

S = K.LAKE_SENSORS
HW = "OVER (PARTITION BY station_id ORDER BY hour)"


def _rows(n):
    return HW[:-1] + f" ROWS {n - 1} PRECEDING)"


def hours(spark, sf):
    """The hourly clock as the daily run keeps it: a written table that several operators read."""
    return materialise(ff.working_hours(hourly(spark, sf)), "hours")


# The saturation polynomial cancels large terms, so engines agree on fewer digits there.
FEWER = {"do_deficit": 6}


def sql_cols(cols, digits=8):
    return ", ".join(f"round({c}, {FEWER.get(c, digits)}) + 0.0 AS {c}" for c in cols)


def cols8(cols, digits=8):
    return [(F.round(c, FEWER.get(c, digits)) + 0.0).alias(c) for c in cols]


cte("work_hours", "SELECT station_id, hour, temperature, ph, ln(1 + turbidity) AS turbidity, dissolved_oxygen FROM d_hour_grid")
DAYS = [f"day_{k}_{s}" for k in ("mean", "min", "max") for s in S]
cte("work_hour_stats", "SELECT *, " + ", ".join(
    f"CASE WHEN count({s}) {_rows(24)} >= 12 THEN {f}({s}) {_rows(24)} END AS day_{k}_{s}" for k, f in (("mean", "avg"), ("min", "min"), ("max", "max")) for s in S)
    + " FROM work_hours")


@register("f16_rolling_day", f'SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", {sql_cols(DAYS)} FROM work_hour_stats')
def rolling_day(spark, sf):
    return ff.rolling_day(hours(spark, sf)).select("station_id", from_hour(F.col("hour")).alias("timestamp"), *cols8(DAYS))


LAGS = [f"lag{k}_{s}" for k in K.LAGS_HOURS for s in S]


@register("f20_lags", 'SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", ' + ", ".join(
    f"round(lag({s}, {k}) {HW} - {s}, 8) + 0.0 AS lag{k}_{s}" for k in K.LAGS_HOURS for s in S) + " FROM work_hours")
def lags(spark, sf):
    def back(w):
        return {f"lag{k}_{s}": F.lag(s, k).over(w) - F.col(s) for k in K.LAGS_HOURS for s in S}

    out = framed(hours(spark, sf), ["station_id"], "hour", [back], before=24)
    return out.select("station_id", from_hour(F.col("hour")).alias("timestamp"), *cols8(LAGS))


@register("d18_same_hour_gather", """
SELECT a.station_id, make_timestamp(a.hour * 3600000000) AS origin, h.h AS horizon, round(b.dissolved_oxygen, 8) AS same_hour_last_day, round(c.dissolved_oxygen, 8) AS actual
FROM work_hours a CROSS JOIN (SELECT unnest([1, 24, 25, 47]) AS h) h LEFT JOIN work_hours b ON b.station_id = a.station_id AND b.hour = a.hour + h.h - 24 * CAST(ceil(h.h / 24.0) AS BIGINT)
LEFT JOIN work_hours c ON c.station_id = a.station_id AND c.hour = a.hour + h.h""")
def same_hour(spark, sf):
    rows = ff.around(hours(spark, sf)).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in (1, 24, 25, 47)])))
    same = F.get("_past", F.size("_past") - 1 - ff.same_hour_offset("horizon"))
    return rows.select(
        "station_id", from_hour(F.col("hour")).alias("origin"), "horizon",
        F.round(same["dissolved_oxygen"], 8).alias("same_hour_last_day"),
        F.round(F.get("_next", F.col("horizon") - 1)["dissolved_oxygen"], 8).alias("actual"),
    )


@register("f21_weather_windows", """
SELECT make_timestamp(hour * 3600000000) AS "timestamp", round(sum(rain_mm) OVER (ORDER BY hour ROWS 23 PRECEDING), 8) + 0.0 AS rain_24h,
  round(avg(cloud_cover) OVER (ORDER BY hour ROWS 11 PRECEDING), 8) + 0.0 AS cloud_12h FROM filled_weather""")
def weather_windows(spark, sf):
    w = weather(spark, sf)
    out = ff.weather_windows(w).join(w.select("hour"), "hour")
    return out.select(from_hour(F.col("hour")).alias("timestamp"), *cols8(["rain_24h", "cloud_12h"]))


cte("origin_hours", """
SELECT station_id, unnest(generate_series(min(hour) + 24, max(hour) - 48, 6)) AS hour FROM work_hours GROUP BY 1""")


@register("h16_forecast_origins", 'SELECT station_id, make_timestamp(hour * 3600000000) AS origin FROM origin_hours')
def forecast_origins(spark, sf):
    return ff.origin_hours(hours(spark, sf), 6).select("station_id", from_hour(F.col("hour")).alias("origin"))


HORIZONS = [1, 3, 12, 24, 36, 48]


@register("d17_origins_by_horizons", """
SELECT station_id, make_timestamp(hour * 3600000000) AS origin, h AS horizon, make_timestamp((hour + h) * 3600000000) AS target_time
FROM origin_hours CROSS JOIN (SELECT unnest([1, 3, 12, 24, 36, 48]) AS h)""")
def origins_by_horizons(spark, sf):
    rows = ff.origin_hours(hours(spark, sf), 6).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in HORIZONS])))
    return rows.select(
        "station_id", from_hour(F.col("hour")).alias("origin"), "horizon", from_hour(F.col("hour") + F.col("horizon")).alias("target_time")
    )


cte("h1_base", f"""
SELECT o.station_id, o.hour, h.h AS horizon, o.hour + h.h AS target_hour, {', '.join(f'n.{c}' for c in [*S, *DAYS])},
  {', '.join(f"(SELECT l.{s} FROM work_hours l WHERE l.station_id = o.station_id AND l.hour = o.hour - {k}) AS l{k}_{s}" for k in (1, 24) for s in S)},
  {', '.join(f'sh.{s} AS sh_{s}, t.{s} AS goal_{s}' for s in S)}
FROM origin_hours o CROSS JOIN (SELECT unnest([1, 3, 12, 24, 36, 48]) AS h) h JOIN work_hour_stats n USING (station_id, hour)
LEFT JOIN work_hours sh ON sh.station_id = o.station_id AND sh.hour = o.hour + h.h - 24 * CAST(ceil(h.h / 24.0) AS BIGINT)
LEFT JOIN work_hours t ON t.station_id = o.station_id AND t.hour = o.hour + h.h""")
cte("h1_weather", """
SELECT b.station_id, b.hour, b.horizon, sum(f.rain_mm) FILTER (f.hour BETWEEN b.hour - 23 AND b.hour) AS rain_past_24h,
  avg(f.cloud_cover) FILTER (f.hour BETWEEN b.hour - 11 AND b.hour) AS cloud_past_12h,
  avg(f.cloud_cover) FILTER (f.hour BETWEEN b.target_hour - 11 AND b.target_hour) AS cloud_before_target_12h,
  sum(f.rain_mm) FILTER (f.hour BETWEEN b.target_hour - 23 AND b.target_hour) AS rain_before_target_24h,
  max(f.air_temperature) FILTER (f.hour = b.target_hour) AS air_at_target, avg(f.air_temperature) FILTER (f.hour BETWEEN b.hour + 1 AND b.target_hour) AS air_mean_ahead
FROM h1_base b JOIN filled_weather f ON f.hour BETWEEN b.hour - 23 AND b.target_hour GROUP BY ALL""")
H1 = ["issue_hour_sin", "target_hour_cos", "do_deficit", *[f"{k}_{s}" for s in S for k in ("now", "lag1", "lag24", "day_mean", "day_min", "day_max", "same_hour_last_day", "target")],
      "rain_past_24h", "cloud_past_12h", "cloud_before_target_12h", "rain_before_target_24h", "air_at_target", "air_mean_ahead"]
_H1_SQL = {
    "issue_hour_sin": "sin(2 * pi() * (hour % 24) / 24)", "target_hour_cos": "cos(2 * pi() * (target_hour % 24) / 24)",
    "do_deficit": f"{saturation('temperature', 0.93)} - dissolved_oxygen",
    **{f"now_{s}": s for s in S}, **{f"lag{k}_{s}": f"l{k}_{s} - {s}" for k in (1, 24) for s in S},
    **{f"day_{k}_{s}": f"day_{k}_{s} - {s}" for k in ("mean", "min", "max") for s in S},
    **{f"same_hour_last_day_{s}": f"sh_{s} - {s}" for s in S}, **{f"target_{s}": f"goal_{s} - {s}" for s in S},
}


@register("h1_hourly_forecast_rows", 'SELECT b.station_id, make_timestamp(b.hour * 3600000000) AS origin, b.horizon, ' + ", ".join(
    f"round({_H1_SQL.get(c, c)}, {FEWER.get(c, 8)}) + 0.0 AS {c}" for c in H1) + " FROM h1_base b LEFT JOIN h1_weather w USING (station_id, hour, horizon)")
def hourly_forecast_rows(spark, sf):
    h = hours(spark, sf)
    rows = ff.hourly_rows(h, ff.origin_hours(h, 6), HORIZONS, weather(spark, sf))
    return rows.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", *cols8(H1))


cte("date_rows", """
SELECT station_id, hour // 24 AS day, CASE WHEN count(dissolved_oxygen) FILTER (hour % 24 < 9) >= 5 THEN min(dissolved_oxygen) FILTER (hour % 24 < 9) END AS night_min, """
    + ", ".join(f"avg({s}) FILTER (hour % 24 < 18) AS day_mean_{s}, max({s}) FILTER (hour % 24 = 18) AS issue_{s}" for s in S)
    + ", bool_or(hour % 24 = 18) AS issued FROM work_hours GROUP BY 1, 2")


@register("e12_night_minimum", 'SELECT station_id, make_timestamp(day * 86400000000) AS "date", round(night_min, 8) AS night_min FROM date_rows')
def night_minimum(spark, sf):
    return ff.date_table(hours(spark, sf)).select("station_id", from_day(F.col("day")).alias("date"), *cols8(["night_min"]))


cte("day_weather", """
SELECT *, sum(rain_day) OVER (ORDER BY day RANGE 2 PRECEDING) AS rain_3day FROM (
  SELECT hour // 24 AS day, avg(cloud_cover) FILTER (hour % 24 BETWEEN 6 AND 17) AS cloud_day, sum(rain_mm) AS rain_day, avg(air_temperature) AS air_day FROM filled_weather GROUP BY 1)""")
DW = ["cloud_day", "rain_day", "air_day", "rain_3day"]


@register("e13_daily_weather", f'SELECT make_timestamp(day * 86400000000) AS "date", {sql_cols(DW)} FROM day_weather')
def daily_weather(spark, sf):
    return ff.daily_weather(weather(spark, sf)).select(from_day(F.col("day")).alias("date"), *cols8(DW))


@register("f25_weekly_night_mean", """
SELECT station_id, make_timestamp(day * 86400000000) AS "date", round(CASE WHEN count(night_min) OVER w >= 4 THEN avg(night_min) OVER w END, 8) AS week_mean
FROM date_rows WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS 6 PRECEDING)""")
def weekly_night_mean(spark, sf):
    return ff.date_table(hours(spark, sf)).select("station_id", from_day(F.col("day")).alias("date"), *cols8(["week_mean"]))


cte("night_rows", f"""
SELECT i.station_id, i.day AS issue_day, a.a AS days_ahead, i.day + a.a AS night_of, i.night_min AS last_night_min,
  (SELECT night_min FROM date_rows p WHERE p.station_id = i.station_id AND p.day = i.day - 1) - i.night_min AS prev1_night_min,
  (SELECT night_min FROM date_rows p WHERE p.station_id = i.station_id AND p.day = i.day - 2) - i.night_min AS prev2_night_min,
  (SELECT CASE WHEN count(night_min) >= 4 THEN avg(night_min) END FROM date_rows p WHERE p.station_id = i.station_id AND p.day BETWEEN i.day - 6 AND i.day) - i.night_min AS week_mean_night_min,
  {saturation('i.issue_temperature', 0.93)} - i.issue_dissolved_oxygen AS do_deficit, {', '.join(f'i.issue_{s} AS now_{s}, i.day_mean_{s}' for s in S)},
  i.day_mean_temperature - (SELECT day_mean_temperature FROM date_rows p WHERE p.station_id = i.station_id AND p.day = i.day - 3) AS temperature_trend_3d,
  t.night_min - i.night_min AS night_min_change
FROM date_rows i JOIN (SELECT station_id, min(day) AS first_day FROM date_rows GROUP BY 1) f ON f.station_id = i.station_id AND i.day >= f.first_day + 7
CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS a) a LEFT JOIN date_rows t ON t.station_id = i.station_id AND t.day = i.day + a.a WHERE i.issued""")
H2 = ["last_night_min", "prev1_night_min", "prev2_night_min", "week_mean_night_min", "do_deficit", *[f"{k}_{s}" for s in S for k in ("now", "day_mean")],
      "temperature_trend_3d", "night_min_change", "cloud_day_today", "cloud_day_before_night", "rain_day_before_night", "rain_3day_before_night", "air_day_before_night"]


@register("h2_nightly_rows", f"""
SELECT n.station_id, make_timestamp(issue_day * 86400000000) AS issue_date, days_ahead, make_timestamp(night_of * 86400000000) AS night_of, {sql_cols(H2)}
FROM (SELECT r.*, t.cloud_day AS cloud_day_today, b.cloud_day AS cloud_day_before_night, b.rain_day AS rain_day_before_night, b.rain_3day AS rain_3day_before_night, b.air_day AS air_day_before_night
  FROM night_rows r LEFT JOIN day_weather t ON t.day = r.issue_day LEFT JOIN day_weather b ON b.day = r.night_of - 1) n""")
def nightly_rows(spark, sf):
    rows = ff.nightly_rows(hours(spark, sf), weather(spark, sf))
    return rows.select(
        "station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", from_day(F.col("night_of")).alias("night_of"), *cols8(H2)
    )


_DONE = " AND ".join(f"{s} IS NOT NULL" for s in S)
cte("latest_hours", f"""
SELECT station_id, hour FROM (SELECT station_id, max(hour) FILTER ({_DONE}) AS hour, max(hour) AS hi FROM work_hours GROUP BY 1) WHERE hi - hour <= 24""")


@register("f28_latest_complete_hour", 'SELECT station_id, make_timestamp(hour * 3600000000) AS latest FROM latest_hours')
def latest_complete(spark, sf):
    return ff.latest_complete_hour(hours(spark, sf)).select("station_id", from_hour(F.col("hour")).alias("latest"))


@register("h15_coming_nights", """
SELECT station_id, make_timestamp(d * 86400000000) AS issue_date, a AS days_ahead, make_timestamp((d + a) * 86400000000) AS night_of
FROM (SELECT station_id, hour, CASE WHEN hour % 24 >= 18 THEN hour // 24 ELSE hour // 24 - 1 END AS d FROM work_hours WHERE hour % 24 IN (3, 8, 10, 17, 18, 23))
CROSS JOIN (SELECT unnest(generate_series(1, 7)) AS a) WHERE (d + a) * 24 + 9 > hour""")
def coming_nights(spark, sf):
    picked = hours(spark, sf).filter("hour % 24 in (3, 8, 10, 17, 18, 23)").select("station_id", "hour")
    out = ff.coming_nights(picked)
    return out.select("station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", from_day(F.col("night_of")).alias("night_of"))


@register("h17_holdout_with_context", """
SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", round(m, 8) AS week_mean FROM (
  SELECT station_id, hour, avg(temperature) OVER (PARTITION BY station_id ORDER BY hour ROWS 167 PRECEDING) AS m, max(hour) OVER () AS hi FROM work_hours) WHERE hour > hi - 240""")
def holdout_with_context(spark, sf):
    from tarnwatch.operators.splits import holdout_with_context as split

    h = hours(spark, sf)

    def week(df):
        return framed(df, ["station_id"], "hour", [lambda w: {"week_mean": F.avg("temperature").over(w.rowsBetween(-167, 0))}], before=167)

    out = split(h, "hour", holdout=240, context=168, windowed=week)
    return out.select("station_id", from_hour(F.col("hour")).alias("timestamp"), *cols8(["week_mean"]))


def _sql_digits(name, first):
    return f"('0x' || substr(md5('42|{name}|' || station_id || '|' || hour || '|' || horizon), {first}, 13))::BIGINT"


def _sql_normal(name):
    return f"(sqrt(-2 * ln(({_sql_digits(name, 1)} + 1) / 4503599627370496.0::DOUBLE)) * cos(2 * pi() * {_sql_digits(name, 14)} / 4503599627370496.0::DOUBLE))"


NOISY = ["cloud_before_target_12h", "rain_before_target_24h", "air_at_target", "air_mean_ahead"]
_NOISY_SQL = {
    "cloud_before_target_12h": f"CASE WHEN cloud_before_target_12h IS NOT NULL THEN least(greatest(cloud_before_target_12h + {_sql_normal('cloud')} * (0.05 + 0.005 * horizon), 0.0), 1.0) END",
    "rain_before_target_24h": f"CASE WHEN rain_before_target_24h IS NULL THEN NULL WHEN {_sql_digits('missed', 1)} / 4503599627370496.0::DOUBLE < 0.05 + 0.004 * horizon THEN 0.0 ELSE rain_before_target_24h * exp({_sql_normal('rain')} * (0.3 + 0.01 * horizon)) END",
    "air_at_target": f"air_at_target + {_sql_normal('air')} * (0.3 + 0.03 * horizon)",
    "air_mean_ahead": f"air_mean_ahead + {_sql_normal('air_mean')} * (0.3 + 0.03 * horizon)",
}


@register("h14_noisy_weather", "SELECT station_id, make_timestamp(hour * 3600000000) AS origin, horizon, " + ", ".join(
    f"round({x}, 8) + 0.0 AS {c}" for c, x in _NOISY_SQL.items()) + " FROM (SELECT b.station_id, b.hour, b.horizon, " + ", ".join(f"w.{c}" for c in NOISY)
    + " FROM h1_base b LEFT JOIN h1_weather w USING (station_id, hour, horizon))")
def noisy_weather(spark, sf):
    h = hours(spark, sf)
    rows = ff.noisy_weather(ff.hourly_rows(h, ff.origin_hours(h, 6), HORIZONS, weather(spark, sf)))
    return rows.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", *cols8(NOISY))


# ---------------------------------------------------------------------------- air forecast rows

A = air_features.TARGETS
AW = "OVER (PARTITION BY station_id ORDER BY hour)"
cte("air_logs", "SELECT station_id, hour, " + ", ".join(f"ln(1 + CASE WHEN {t} IS NOT NULL THEN greatest({t}, 0) END) AS {t}" for t in A) + " FROM air_clock")


def _aw(n):
    return AW[:-1] + f" ROWS {n - 1} PRECEDING)"


cte("air_log_means", "SELECT *, " + ", ".join(
    f"CASE WHEN count({t}) {_aw(n)} >= {m} THEN ln(1 + avg(exp({t}) - 1) {_aw(n)}) END AS {k}_{t}" for t in A for k, n, m in (("day", 24, 16), ("week", 168, 72)))
    + " FROM air_logs")
cte("air_origins", "SELECT station_id, unnest(generate_series(min(hour) + 168, max(hour) - 48, 6)) AS hour FROM air_logs GROUP BY 1")
AIRW = air_features.WEATHER
cte("air_weather", 'SELECT epoch_us("timestamp") // 3600000000 AS hour, ' + ", ".join(AIRW) + " FROM weather_all")
cte("weather_all", "SELECT * FROM weather")
cte("h4_base", f"""
SELECT o.station_id, o.hour, h.h AS horizon, o.hour + h.h AS target_hour, {', '.join(f'n.{t}, n.day_{t}, n.week_{t}, l6.{t} AS l6_{t}, sh.{t} AS sh_{t}, g.{t} AS goal_{t}' for t in A)}
FROM air_origins o CROSS JOIN (SELECT unnest([1, 6, 24, 48]) AS h) h JOIN air_log_means n USING (station_id, hour)
LEFT JOIN air_logs l6 ON l6.station_id = o.station_id AND l6.hour = o.hour - 6
LEFT JOIN air_logs sh ON sh.station_id = o.station_id AND sh.hour = o.hour + h.h - 24 * CAST(ceil(h.h / 24.0) AS BIGINT)
LEFT JOIN air_logs g ON g.station_id = o.station_id AND g.hour = o.hour + h.h""")
H4 = ["target_weekend", *[f"{k}_{t}" for t in A for k in ("now", "lag6", "day_mean", "week_mean", "same_hour", "target")],
      *[f"{k}_{c}" for k in ("now", "target") for c in AIRW]]


def _sql_air_weather(prefix, clock):
    out = []
    for c in AIRW:
        if c == "rain_mm":
            out.append(f"coalesce((SELECT sum(rain_mm) FROM air_weather w WHERE w.hour BETWEEN b.{clock} - 5 AND b.{clock}), 0) AS {prefix}_{c}")
        elif c == "boundary_layer_height":
            out.append(f"(SELECT ln(greatest(max({c}), 10)) FROM air_weather w WHERE w.hour = b.{clock} HAVING count(*) > 0) AS {prefix}_{c}")
        else:
            out.append(f"(SELECT max({c}) FROM air_weather w WHERE w.hour = b.{clock}) AS {prefix}_{c}")
    return ", ".join(out)


cte("h4_rows", f"""
SELECT b.station_id, b.hour, b.horizon, CASE WHEN dayofweek(make_timestamp(b.target_hour * 3600000000)) IN (0, 6) THEN 1::DOUBLE ELSE 0::DOUBLE END AS target_weekend,
  {', '.join(f'b.{t} AS now_{t}, l6_{t} - b.{t} AS lag6_{t}, day_{t} - b.{t} AS day_mean_{t}, week_{t} - b.{t} AS week_mean_{t}, sh_{t} - b.{t} AS same_hour_{t}, goal_{t} - b.{t} AS target_{t}' for t in A)},
  {_sql_air_weather('now', 'hour')}, {_sql_air_weather('target', 'target_hour')} FROM h4_base b""")


def air_levels(spark, sf):
    return materialise(air_features.log_levels(airquality.checked(spark, sf)), "levels")


def air_weather(spark, sf):
    return tables.weather(spark, sf).withColumn("hour", hour_no(F.col("timestamp"))).drop("timestamp")


@register("h4_air_hourly_rows", f"SELECT station_id, make_timestamp(hour * 3600000000) AS origin, horizon, {sql_cols(H4)} FROM h4_rows")
def air_hourly_rows(spark, sf):
    levels = air_levels(spark, sf)
    origins = ff.origin_hours(levels, 6, history=168)
    rows = air_features.hourly_rows(levels, origins, [1, 6, 24, 48], air_weather(spark, sf))
    return rows.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", *cols8(H4))


cte("air_days", "SELECT station_id, hour // 24 AS day, " + ", ".join(f"CASE WHEN count({t}) >= 16 THEN ln(1 + avg(exp({t}) - 1)) END AS actual_{t}" for t in A) + " FROM air_logs GROUP BY 1, 2")
cte("air_day_weather", """
SELECT hour // 24 AS day, avg(wind_speed) AS day_wind_speed, avg(relative_humidity) AS day_relative_humidity, avg(air_temperature) AS day_air_temperature, sum(rain_mm) AS day_rain_mm,
  ln(greatest(max(boundary_layer_height), 10)) AS day_mixing_max, ln(greatest(min(boundary_layer_height), 10)) AS night_mixing_min FROM air_weather GROUP BY 1""")
H5 = ["target_weekend", *[f"{k}_{t}" for t in A for k in ("last24", "week_mean", "target")], "day_wind_speed", "day_relative_humidity", "day_air_temperature", "day_rain_mm",
      "day_mixing_max", "night_mixing_min"]
cte("h5_rows", f"""
SELECT i.station_id, i.hour // 24 AS issue_day, a.a AS days_ahead, CASE WHEN dayofweek(make_timestamp((i.hour // 24 + a.a) * 86400000000)) IN (0, 6) THEN 1::DOUBLE ELSE 0::DOUBLE END AS target_weekend,
  {', '.join(f'i.day_{t} AS last24_{t}, i.week_{t} - i.day_{t} AS week_mean_{t}, d.actual_{t} - i.day_{t} AS target_{t}, d.actual_{t}' for t in A)},
  w.* EXCLUDE (day, day_rain_mm), coalesce(w.day_rain_mm, 0) AS day_rain_mm
FROM air_log_means i JOIN (SELECT station_id, (min(hour) + 168) // 24 AS first_day FROM air_logs GROUP BY 1) f ON f.station_id = i.station_id AND i.hour // 24 >= f.first_day
CROSS JOIN (SELECT unnest([1, 2]) AS a) a LEFT JOIN air_days d ON d.station_id = i.station_id AND d.day = i.hour // 24 + a.a LEFT JOIN air_day_weather w ON w.day = i.hour // 24 + a.a WHERE i.hour % 24 = 18""")


@register("h5_air_daily_rows", f"SELECT station_id, make_timestamp(issue_day * 86400000000) AS issue_date, days_ahead, {sql_cols(H5)} FROM h5_rows")
def air_daily_rows(spark, sf):
    rows = air_features.daily_rows(air_levels(spark, sf), air_weather(spark, sf))
    return rows.select("station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", *cols8(H5))


# ---------------------------------------------------------------------------- key joins and set operations


@register("d11_full_outer_by_date", """
SELECT coalesce(m.station_id, n.station_id) AS station_id, make_timestamp(coalesce(m.day, n.day) * 86400000000) AS "date", round(m.nep, 7) + 0.0 AS nep, round(n.night_min, 7) AS night_min
FROM metabolism_days m FULL JOIN date_rows n USING (station_id, day)""")
def full_outer_by_date(spark, sf):
    from tarnwatch.operators.metabolism import daily_metabolism

    h = hourly(spark, sf)
    nights = ff.date_table(ff.working_hours(h)).select("station_id", "day", "night_min")
    out = daily_metabolism(h).select("station_id", "day", "nep").join(nights, ["station_id", "day"], "outer")
    return out.select("station_id", from_day(F.col("day")).alias("date"), *cols8(["nep", "night_min"], 7))
