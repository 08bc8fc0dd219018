"""Queries for metabolism and soft-sensor features."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_day, from_hour
from tarnwatch.functions.working import r9
from tarnwatch.operators import grid, metabolism, soft_features
from tarnwatch.operators.lineage import materialise
from tarnwatch.sources import tables

from .intake import saturation
from .oracle import cte
from .registry import register

S = K.LAKE_SENSORS
HW = "OVER (PARTITION BY station_id ORDER BY hour)"
DAY = 'make_timestamp(day * 86400000000) AS "date"'


def hourly(spark, sf):
    return grid.hourly_grid(tables.dense(spark, sf))


def weather(spark, sf):
    return grid.weather_grid(tables.weather_gappy(spark, sf), K.WEATHER_LAKE)


def dated(df, cols):
    return df.select("station_id", from_day(F.col("day")).alias("date"), *cols)


cte("lake_hours", f"SELECT *, {saturation('temperature', 0.93)} - dissolved_oxygen AS deficit, hour % 24 AS hod, hour // 24 AS day FROM d_hour_grid")
cte("oxygen_steps", f"""
SELECT * FROM (SELECT station_id, hour, hod, day, lead(dissolved_oxygen) {HW} - dissolved_oxygen AS change,
  (deficit + lead(deficit) {HW}) / 2 AS deficit, (temperature + lead(temperature) {HW}) / 2 AS temperature FROM lake_hours)
WHERE change IS NOT NULL AND deficit IS NOT NULL AND temperature IS NOT NULL""")
cte("night_sums", """
SELECT station_id, (hour + 3) // 24 AS day, count(*) AS n, sum(deficit) AS d, sum(change) AS c, sum(deficit * deficit) AS dd, sum(deficit * change) AS dc,
  avg(temperature) AS night_temperature FROM oxygen_steps WHERE hod >= 21 OR hod < 5 GROUP BY ALL HAVING count(*) >= 6""")
cte("pooled_nights", """
SELECT *, sum(dd - d * d / n) OVER w AS pdd, sum(dc - d * c / n) OVER w AS pdc FROM night_sums WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS 13 PRECEDING)""")
cte("night_k", "SELECT *, CASE WHEN pdd > 1e-9 AND pdc / pdd > 0 THEN pdc / pdd END AS k0 FROM pooled_nights")
cte("night_rates", """
SELECT station_id, day, reaeration, (reaeration * d - c) / n AS respiration, night_temperature FROM (
  SELECT *, CASE WHEN coalesce(k0, km) IS NOT NULL THEN least(coalesce(k0, km), 0.5) END AS reaeration FROM (
    SELECT *, median(k0) OVER (PARTITION BY station_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS km FROM night_k))""")
cte("light_days", """
SELECT s.station_id, s.day, count(s.change + r.respiration - r.reaeration * s.deficit) AS n, sum(s.change + r.respiration - r.reaeration * s.deficit) AS total
FROM oxygen_steps s LEFT JOIN night_rates r USING (station_id, day) WHERE s.hod >= 6 AND s.hod < 19 GROUP BY ALL""")
cte("day_swing", "SELECT station_id, day, max(dissolved_oxygen) - min(dissolved_oxygen) AS do_amplitude FROM lake_hours GROUP BY ALL")
cte("metabolism_days", """
SELECT coalesce(r.station_id, l.station_id) AS station_id, coalesce(r.day, l.day) AS day, r.reaeration, r.respiration, r.night_temperature, l.gpp, l.do_amplitude,
  l.gpp - 24 * r.respiration AS nep FROM night_rates r FULL JOIN (
  SELECT l.*, CASE WHEN n >= 9.1 THEN greatest(total, 0) END AS gpp, do_amplitude FROM light_days l JOIN day_swing USING (station_id, day)) l USING (station_id, day)""")
MET = ["reaeration", "respiration", "night_temperature", "gpp", "do_amplitude", "nep"]


@register("f26_hourly_oxygen_steps", """
SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", round(change, 9) + 0.0 AS change, round(deficit, 9) + 0.0 AS deficit, round(temperature, 9) AS temperature FROM oxygen_steps""")
def oxygen_steps(spark, sf):
    out = metabolism.hourly_changes(hourly(spark, sf))
    return out.select("station_id", from_hour(F.col("hour")).alias("timestamp"), *[r9(c).alias(c) for c in ("change", "deficit", "temperature")])


@register("e14_night_regression_sums", f"SELECT station_id, {DAY}, n, round(d, 8) + 0.0 AS d, round(c, 8) + 0.0 AS c, round(dd, 8) AS dd, round(dc, 8) + 0.0 AS dc FROM night_sums")
def night_sums(spark, sf):
    out = metabolism.night_sums(metabolism.hourly_changes(hourly(spark, sf)))
    return dated(out, ["n", *[(F.round(c, 8) + 0.0).alias(c) for c in ("d", "c", "dd", "dc")]])


@register("e15_reaeration", f"SELECT station_id, {DAY}, round(reaeration, 8) AS reaeration, round(respiration, 8) + 0.0 AS respiration FROM night_rates")
def reaeration(spark, sf):
    out = metabolism.nightly_rates(metabolism.night_sums(metabolism.hourly_changes(hourly(spark, sf))))
    return dated(out, [F.round("reaeration", 8).alias("reaeration"), (F.round("respiration", 8) + 0.0).alias("respiration")])


@register("e16_daily_metabolism", f"SELECT station_id, {DAY}, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in MET)} FROM metabolism_days")
def daily_metabolism(spark, sf):
    return dated(metabolism.daily_metabolism(hourly(spark, sf)), [(F.round(c, 7) + 0.0).alias(c) for c in MET])


@register("e25_last_three_days", f"""
SELECT station_id, {DAY}, round(avg(gpp) OVER w, 7) AS gpp, round(avg(nep) OVER w, 7) + 0.0 AS nep, round(avg(do_amplitude) OVER w, 7) AS do_amplitude
FROM metabolism_days WHERE gpp IS NOT NULL AND nep IS NOT NULL AND do_amplitude IS NOT NULL WINDOW w AS (PARTITION BY station_id ORDER BY day ROWS 2 PRECEDING)""")
def last_three_days(spark, sf):
    out = soft_features.recent_metabolism(metabolism.daily_metabolism(hourly(spark, sf)), soft_features.DAY_FEATURES)
    return dated(out, [(F.round(c, 7) + 0.0).alias(c) for c in soft_features.DAY_FEATURES])


cte("lab_hours", 'SELECT src_ord, station_id, "timestamp", bod, chlorophyll_a, total_coliform, epoch_us("timestamp") // 3600000000 AS hour, epoch_us("timestamp") // 86400000000 AS day, hour("timestamp") AS hod FROM lab')


def _lw(s):
    return f"ln(1 + h.{s})" if s == "turbidity" else f"h.{s}"


cte("sample_windows", "SELECT l.src_ord, l.station_id, l.hour, l.day, l.hod, count(CASE WHEN " + " AND ".join(f"h.{s} IS NOT NULL" for s in S)
    + " THEN 1 END) AS complete, " + ", ".join(
    f"arg_max({_lw(s)}, h.hour) FILTER (h.{s} IS NOT NULL) AS now_{s}, avg({_lw(s)}) AS mean_{s}, min({_lw(s)}) AS min_{s}, max({_lw(s)}) AS max_{s}" for s in S)
    + """, avg(h.deficit) AS mean_do_deficit FROM lab_hours l JOIN lake_hours h ON h.station_id = l.station_id AND h.hour BETWEEN l.hour - 24 AND l.hour - 1
GROUP BY l.src_ord, l.station_id, l.hour, l.day, l.hod HAVING complete >= 16.8""")


cte("sample_feats", f"""
SELECT w.*, n.respiration, n.reaeration, n.night_temperature, d.gpp, d.nep, d.do_amplitude, ln(CASE WHEN n.respiration IS NOT NULL THEN greatest(n.respiration, 1e-3) END) AS log_respiration,
  rn.rain_72h, rn.rain_24h, rn.rain_7d, cl.cloud_24h, least(coalesce(w.hour - dr.wet, 336), 336)::DOUBLE AS hours_since_rain
FROM sample_windows w
LEFT JOIN (SELECT src_ord, avg(respiration) AS respiration, avg(reaeration) AS reaeration, avg(night_temperature) AS night_temperature FROM (
  SELECT w.src_ord, m.*, row_number() OVER (PARTITION BY w.src_ord ORDER BY m.day DESC) AS rk FROM sample_windows w JOIN metabolism_days m ON m.station_id = w.station_id
   AND m.day <= w.day - CASE WHEN w.hod >= 5 THEN 0 ELSE 1 END AND m.respiration IS NOT NULL AND m.reaeration IS NOT NULL AND m.night_temperature IS NOT NULL) WHERE rk <= 3 GROUP BY 1) n USING (src_ord)
LEFT JOIN (SELECT src_ord, avg(gpp) AS gpp, avg(nep) AS nep, avg(do_amplitude) AS do_amplitude FROM (
  SELECT w.src_ord, m.*, row_number() OVER (PARTITION BY w.src_ord ORDER BY m.day DESC) AS rk FROM sample_windows w JOIN metabolism_days m ON m.station_id = w.station_id
   AND m.day <= w.day - 1 AND m.gpp IS NOT NULL AND m.nep IS NOT NULL AND m.do_amplitude IS NOT NULL) WHERE rk <= 3 GROUP BY 1) d USING (src_ord)
LEFT JOIN (SELECT w.src_ord, sum(f.rain_mm) FILTER (f.hour >= w.hour - 24) AS rain_24h, sum(f.rain_mm) FILTER (f.hour >= w.hour - 72) AS rain_72h, sum(f.rain_mm) AS rain_7d
  FROM sample_windows w JOIN filled_weather f ON f.hour BETWEEN w.hour - 168 AND w.hour - 1 GROUP BY 1) rn USING (src_ord)
LEFT JOIN (SELECT w.src_ord, avg(f.cloud_cover) AS cloud_24h FROM sample_windows w JOIN filled_weather f ON f.hour BETWEEN w.hour - 24 AND w.hour - 1 GROUP BY 1) cl USING (src_ord)
LEFT JOIN (SELECT w.src_ord, max(f.hour) AS wet FROM sample_windows w JOIN filled_weather f ON f.hour < w.hour AND f.rain_mm >= 1 GROUP BY 1) dr USING (src_ord)""")
BASE = [*[f"{k}_{s}" for s in S for k in ("now", "mean", "min", "max")], "mean_do_deficit", "respiration", "reaeration", "night_temperature",
        "gpp", "nep", "do_amplitude", "log_respiration", "rain_72h", "cloud_24h"]


def features(spark, sf):
    samples = tables.lab(spark, sf).select("src_ord", "station_id", "timestamp")
    return soft_features.sample_features(samples, materialise(hourly(spark, sf), "hourly"), weather(spark, sf))


def _seven(cols):
    return [(F.round(c, 7) + 0.0).alias(c) for c in cols]


@register("h8_sample_features", f"SELECT src_ord, station_id, {', '.join(f'round({c}, 7) + 0.0 AS {c}' for c in BASE)} FROM sample_feats")
def sample_features(spark, sf):
    return features(spark, sf).select("src_ord", "station_id", *_seven(BASE))


@register("h9_algae_extras", """
SELECT src_ord, round(ln(CASE WHEN gpp IS NOT NULL THEN greatest(gpp, 1e-3) END), 7) + 0.0 AS log_gpp, round(max_ph - min_ph, 7) AS swing_ph FROM sample_feats""")
def algae_extras(spark, sf):
    return soft_features.algae_extras(features(spark, sf)).select("src_ord", *_seven(["log_gpp", "swing_ph"]))


COLI = ["rain_24h", "rain_7d", "hours_since_rain", "log_rain_24h", "log_rain_72h", "log_rain_7d", "log_hours_since_rain"]


@register("h10_rain_timing", """
SELECT src_ord, round(rain_24h, 7) + 0.0 AS rain_24h, round(rain_7d, 7) + 0.0 AS rain_7d, hours_since_rain, round(ln(1 + rain_24h), 7) + 0.0 AS log_rain_24h,
  round(ln(1 + rain_72h), 7) + 0.0 AS log_rain_72h, round(ln(1 + rain_7d), 7) + 0.0 AS log_rain_7d, round(ln(1 + hours_since_rain), 7) + 0.0 AS log_hours_since_rain FROM sample_feats""")
def rain_timing(spark, sf):
    return soft_features.coliform_extras(features(spark, sf)).select("src_ord", *_seven(COLI))


@register("f23_hours_since_rain", """
SELECT make_timestamp(t.hour * 3600000000) AS "timestamp", least(coalesce(t.hour + 1 - max(s.hour), 336), 336)::DOUBLE AS hours_since_rain
FROM filled_weather t LEFT JOIN filled_weather s ON s.hour <= t.hour AND s.rain_mm >= 1 GROUP BY t.hour""")
def hours_since_rain(spark, sf):
    w = weather(spark, sf)
    out = soft_features.rain_features(w).join(w.select("hour"), "hour")
    return out.select(from_hour(F.col("hour")).alias("timestamp"), "hours_since_rain")


@register("f24_rain_sums", """
SELECT make_timestamp(t.hour * 3600000000) AS "timestamp", round(sum(rain_mm) OVER (ORDER BY hour ROWS 23 PRECEDING), 9) + 0.0 AS rain_24h,
  round(sum(rain_mm) OVER (ORDER BY hour ROWS 71 PRECEDING), 9) + 0.0 AS rain_72h, round(sum(rain_mm) OVER (ORDER BY hour ROWS 167 PRECEDING), 9) + 0.0 AS rain_7d FROM filled_weather t""")
def rain_sums(spark, sf):
    w = weather(spark, sf)
    out = soft_features.rain_features(w).join(w.select("hour"), "hour")
    return out.select(from_hour(F.col("hour")).alias("timestamp"), *[r9(c).alias(c) for c in ("rain_24h", "rain_72h", "rain_7d")])


@register("h11_estimate_times", """
SELECT station_id, ts AS "timestamp" FROM (SELECT station_id, lo, hi, unnest(generate_series(date_trunc('day', lo), date_trunc('day', hi), INTERVAL 1 DAY)) + INTERVAL 10 HOUR AS ts
  FROM (SELECT station_id, make_timestamp(min(hour) * 3600000000) + INTERVAL 4 DAY AS lo, make_timestamp(max(hour) * 3600000000) AS hi FROM d_hour_grid GROUP BY 1)) WHERE ts BETWEEN lo AND hi""")
def estimate_times(spark, sf):
    return soft_features.estimate_times(hourly(spark, sf))


@register("d15_covered_samples", "SELECT src_ord, station_id FROM sample_windows")
def covered_samples(spark, sf):
    samples = tables.lab(spark, sf).select("src_ord", "station_id", "timestamp")
    return soft_features.covered_samples(samples, hourly(spark, sf)).select("src_ord", "station_id")
