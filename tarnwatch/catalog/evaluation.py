"""Queries for calibration and scores."""

import math

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import odds, water
from tarnwatch.functions.clock import from_day, from_hour
from tarnwatch.functions.parse import parse_numeric
from tarnwatch.functions.working import r9
from tarnwatch.operators import blending, calibration, scoring
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators.chunks import framed
from tarnwatch.operators.lab import clean_lab, lab_report, with_previous
from tarnwatch.operators.lineage import materialise
from tarnwatch.sources import readers, tables

from .forecasting import air_levels, cols8, hours
from .grading import _TROPHIC, _WHO, _WQI_CLASS, sql_category, _sql_sub_index, wqi_rows
from .oracle import cte
from .registry import register

S = K.LAKE_SENSORS
FS = ["temperature", "dissolved_oxygen"]
HZ = [1, 2, 6, 12, 24, 30, 48]
HW = "OVER (PARTITION BY station_id ORDER BY hour ROWS 23 PRECEDING)"


def forecasts(spark, sf):
    """A simple forecaster's table: the day's mean, plus and minus its standard deviation, for two sensors."""
    h = hours(spark, sf)

    def spread(w):
        day = w.rowsBetween(-23, 0)
        return {f"sd_{s}": F.stddev_samp(s).over(day) for s in FS} | {f"mid_{s}": F.avg(s).over(day) for s in FS}

    base = framed(h, ["station_id"], "hour", [spread], before=23)
    rows = ff.around(h, lags=[]).join(base.select("station_id", "hour", *[f"{k}_{s}" for s in FS for k in ("sd", "mid")]), ["station_id", "hour"])
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(x) for x in HZ])))
    same, goal = F.get("_past", F.size("_past") - 1 - ff.same_hour_offset("horizon")), F.get("_next", F.col("horizon") - 1)

    def one(s):
        mid, sd = F.col(f"mid_{s}"), F.col(f"sd_{s}")
        return F.struct(
            F.lit(s).alias("sensor"), (mid - sd).alias("lo"), mid.alias("mid"), (mid + sd).alias("hi"), goal[s].alias("actual"),
            F.col(s).alias("persistence"), same[s].alias("same_hour_last_day"),
        )

    out = rows.select("station_id", "hour", "horizon", F.explode(F.array(*[one(s) for s in FS])).alias("f"))
    return out.select("station_id", "hour", "horizon", (F.col("hour") + F.col("horizon")).alias("target_hour"), "f.*")


cte("fc_base", "SELECT station_id, hour, " + ", ".join(f"{s}, avg({s}) {HW} AS mid_{s}, stddev_samp({s}) {HW} AS sd_{s}" for s in FS) + " FROM work_hours")
cte("fc", " UNION ALL ".join(f"""
SELECT b.station_id, b.hour, h.h AS horizon, b.hour + h.h AS target_hour, '{s}' AS sensor, mid_{s} - sd_{s} AS lo, mid_{s} AS mid, mid_{s} + sd_{s} AS hi,
  t.{s} AS actual, b.{s} AS persistence, p.{s} AS same_hour_last_day
FROM fc_base b CROSS JOIN (SELECT unnest([1, 2, 6, 12, 24, 30, 48]) AS h) h LEFT JOIN work_hours t ON t.station_id = b.station_id AND t.hour = b.hour + h.h
LEFT JOIN work_hours p ON p.station_id = b.station_id AND p.hour = b.hour + h.h - 24 * CAST(ceil(h.h / 24.0) AS BIGINT)""" for s in FS))


def sql_bucket(buckets, h="horizon"):
    return "CASE " + " ".join(f"WHEN {h} BETWEEN {a} AND {b} THEN '{a}-{b}h'" for a, b in buckets) + " ELSE '' END"


cte("fc_bucketed", f"SELECT *, {sql_bucket(K.LAKE_BUCKETS)} AS bucket FROM fc")
_KNOWN = "actual IS NOT NULL AND lo IS NOT NULL AND hi IS NOT NULL"


def _sql_offsets(table, keys, where="true"):
    """The order statistic at rank ceil(level * (n - 1)), by row number."""
    return f"""
SELECT {keys}, score AS "offset" FROM (
  SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY score) - 1 AS rk, count(*) OVER (PARTITION BY {keys}) AS n
  FROM (SELECT *, greatest(lo - actual, actual - hi) AS score FROM {table} WHERE {_KNOWN} AND ({where})))
WHERE n >= 30 AND rk = CAST(ceil(least(1.0::DOUBLE, ceil((n + 1) * 0.8::DOUBLE) / n) * (n - 1)) AS BIGINT)"""


cte("fc_offsets", _sql_offsets("fc_bucketed", "sensor, bucket"))


def fit(spark, sf):
    return calibration.fit_offsets(calibration.bucketed(forecasts(spark, sf)), ["sensor", "bucket"])


@register("e17_conformal_offsets", 'SELECT sensor, bucket, round("offset", 9) + 0.0 AS "offset" FROM fc_offsets')
def conformal_offsets(spark, sf):
    return fit(spark, sf).select("sensor", "bucket", r9("offset").alias("offset"))


@register("e17_small_groups_keep_theirs", """
SELECT sensor, horizon, round(coalesce(n."offset", 0.25::DOUBLE), 9) + 0.0 AS "offset" FROM (SELECT DISTINCT sensor, horizon FROM fc)
LEFT JOIN (""" + _sql_offsets("fc", "sensor, horizon", "hour % 37 = 0 AND horizon <> 2 OR horizon = 2") + ") n USING (sensor, horizon)")
def small_groups(spark, sf):
    fc = forecasts(spark, sf)
    old = fc.select("sensor", "horizon").distinct().withColumn("offset", F.lit(0.25))
    few = fc.filter("hour % 37 = 0 and horizon <> 2 or horizon = 2")
    out = calibration.refreshed(old, calibration.fit_offsets(few, ["sensor", "horizon"]), ["sensor", "horizon"])
    return out.select("sensor", "horizon", r9("offset").alias("offset"))


@register("e18_widened_ranges", """
SELECT f.station_id, make_timestamp(f.hour * 3600000000) AS origin, f.horizon, f.sensor, round(least(lo - coalesce("offset", 0), mid), 8) + 0.0 AS lo, round(mid, 8) AS mid, round(greatest(hi + coalesce("offset", 0), mid), 8) AS hi
FROM fc_bucketed f LEFT JOIN fc_offsets o USING (sensor, bucket) WHERE lo IS NOT NULL AND mid IS NOT NULL""")
def widened(spark, sf):
    fc = calibration.bucketed(forecasts(spark, sf))
    out = calibration.apply_offsets(fc, materialise(fit(spark, sf), "offsets"), ["sensor", "bucket"]).filter("lo is not null")
    return out.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", "sensor", *cols8(["lo", "mid", "hi"]))


def sql_below(t, lo="lo", mid="mid", hi="hi"):
    return (
        f"least(greatest(CASE WHEN {t} <= {mid} THEN 0.5 - ({mid} - {t}) * ((0.5::DOUBLE - 0.1::DOUBLE) / greatest({mid} - {lo}, 1e-9)) "
        f"ELSE 0.5 + ({t} - {mid}) * ((0.9::DOUBLE - 0.5::DOUBLE) / greatest({hi} - {mid}, 1e-9)) END, 0), 1)"
    )


@register("e19_prob_below", f"""
SELECT station_id, make_timestamp(hour * 3600000000) AS origin, horizon, round({sql_below('6.5')}, 8) + 0.0 AS p FROM fc
WHERE sensor = 'dissolved_oxygen' AND lo IS NOT NULL AND mid IS NOT NULL AND hi IS NOT NULL""")
def prob_below(spark, sf):
    fc = forecasts(spark, sf).filter("sensor = 'dissolved_oxygen' and lo is not null")
    p = odds.prob_below(6.5, "lo", "mid", "hi")
    return fc.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", (F.round(p, 8) + 0.0).alias("p"))


@register("e21_averaged_quantiles", """
SELECT sensor, horizon, round(avg(lo), 8) AS lo, round(avg(mid), 8) AS mid, round(avg(hi), 8) AS hi FROM fc GROUP BY 1, 2""")
def averaged_quantiles(spark, sf):
    return calibration.averaged_quantiles(forecasts(spark, sf), ["sensor", "horizon"]).select("sensor", "horizon", *cols8(["lo", "mid", "hi"]))


@register("e22_sorted_quantiles", """
SELECT src_ord, q[1] AS lo, q[2] AS mid, q[3] AS hi FROM (SELECT src_ord, list_sort([p_bod_2, p_bod_3, p_coliform_50]) AS q FROM graded_rows)""")
def sorted_quantiles(spark, sf):
    df = tables.graded_rows(spark, sf).select("src_ord", F.col("p_bod_2").alias("lo"), F.col("p_bod_3").alias("mid"), F.col("p_coliform_50").alias("hi"))
    return calibration.sorted_quantiles(df)


# ---------------------------------------------------------------------------- weekly recalibration

WEEK0 = "(SELECT min(hour) + 240 FROM work_hours)"


cte("wk_listed", f"""
SELECT w.week, f.* FROM (SELECT unnest(generate_series(0, (SELECT (max(hour) - {WEEK0}) // 168 FROM work_hours))) AS week) w JOIN fc_bucketed f
ON f.hour >= {WEEK0} + w.week * 168 - 720 AND f.hour < {WEEK0} + w.week * 168 - 48""")
cte("wk_found", _sql_offsets("wk_listed", "week, sensor, bucket"))


@register("k8_weekly_offsets", f"""
SELECT week, sensor, bucket, round("offset", 9) + 0.0 AS "offset" FROM (
  SELECT week, sensor, bucket, last_value("offset" IGNORE NULLS) OVER (PARTITION BY sensor, bucket ORDER BY week) AS "offset"
  FROM (SELECT DISTINCT sensor, bucket FROM wk_found) CROSS JOIN (SELECT unnest(generate_series(0, (SELECT (max(hour) - {WEEK0}) // 168 FROM work_hours))) AS week) LEFT JOIN wk_found USING (week, sensor, bucket))
WHERE "offset" IS NOT NULL""")
def weekly_offsets(spark, sf):
    fc = calibration.bucketed(forecasts(spark, sf))
    first, last = hours(spark, sf).agg(F.min("hour"), F.max("hour")).first()
    out = calibration.weekly_offsets(fc, ["sensor", "bucket"], "hour", first + 240, last + 1)
    return out.select("week", "sensor", "bucket", r9("offset").alias("offset"))


@register("j18_refresh_gate", """
SELECT max(hour) + 1 - 720 > 473300 AS refresh FROM work_hours""")
def refresh_gate(spark, sf):
    return calibration.needs_refresh(hours(spark, sf), "hour", 473300)


# ---------------------------------------------------------------------------- forecast scores

_J1 = f"""
SELECT sensor, {{extra}}{sql_bucket(K.LAKE_BUCKETS)} AS bucket, avg(abs(mid - actual)) AS m, avg(abs(persistence - actual)) AS p,
  avg(abs(coalesce(same_hour_last_day, persistence) - actual)) AS s, avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS c, avg(hi - lo) AS w
FROM fc WHERE actual IS NOT NULL GROUP BY ALL"""


@register("j1_hourly_report", f"""
SELECT sensor, bucket, round(m, 4) AS mae, round(p, 4) AS mae_persistence, round(s, 4) AS mae_same_hour_yesterday, round(1 - m / least(p, s), 3) AS skill,
  round(c, 3) AS coverage_80, round(w, 4) AS mean_width FROM ({_J1.replace('{extra}', '')})""")
def hourly_report(spark, sf):
    return scoring.hourly_report(forecasts(spark, sf))


@register("j2_relative_error", """
SELECT round(avg(r), 8) AS relative_error FROM (SELECT sensor, avg(abs(mid - actual)) / avg(abs(persistence - actual)) AS r FROM fc WHERE actual IS NOT NULL GROUP BY 1)""")
def relative_error(spark, sf):
    return scoring.relative_error(forecasts(spark, sf)).select(*cols8(["relative_error"]))


cte("candidates", """
SELECT 'day_mean' AS model, * FROM fc UNION ALL SELECT 'same_hour' AS model, station_id, hour, horizon, target_hour, sensor, lo, coalesce(same_hour_last_day, persistence) AS mid, hi, actual, persistence, same_hour_last_day FROM fc""")


@register("k9_model_choice", """
SELECT arg_min(model, relative_error) AS model, round(min(relative_error), 8) AS relative_error FROM (
  SELECT model, avg(r) AS relative_error FROM (SELECT model, sensor, avg(abs(mid - actual)) / avg(abs(persistence - actual)) AS r FROM candidates WHERE actual IS NOT NULL
   AND hour < (SELECT max(hour) - 240 FROM work_hours) GROUP BY 1, 2) GROUP BY 1)""")
def model_choice(spark, sf):
    fc = forecasts(spark, sf)
    cut = hours(spark, sf).select((F.max("hour") - 240).alias("c")).scalar()
    fc = fc.filter(F.col("hour") < cut)
    other = fc.withColumn("mid", F.coalesce("same_hour_last_day", "persistence"))
    both = fc.withColumn("model", F.lit("day_mean")).unionByName(other.withColumn("model", F.lit("same_hour")))
    scores = scoring.relative_error(both, ["model"])
    return scores.agg(F.min_by("model", "relative_error").alias("model"), F.round(F.min("relative_error"), 8).alias("relative_error"))


cte("nightly_fc", f"""
SELECT *, {sql_below('6.0')} AS p_below_alert FROM (
  SELECT station_id, issue_day, days_ahead, night_of, last_night_min AS last_night, last_night_min + week_mean_night_min AS week_mean, last_night_min + night_min_change AS actual,
    last_night_min - 0.15 * days_ahead AS lo, last_night_min + 0.05 AS mid, last_night_min + 0.05 + 0.2 * days_ahead AS hi FROM night_rows) WHERE last_night IS NOT NULL""")


def nightly_forecasts(spark, sf):
    rows = ff.nightly_rows(hours(spark, sf)).filter("last_night_min is not null")
    last, d = F.col("last_night_min"), F.col("days_ahead")
    out = rows.select(
        "station_id", "issue_day", "days_ahead", "night_of", last.alias("last_night"), (last + F.col("week_mean_night_min")).alias("week_mean"),
        (last + F.col("night_min_change")).alias("actual"), (last - d * 0.15).alias("lo"), (last + 0.05).alias("mid"), (last + 0.05 + d * 0.2).alias("hi"),
    )
    return out.withColumn("p_below_alert", odds.prob_below(6.0, "lo", "mid", "hi"))


def _sql_alerts(table, keys, p, alert, event):
    return f"""
SELECT {keys}, count(*) FILTER ({event}) AS events, count(*) FILTER ({alert} AND {event}) AS hits, count(*) FILTER (NOT ({alert}) AND {event}) AS misses,
  count(*) FILTER ({alert} AND NOT ({event})) AS false_alarms, avg(power({p} - CASE WHEN {event} THEN 1 ELSE 0 END, 2)) AS brier, avg(CASE WHEN {event} THEN 1.0 ELSE 0.0 END) AS base
FROM {table} GROUP BY {keys}"""


_ALERT_COLS = """events, hits, misses, false_alarms, round(hits / nullif(hits + misses, 0)::DOUBLE, 3) AS probability_of_detection,
  round(false_alarms / nullif(hits + false_alarms, 0)::DOUBLE, 3) AS false_alarm_ratio, round(hits / nullif(hits + misses + false_alarms, 0)::DOUBLE, 3) AS critical_success_index,
  round(brier, 4) AS brier_score, round(CASE WHEN base * (1 - base) > 0 THEN 1 - brier / (base * (1 - base)) END, 3) AS brier_skill"""
cte("nightly_grouped", """
SELECT 'all' AS lead_group, * FROM nightly_fc WHERE actual IS NOT NULL UNION ALL
SELECT CASE WHEN days_ahead <= 2 THEN '1-2 days' WHEN days_ahead <= 4 THEN '3-4 days' ELSE '5-7 days' END, * FROM nightly_fc WHERE actual IS NOT NULL""")


@register("j4_nightly_alert_scores", f"SELECT lead_group, {_ALERT_COLS} FROM ({_sql_alerts('nightly_grouped', 'lead_group', 'p_below_alert', 'p_below_alert >= 0.5', 'actual < 6.0')})")
def nightly_alerts(spark, sf):
    return scoring.nightly_alert_scores(nightly_forecasts(spark, sf), threshold=6.0)


@register("j3_alert_scores", f"SELECT station_id, {_ALERT_COLS} FROM ({_sql_alerts('nightly_fc', 'station_id', 'p_below_alert', 'p_below_alert >= 0.5', 'last_night < 5.9')})")
def alert_scores(spark, sf):
    return scoring.alert_scores(nightly_forecasts(spark, sf), ["station_id"], "p_below_alert", F.col("p_below_alert") >= 0.5, F.col("last_night") < 5.9)


@register("j1_nightly_report", """
SELECT days_ahead, round(m, 3) AS mae, round(l, 3) AS mae_last_night, round(w, 3) AS mae_week_mean, round(1 - m / least(l, w), 3) AS skill, round(c, 3) AS coverage_80 FROM (
  SELECT days_ahead, avg(abs(mid - actual)) AS m, avg(abs(last_night - actual)) AS l, avg(abs(coalesce(week_mean, last_night) - actual)) AS w,
    avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END) AS c FROM nightly_fc WHERE actual IS NOT NULL GROUP BY 1)""")
def nightly_report(spark, sf):
    return scoring.nightly_report(nightly_forecasts(spark, sf))


cte("oxygen_path", "SELECT station_id, hour, target_hour, lo, mid, hi FROM fc WHERE sensor = 'dissolved_oxygen' AND lo IS NOT NULL")


@register("h3_night_minimum_from_path", """
SELECT n.station_id, make_timestamp(n.issue_day * 86400000000) AS issue_date, n.days_ahead,
  round(CASE WHEN use THEN p.lo ELSE n.lo END, 8) AS lo, round(CASE WHEN use THEN p.mid ELSE n.mid END, 8) AS mid, round(CASE WHEN use THEN p.hi ELSE n.hi END, 8) AS hi
FROM (SELECT n.*, p.lo IS NOT NULL AND n.night_of * 24 + 8 <= n.issue_day * 24 + 18 + 48 AS use, p.lo AS plo, p.mid AS pmid, p.hi AS phi
  FROM nightly_fc n LEFT JOIN (SELECT station_id, hour, target_hour // 24 AS night_of, min(lo) AS lo, min(mid) AS mid, min(hi) AS hi FROM oxygen_path WHERE target_hour % 24 < 9 GROUP BY 1, 2, 3) p
  ON p.station_id = n.station_id AND p.hour = n.issue_day * 24 + 18 AND p.night_of = n.night_of) n, LATERAL (SELECT n.plo AS lo, n.pmid AS mid, n.phi AS hi) p""")
def night_minimum_from_path(spark, sf):
    path = forecasts(spark, sf).filter("sensor = 'dissolved_oxygen' and lo is not null").select("station_id", "hour", "target_hour", "lo", "mid", "hi")
    out = blending.prefer_path(nightly_forecasts(spark, sf), path)
    return out.select("station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", *cols8(["lo", "mid", "hi"]))


# ---------------------------------------------------------------------------- air forecasts

cte("air_fc_base", "SELECT station_id, hour, pm25, pm10, day_pm25, day_pm10 FROM air_log_means")
cte("air_fc", " UNION ALL ".join(f"""
SELECT b.station_id, b.hour, h.h AS horizon, b.hour + h.h AS target_hour, '{t}' AS pollutant, exp(day_{t} - 0.5) - 1 AS lo, exp(day_{t}) - 1 AS mid, exp(day_{t} + 0.5) - 1 AS hi,
  exp(g.{t}) - 1 AS actual, exp(b.{t}) - 1 AS persistence
FROM air_fc_base b CROSS JOIN (SELECT unnest([1, 6, 12, 24, 36, 48]) AS h) h LEFT JOIN air_logs g ON g.station_id = b.station_id AND g.hour = b.hour + h.h""" for t in ("pm25", "pm10")))


def air_forecasts(spark, sf):
    from tarnwatch.operators import air_features

    row = F.struct("pm25", "pm10")
    rows = air_features.level_means(air_levels(spark, sf), extra=[lambda w: {"_next": F.collect_list(row).over(w.rowsBetween(1, 48))}])
    rows = rows.withColumn("horizon", F.explode(F.array(*[F.lit(x) for x in (1, 6, 12, 24, 36, 48)])))
    goal = F.get("_next", F.col("horizon") - 1)

    def one(t):
        mid = F.col(f"day_{t}")
        return F.struct(
            F.lit(t).alias("pollutant"), F.expm1(mid - 0.5).alias("lo"), F.expm1(mid).alias("mid"), F.expm1(mid + 0.5).alias("hi"),
            F.expm1(goal[t]).alias("actual"), F.expm1(t).alias("persistence"),
        )

    out = rows.select("station_id", "hour", "horizon", F.explode(F.array(one("pm25"), one("pm10"))).alias("f"))
    return out.select("station_id", "hour", "horizon", (F.col("hour") + F.col("horizon")).alias("target_hour"), "f.*")


@register("j5_air_hourly_scores", f"""
SELECT pollutant, bucket, mae, mae_persistence, coverage_80, round(1 - mae / mae_persistence, 3) AS skill FROM (
  SELECT pollutant, {sql_bucket(K.AIR_BUCKETS)} AS bucket, round(avg(abs(mid - actual)), 2) AS mae, round(avg(abs(persistence - actual)), 2) AS mae_persistence,
    round(avg(CASE WHEN actual BETWEEN lo AND hi THEN 1.0 ELSE 0.0 END), 3) AS coverage_80 FROM air_fc WHERE actual IS NOT NULL GROUP BY ALL)""")
def air_hourly_scores(spark, sf):
    return scoring.air_hourly_scores(air_forecasts(spark, sf))


@register("h6_daily_means_of_path", """
SELECT station_id, make_timestamp(hour * 3600000000) AS origin, target_hour // 24 - hour // 24 AS days_ahead, round(ln(1 + avg(mid)), 8) + 0.0 AS path_mid FROM air_fc
WHERE pollutant = 'pm25' AND hour % 24 = 18 GROUP BY ALL""")
def daily_means_of_path(spark, sf):
    path = air_forecasts(spark, sf).filter("pollutant = 'pm25' and hour % 24 = 18").withColumns({q: F.log1p(q) for q in ("lo", "mid", "hi")})
    out = blending.path_day_means(path)
    return out.select("station_id", from_hour(F.col("issue_hour")).alias("origin"), "days_ahead", *cols8(["path_mid"]))


LIM = {t: math.log1p(blending.index_at(t, K.POOR_INDEX)) for t in ("pm25", "pm10")}
cte("air_daily_fc", "SELECT station_id, issue_day, days_ahead, " + ", ".join(
    f"exp(last24_{t} - 0.6) - 1 AS {t}_lo, exp(last24_{t} + 0.1) - 1 AS {t}, exp(last24_{t} + 0.7) - 1 AS {t}_hi, exp(actual_{t}) - 1 AS {t}_actual, exp(last24_{t}) - 1 AS {t}_last24h" for t in ("pm25", "pm10"))
    + " FROM h5_rows WHERE last24_pm25 IS NOT NULL AND last24_pm10 IS NOT NULL")
_CHANCE = {t: "1 - " + sql_below(repr(LIM[t]), f"ln(1 + {t}_lo)", f"ln(1 + {t})", f"ln(1 + {t}_hi)") for t in ("pm25", "pm10")}
cte("air_outlook", f"""
SELECT *, round_even(greatest({_sql_sub_index('pm25', 'pm25')}, {_sql_sub_index('pm10', 'pm10')}), 0) AS pm_index, round(greatest({_CHANCE['pm25']}, {_CHANCE['pm10']}), 3) AS p_poor_or_worse,
  greatest({_sql_sub_index('pm25_actual', 'pm25')}, {_sql_sub_index('pm10_actual', 'pm10')}) AS actual_pm_index FROM air_daily_fc""")


def air_daily(spark, sf):
    from tarnwatch.operators import air_features

    rows = air_features.daily_rows(air_levels(spark, sf)).filter("last24_pm25 is not null and last24_pm10 is not null")
    cols = {}
    for t in ("pm25", "pm10"):
        last = F.col(f"last24_{t}")
        cols |= {f"{t}_lo": F.expm1(last - 0.6), t: F.expm1(last + 0.1), f"{t}_hi": F.expm1(last + 0.7), f"{t}_actual": F.expm1(f"actual_{t}"), f"{t}_last24h": F.expm1(last)}
    return blending.particulate_outlook(rows.select("station_id", "issue_day", "days_ahead", *[c.alias(n) for n, c in cols.items()]))


@register("h7_particulate_outlook", f"""
SELECT station_id, make_timestamp(issue_day * 86400000000) AS issue_date, days_ahead, pm_index, {sql_category('pm_index')} AS pm_category, p_poor_or_worse, round(actual_pm_index, 7) AS actual_pm_index FROM air_outlook""")
def particulate_outlook(spark, sf):
    return air_daily(spark, sf).select(
        "station_id", from_day(F.col("issue_day")).alias("issue_date"), "days_ahead", "pm_index", "pm_category", "p_poor_or_worse", *cols8(["actual_pm_index"], 7)
    )


cte("air_day_alerts", _sql_alerts("(SELECT * FROM air_outlook WHERE actual_pm_index IS NOT NULL)", "days_ahead", "p_poor_or_worse", "p_poor_or_worse >= 0.5", "actual_pm_index > 150"))


@register("j5_air_daily_scores", f"""
SELECT d.*, a.* EXCLUDE (days_ahead) FROM (SELECT days_ahead, {', '.join(f"round(avg(abs({t} - {t}_actual)), 2) AS {t}_mae, round(avg(abs({t}_last24h - {t}_actual)), 2) AS {t}_mae_persistence, round(avg(CASE WHEN {t}_actual BETWEEN {t}_lo AND {t}_hi THEN 1.0 ELSE 0.0 END), 3) AS {t}_coverage_80" for t in ('pm25', 'pm10'))},
  round(avg(CASE WHEN {sql_category('pm_index')} = {sql_category('actual_pm_index')} THEN 1.0 ELSE 0.0 END), 3) AS category_agreement FROM air_outlook WHERE actual_pm_index IS NOT NULL GROUP BY 1) d
JOIN (SELECT days_ahead, {_ALERT_COLS} FROM air_day_alerts) a ON a.days_ahead = d.days_ahead""")
def air_daily_scores(spark, sf):
    return scoring.air_daily_scores(air_daily(spark, sf), poor=150)


# ---------------------------------------------------------------------------- lab scores

cte("lab_clean", """
SELECT station_id, "timestamp", bod_n AS bod, src_ord FROM lab_numbers WHERE bod_n > 0 AND bod_n BETWEEN 0 AND 500
QUALIFY row_number() OVER (PARTITION BY station_id, "timestamp" ORDER BY src_ord) = 1""")
cte("lab_pairs", """
SELECT *, lag(bod) OVER (PARTITION BY station_id ORDER BY "timestamp") AS previous, lag(chl) OVER (PARTITION BY station_id ORDER BY "timestamp") AS previous_chl FROM (
  SELECT c.*, n.chl_n AS chl, n.col_n AS coliform FROM lab_clean c JOIN lab_numbers n USING (src_ord))""")


def lab_clean(spark, sf):
    return clean_lab(readers.read_lab(tables.lab(spark, sf), "bod"), "bod")


def lab_pairs(spark, sf):
    """Clean BOD samples with the station's previous result as the estimate."""
    return with_previous(lab_clean(spark, sf), "bod")


@register("e11_lab_report", """
SELECT count(*) AS samples_in, count(*) FILTER (bod_n IS NULL OR bod_n <= 0) AS unusable_dropped, count(*) FILTER (bod_n > 0) - (SELECT count(*) FROM lab_clean) AS duplicates_dropped,
  (SELECT count(*) FROM lab_clean) AS samples_out FROM lab_numbers""")
def lab_counts(spark, sf):
    return lab_report(readers.read_lab(tables.lab(spark, sf), "bod"))


@register("f22_previous_result", "SELECT src_ord, bod, previous FROM lab_pairs")
def previous_result(spark, sf):
    return lab_pairs(spark, sf).select("src_ord", "bod", "previous")


def _sql_accuracy(table, keys, actual, estimate):
    k = f"{keys}, " if keys else ""
    return f"""
SELECT {k}count(*) AS samples, round(avg(abs(e - a)), 3) AS mae, round(sqrt(avg((e - a) * (e - a))), 3) AS rmse, round(median(abs(e / a - 1)) * 100, 1) AS median_abs_pct_error,
  round(sqrt(avg(power(ln(e) - ln(a), 2))), 3) AS rmse_log, round(1 - avg(power(ln(e) - ln(a), 2)) / var_pop(ln(a)), 3) AS r2_log, round(median(e / a), 3) AS median_ratio
FROM (SELECT *, {actual} AS a, {estimate} AS e FROM {table} WHERE {actual} IS NOT NULL AND {estimate} IS NOT NULL) {f'GROUP BY {keys}' if keys else ''}"""


@register("j6_accuracy", _sql_accuracy("lab_pairs", "station_id", "bod", "previous"))
def accuracy(spark, sf):
    return scoring.accuracy(lab_pairs(spark, sf), ["station_id"], "bod", "previous")


@register("j7_range_quality", """
SELECT station_id, round(avg(CASE WHEN bod BETWEEN previous * 0.5 AND previous + 2 THEN 1.0 ELSE 0.0 END), 3) AS coverage, round(median((previous + 2) / (previous * 0.5)), 2) AS median_width_factor FROM lab_pairs GROUP BY 1""")
def range_quality(spark, sf):
    df = lab_pairs(spark, sf).withColumns({"lo": F.col("previous") * 0.5, "hi": F.col("previous") + 2})
    return scoring.range_quality(df, ["station_id"], "bod")


@register("j7_exceedance", f"SELECT station_id, {_ALERT_COLS} FROM ({_sql_alerts('(SELECT * FROM lab_pairs WHERE previous IS NOT NULL)', 'station_id', '(previous / 10)', 'previous / 10 >= 0.5', 'bod > 3')})")
def exceedance(spark, sf):
    df = lab_pairs(spark, sf).filter("previous is not null").withColumn("p", F.col("previous") / 10)
    return scoring.alert_scores(df, ["station_id"], "p", F.col("p") >= 0.5, F.col("bod") > 3)


cte("usual_bod", """
SELECT station_id, median(bod) AS usual FROM lab_clean WHERE "timestamp" < TIMESTAMP '2024-01-20' AND station_id <> 'st3' GROUP BY GROUPING SETS ((station_id), ())""")


@register("j17_station_median_rule", _sql_accuracy("""(SELECT c.*, coalesce(u.usual, (SELECT usual FROM usual_bod WHERE station_id IS NULL)) AS usual FROM lab_clean c LEFT JOIN usual_bod u ON u.station_id = c.station_id
  WHERE c."timestamp" >= TIMESTAMP '2024-01-20')""", "station_id", "bod", "usual"))
def station_median_rule(spark, sf):
    lab = lab_clean(spark, sf)
    cut = F.lit("2024-01-20").cast("timestamp_ntz")
    train = lab.filter((F.col("timestamp") < cut) & (F.col("station_id") != "st3"))
    test = scoring.with_usual(lab.filter(F.col("timestamp") >= cut), materialise(scoring.station_medians(train, "bod"), "usual"))
    return scoring.accuracy(test, ["station_id"], "bod", "usual")


cte("log_residuals", "SELECT ln(bod) - ln(previous) AS r FROM lab_pairs WHERE previous IS NOT NULL")


def log_residuals(spark, sf):
    return lab_pairs(spark, sf).filter("previous is not null").select((F.ln("bod") - F.ln("previous")).alias("residual"))


@register("e20_residual_range", """
SELECT n, round(max(r) FILTER (rk = greatest(CAST(floor((n + 1) * (1 - 0.8::DOUBLE) / 2) AS BIGINT) - 1, 0)), 9) AS r_lo, round(median(r), 9) + 0.0 AS r_mid,
  round(max(r) FILTER (rk = least(CAST(ceil((n + 1) * (1 - (1 - 0.8::DOUBLE) / 2)) AS BIGINT) - 1, n - 1)), 9) AS r_hi
FROM (SELECT r, row_number() OVER (ORDER BY r) - 1 AS rk, count(*) OVER () AS n FROM log_residuals) GROUP BY n""")
def residual_range(spark, sf):
    return calibration.residual_range(log_residuals(spark, sf)).select("n", *[r9(c).alias(c) for c in ("r_lo", "r_mid", "r_hi")])


@register("e20_exceedance_odds", """
SELECT c.src_ord, round(1 - (SELECT count(*) FROM log_residuals WHERE r <= ln(3) - ln(c.bod) + 0.0001) / (SELECT count(*) FROM log_residuals)::DOUBLE, 9) + 0.0 AS p_above_3 FROM lab_clean c""")
def exceedance_odds(spark, sf):
    # The small shift keeps thresholds off residuals they tie with only up to rounding.
    asked = lab_clean(spark, sf).select("src_ord", (F.ln(F.lit(3.0)) - F.ln("bod") + 0.0001).alias("t"))
    out = calibration.share_above(asked, "t", log_residuals(spark, sf), name="p_above_3")
    return out.select("src_ord", r9("p_above_3").alias("p_above_3"))


cte("class_pairs", f"""
SELECT *, {_TROPHIC.replace('{x}', '(9.81 * ln(chl) + 30.6)')} AS trophic, {_TROPHIC.replace('{x}', '(9.81 * ln(previous_chl) + 30.6)')} AS trophic_before,
  {_WHO.replace('{a}', 'CASE WHEN chl > 12 THEN 1 ELSE 0 END').replace('{b}', 'CASE WHEN chl > 24 THEN 1 ELSE 0 END')} AS who,
  {_WHO.replace('{a}', 'CASE WHEN previous_chl > 12 THEN 1 ELSE 0 END').replace('{b}', 'CASE WHEN previous_chl > 24 THEN 1 ELSE 0 END')} AS who_before FROM lab_pairs WHERE previous_chl IS NOT NULL""")


@register("j8_class_agreement", """
SELECT station_id, round(avg(CASE WHEN trophic = trophic_before THEN 1.0 ELSE 0.0 END), 3) AS trophic_agreement, round(avg(CASE WHEN who = who_before THEN 1.0 ELSE 0.0 END), 3) AS who_agreement FROM class_pairs GROUP BY 1""")
def class_agreement(spark, sf):
    chl = tables.lab(spark, sf).select("src_ord", parse_numeric("chlorophyll_a").alias("chl"))
    df = with_previous(lab_clean(spark, sf).join(chl, "src_ord"), "chl").filter("previous is not null")

    def who(c):
        return water.who_level(F.when(F.col(c) > 12, 1.0).otherwise(0.0), F.when(F.col(c) > 24, 1.0).otherwise(0.0))

    df = df.withColumns({
        "trophic": water.trophic_class(water.carlson_tsi("chl")), "trophic_before": water.trophic_class(water.carlson_tsi("previous")),
        "who": who("chl"), "who_before": who("previous"),
    })
    a = scoring.agreement(df, ["station_id"], "trophic", "trophic_before", "trophic_agreement")
    return a.join(scoring.agreement(df, ["station_id"], "who", "who_before", "who_agreement"), "station_id")


cte("wqi_pairs", f"""
SELECT *, lag(cls) OVER (PARTITION BY station_id ORDER BY "timestamp", src_ord) AS guess FROM (SELECT *, {_WQI_CLASS.replace('{x}', 'wqi')} AS cls FROM wqi_rows WHERE wqi IS NOT NULL)""")


def wqi_pairs(spark, sf):
    rows = wqi_rows(spark, sf).filter("wqi is not null").withColumn("cls", water.wqi_class("wqi"))
    return with_previous(rows.select("src_ord", "station_id", "timestamp", "cls", "wqi"), "cls", "guess").filter("guess is not null")


_LABELS = " UNION ALL ".join(f"SELECT '{c}' AS c" for c in K.WQI_CLASSES)


@register("j9_confusion_matrix", f"""
SELECT a.c AS actual, b.c AS predicted, count(p.cls) AS n FROM ({_LABELS}) a CROSS JOIN ({_LABELS}) b LEFT JOIN wqi_pairs p ON p.cls = a.c AND p.guess = b.c GROUP BY 1, 2""")
def confusion(spark, sf):
    return scoring.confusion(wqi_pairs(spark, sf), "cls", "guess", K.WQI_CLASSES)


cte("wqi_class_f1", """
SELECT c, 2.0::DOUBLE * count(*) FILTER (hit) / (count(*) FILTER (side = 'a') + count(*) FILTER (side = 'p')) AS f1 FROM (
  SELECT cls AS c, 'a' AS side, cls = guess AS hit FROM wqi_pairs WHERE guess IS NOT NULL UNION ALL SELECT guess, 'p', false FROM wqi_pairs WHERE guess IS NOT NULL) GROUP BY 1""")


@register("j9_macro_f1", "SELECT round(avg(f1), 8) AS macro_f1, count(*) AS classes FROM wqi_class_f1")
def macro_f1(spark, sf):
    return scoring.macro_f1(wqi_pairs(spark, sf), "cls", "guess").select(F.round("macro_f1", 8).alias("macro_f1"), "classes")


_RANK = "CASE {x} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(K.WQI_CLASSES)) + " END"


@register("j9_predicted_cleaner", f"""
SELECT round(avg(CASE WHEN d > 0 THEN 1.0 ELSE 0.0 END), 4) AS rate_predicted_cleaner, count(*) FILTER (d >= 2) AS count_2plus_cleaner
FROM (SELECT {_RANK.replace('{x}', 'cls')} - {_RANK.replace('{x}', 'guess')} AS d FROM wqi_pairs WHERE guess IS NOT NULL)""")
def predicted_cleaner(spark, sf):
    return scoring.cleaner_than_actual(wqi_pairs(spark, sf), "cls", "guess")


# ---------------------------------------------------------------------------- small relational operators


@register("e10_class_counts", f"""
SELECT c.c AS wqi_class, count(w.wqi) AS n FROM ({_LABELS}) c LEFT JOIN (SELECT wqi, {_WQI_CLASS.replace('{x}', 'wqi')} AS cls FROM wqi_rows WHERE src_ord % 2 = 0) w ON w.cls = c.c GROUP BY 1""")
def class_counts(spark, sf):
    rows = wqi_rows(spark, sf).filter("src_ord % 2 = 0 and wqi is not null").withColumn("wqi_class", water.wqi_class("wqi"))
    counts = rows.groupBy("wqi_class").agg(F.count(F.lit(1)).alias("n"))
    order = spark.createDataFrame([(c,) for c in K.WQI_CLASSES], "wqi_class string")
    return order.join(counts, "wqi_class", "left").fillna(0, ["n"])


@register("e28_training_ranges", "SELECT sensor, min(value) AS low, max(value) AS high FROM (" + " UNION ALL ".join(f"SELECT '{s}' AS sensor, {s} AS value FROM readings" for s in S) + ") GROUP BY 1")
def training_ranges(spark, sf):
    long = tables.readings(spark, sf).unpivot(["src_ord"], S, "sensor", "value")
    return long.groupBy("sensor").agg(F.min("value").alias("low"), F.max("value").alias("high"))


@register("e29_class_weights", f"""
SELECT cls AS wqi_class, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)::DOUBLE), 9) AS weight FROM (SELECT {_WQI_CLASS.replace('{x}', 'wqi')} AS cls FROM wqi_rows WHERE wqi IS NOT NULL) GROUP BY 1""")
def class_weights(spark, sf):
    from tarnwatch.operators.splits import balanced_weights

    rows = wqi_rows(spark, sf).filter("wqi is not null").withColumn("wqi_class", water.wqi_class("wqi"))
    return balanced_weights(rows, "wqi_class").withColumn("weight", r9("weight"))


@register("e23_extreme_rows", """
SELECT station_id, make_timestamp(arg_min(hour, (dissolved_oxygen, hour)) * 3600000000) AS lowest_oxygen_at, round(min(dissolved_oxygen), 9) AS lowest_oxygen,
  make_timestamp(arg_min(hour, (-turbidity, hour)) FILTER (turbidity IS NOT NULL) * 3600000000) AS highest_turbidity_at, round(max(turbidity), 9) AS highest_turbidity
FROM (SELECT * FROM d_hour_grid WHERE dissolved_oxygen IS NOT NULL AND turbidity IS NOT NULL) GROUP BY 1""")
def extreme_rows(spark, sf):
    from .lakes import hourly

    rows = hourly(spark, sf).filter("dissolved_oxygen is not null and turbidity is not null")
    out = rows.groupBy("station_id").agg(
        F.min_by("hour", F.struct("dissolved_oxygen", "hour")).alias("a"), F.min("dissolved_oxygen").alias("lo"),
        F.min_by("hour", F.struct(-F.col("turbidity"), "hour")).alias("b"), F.max("turbidity").alias("hi"),
    )
    return out.select(
        "station_id", from_hour(F.col("a")).alias("lowest_oxygen_at"), r9("lo").alias("lowest_oxygen"),
        from_hour(F.col("b")).alias("highest_turbidity_at"), r9("hi").alias("highest_turbidity"),
    )


@register("d9_left_join_by_sample", """
SELECT l.src_ord, l.bod_n AS bod, c.col_n AS total_coliform FROM lab_numbers l LEFT JOIN (SELECT station_id, "timestamp", col_n FROM lab_numbers WHERE src_ord % 3 <> 0) c USING (station_id, "timestamp")""")
def left_join_by_sample(spark, sf):
    lab = tables.lab(spark, sf)
    bod = lab.select("src_ord", "station_id", "timestamp", parse_numeric("bod").alias("bod"))
    coliform = lab.filter("src_ord % 3 <> 0").select("station_id", "timestamp", parse_numeric("total_coliform").alias("total_coliform"))
    return bod.join(coliform, ["station_id", "timestamp"], "left").select("src_ord", "bod", "total_coliform")


cte("path_grades", "SELECT station_id, target_hour, arg_max(mid, horizon) AS mid, CASE WHEN arg_max(mid, horizon) >= 7 THEN 'Good' ELSE 'Poor' END AS wqi_class FROM fc WHERE sensor = 'dissolved_oxygen' AND mid IS NOT NULL GROUP BY 1, 2")


@register("d10_inner_join_by_target", """
SELECT f.station_id, make_timestamp(f.hour * 3600000000) AS origin, f.horizon, f.sensor, g.wqi_class FROM fc f JOIN path_grades g USING (station_id, target_hour)""")
def inner_join_by_target(spark, sf):
    fc = forecasts(spark, sf)
    oxygen = fc.filter("sensor = 'dissolved_oxygen' and mid is not null").groupBy("station_id", "target_hour").agg(F.max_by("mid", "horizon").alias("mid"))
    grades = oxygen.select("station_id", "target_hour", F.when(F.col("mid") >= 7, "Good").otherwise("Poor").alias("wqi_class"))
    out = fc.join(grades, ["station_id", "target_hour"])
    return out.select("station_id", from_hour(F.col("hour")).alias("origin"), "horizon", "sensor", "wqi_class")


@register("d16_membership", "SELECT event_id AS src_ord FROM events WHERE event_type IN ('error', 'click')")
def membership(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.filter(F.col("event_type").isin("error", "click")).select(F.col("event_id").alias("src_ord"))


@register("d19_union_all", """
SELECT station_id, "start", "end" FROM episodes UNION ALL SELECT station_id, "start" + INTERVAL 1 DAY, "end" + INTERVAL 1 DAY FROM episodes WHERE kind = 'event'""")
def union_all(spark, sf):
    ep = tables.episodes(spark, sf).select("station_id", "kind", "start", "end")
    later = ep.filter("kind = 'event'").withColumns({c: F.expr(f"`{c}` + interval 1 day") for c in ("start", "end")})
    return ep.unionByName(later).select("station_id", "start", "end")


@register("d20_stations_without", "SELECT DISTINCT station_id FROM readings WHERE station_id NOT IN (SELECT station_id FROM dense)")
def stations_without(spark, sf):
    known = tables.dense(spark, sf).select("station_id")
    return tables.readings(spark, sf).select("station_id").distinct().join(known.distinct(), "station_id", "left_anti")


@register("d21_station_union", "SELECT station_id FROM readings UNION SELECT station_id FROM air")
def station_union(spark, sf):
    # Deduplicated on each side first, so the union moves one row per station and task.
    a, b = (t.select("station_id").distinct() for t in (tables.readings(spark, sf), tables.air(spark, sf)))
    return a.unionByName(b).distinct()


@register("d22_pivot_sensors", """
SELECT station_id, make_timestamp(target_hour * 3600000000) AS target_time, round(avg(mid) FILTER (sensor = 'temperature'), 8) AS temperature, round(avg(mid) FILTER (sensor = 'dissolved_oxygen'), 8) AS dissolved_oxygen FROM fc GROUP BY 1, 2""")
def pivot_sensors(spark, sf):
    wide = forecasts(spark, sf).groupBy("station_id", "target_hour").pivot("sensor", FS).agg(F.avg("mid"))
    return wide.select("station_id", from_hour(F.col("target_hour")).alias("target_time"), *cols8(FS))


@register("d23_unpivot_sensors", " UNION ALL ".join(f"SELECT src_ord, '{s}' AS sensor, {s} AS value FROM readings" for s in S))
def unpivot_sensors(spark, sf):
    return tables.readings(spark, sf).unpivot(["src_ord"], S, "sensor", "value")


@register("d5_scale_check_on_lineitem", """
SELECT l_suppkey, l_shipdate::TIMESTAMP AS shipped, round(min_by(l_extendedprice, (l_orderkey, l_linenumber)), 4) AS first_price, count(*) AS n FROM lineitem GROUP BY 1, 2""")
def lineitem_dedupe(spark, sf):
    li = spark.read.parquet(f"{sf}/lineitem.parquet")
    # The first-wins dedupe on the widest table: a hash aggregate on (key, day), no sort.
    order = F.col("l_orderkey") * 16 + F.col("l_linenumber")
    return li.groupBy("l_suppkey", F.col("l_shipdate").cast("timestamp_ntz").alias("shipped")).agg(
        F.round(F.min_by("l_extendedprice", order), 4).alias("first_price"), F.count(F.lit(1)).alias("n")
    )
