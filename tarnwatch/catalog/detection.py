"""Queries for departures, recursions, verdicts, incidents and their scores."""

import math

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_hour, micros
from tarnwatch.functions.working import r9
from tarnwatch.operators import events, faults, grid, incidents, joins, lake_qc, robust, runs, verdicts
from tarnwatch.operators.chunks import HOUR_CHUNK, SLOT_CHUNK
from tarnwatch.operators.lineage import materialise
from tarnwatch.operators.memory import weather_memory
from tarnwatch.operators.order_stats import quantiles
from tarnwatch.operators.recursions import clipped_scan, smoothing
from tarnwatch.sources import tables

from .oracle import cte
from .registry import register
from .windows import S, T0, W, _floors, _sql_long, clean_grid, dense_grid, scaled_grid, stamped

# ---------------------------------------------------------------------------- departures and events

cte("departure", "SELECT station_id, slot, " + ", ".join(f"{s} - {s}_base AS {s}" for s in S) + " FROM baseline")
cte("dep_long", _sql_long("departure"))
cte("dep_mid", "SELECT station_id, sensor, median(value) AS mid FROM dep_long GROUP BY ALL")
cte("dep_scales", f"""
SELECT l.station_id, l.sensor, greatest(1.4826 * median(abs(l.value - m.mid)), {_floors(K.MIN_SCALE).replace('sensor', 'l.sensor')}) AS scale
FROM dep_long l JOIN dep_mid m USING (station_id, sensor) GROUP BY l.station_id, l.sensor""")
cte("dep_z", "SELECT d.station_id, d.slot, " + ", ".join(
    f"d.{s} / (SELECT scale FROM dep_scales x WHERE x.sensor = '{s}' AND x.station_id = d.station_id) AS {s}" for s in S)
    + " FROM departure d")
_N = " + ".join(f"CASE WHEN abs(z.{s}) > 3 AND c.{s} IS NOT NULL THEN 1 ELSE 0 END" for s in S)
cte("departing", f"SELECT z.*, {_N} AS n_departing, ({_N}) >= 2 AS candidate FROM dep_z z JOIN clean c USING (station_id, slot)")
cte("held_events", f"""
SELECT *, candidate AND count(*) {W[:-1]} ROWS 2 PRECEDING) = 3 AND bool_and(candidate) {W[:-1]} ROWS 2 PRECEDING) AS event FROM departing""")


def with_departures(spark, sf):
    """QC'd grid with raw readings, clean working values, departures and the candidate flag, written once."""
    flagged = lake_qc.rule_tests(scaled_grid(spark, sf))
    flagged = flagged.withColumns({f"raw_{s}": F.col(s) for s in S})
    clean = lake_qc.clean_values(flagged, K.SHAPE_FAULTS)
    clean = clean.select("station_id", "slot", *S, *[f"raw_{s}" for s in S], *[f"{s}_reason" for s in S])
    clean = materialise(events.with_baseline(clean), "clean")
    return events.departures(clean, events.departure_scales(clean))


@register("f8_departures", f"""
SELECT station_id, {T0}, {', '.join(f'round({s}, 9) + 0.0 AS dep_{s}' for s in S)}, CAST(n_departing AS BIGINT) AS n_departing, candidate FROM departing""")
def departures(spark, sf):
    out = with_departures(spark, sf)
    return stamped(
        out, [*[r9(f"dep_{s}").alias(f"dep_{s}") for s in S], F.col("n_departing").cast("bigint").alias("n_departing"), "candidate"]
    )


@register("f9_sustained_events", f"SELECT station_id, {T0}, event FROM held_events")
def sustained_events(spark, sf):
    return stamped(runs.sustained(with_departures(spark, sf), "candidate", K.EVENT_MIN_POINTS, "event"), ["event"])


@register("e9_empirical_quantiles", """
SELECT round(quantile_cont(x, 0.9995), 9) AS score_level, round(quantile_cont(x, 0.999), 9) AS drift_level, count(x) AS n
FROM (SELECT abs(temperature) AS x FROM dep_z WHERE temperature IS NOT NULL)""")
def empirical_quantiles(spark, sf):
    out = with_departures(spark, sf).select(F.abs("dep_temperature").alias("x"))
    levels = quantiles(out, [], "x", {"score_level": K.FOREST_QUANTILE, "drift_level": K.DRIFT_QUANTILE})
    return levels.select(r9("score_level").alias("score_level"), r9("drift_level").alias("drift_level"), "n")


_INSTANT = "CASE WHEN CAST(round(c.turbidity * 100) AS BIGINT) % 23 = 0 THEN 'turbidity' WHEN CAST(round(c.ph * 100) AS BIGINT) % 31 = 0 THEN 'ph' ELSE '' END"
_DRIFT = "CASE WHEN CAST(round(c.dissolved_oxygen * 100) AS BIGINT) % 19 = 0 THEN 'dissolved_oxygen' ELSE '' END"
_ONE = " + ".join(f"CASE WHEN {s}_reason = 'rate_of_change' THEN 1 ELSE 0 END" for s in S)
_FAULT = ", ".join(
    f"""CASE WHEN {s}_reason IN ('out_of_range', 'flatline', 'spike') THEN {s}_reason WHEN drift = '{s}' AND NOT event THEN 'drift'
  WHEN instant = '{s}' AND NOT event THEN 'inconsistent' WHEN {s}_reason = 'rate_of_change' AND ({_ONE}) = 1 AND NOT candidate THEN 'rate_of_change'
  ELSE '' END AS {s}_fault""" for s in S)
cte("blame", f"""
SELECT h.station_id, h.slot, h.n_departing, h.candidate, h.event, q.* EXCLUDE (station_id, slot), {', '.join(f'g.{s}' for s in S)},
  {', '.join(f'h.{s} AS dep_{s}' for s in S)}, {_INSTANT} AS instant, {_DRIFT} AS drift
FROM held_events h JOIN qc_wide q USING (station_id, slot) JOIN d_slot_grid g USING (station_id, slot) JOIN clean c USING (station_id, slot)""")
cte("faulted", f"SELECT *, {_FAULT} FROM blame")
_SOFT = " OR ".join(f"{s}_fault IN ('drift', 'inconsistent', 'rate_of_change')" for s in S)
_SHAPE = " OR ".join(f"{s}_fault IN ('out_of_range', 'flatline', 'spike')" for s in S)
cte("event_starts", f"SELECT *, event AND NOT coalesce(lag(event) {W}, false) AS starts FROM faulted")
cte("onsets", f"""
SELECT *, coalesce(bool_or(starts) {W[:-1]} ROWS BETWEEN 1 FOLLOWING AND 18 FOLLOWING), false) AND ({_SOFT}) AND NOT ({_SHAPE}) AS onset FROM event_starts""")
cte("relabelled", "SELECT station_id, slot, " + ", ".join(S) + ", event OR onset AS event, n_departing, " + ", ".join(f"dep_{s}" for s in S) + ", " + ", ".join(
    f"CASE WHEN onset AND {s}_fault IN ('drift', 'inconsistent', 'rate_of_change') THEN '' ELSE {s}_fault END AS {s}_fault" for s in S)
    + " FROM onsets")
_ANY = " OR ".join(f"{s}_fault <> ''" for s in S)
cte("review_rows", f"SELECT *, coalesce(abs(dep_ph), 0) + coalesce(abs(dep_turbidity), 0) > 3.5 AND NOT ({_ANY}) AND NOT event AS odd FROM relabelled")
cte("judged", f"""
SELECT *, CASE WHEN temperature IS NULL AND ph IS NULL AND turbidity IS NULL AND dissolved_oxygen IS NULL THEN 'missing'
  WHEN event THEN 'possible_event' WHEN {_ANY} THEN 'sensor_fault' WHEN review THEN 'needs_review' ELSE 'normal' END AS verdict
FROM (SELECT *, odd AND count(*) {W[:-1]} ROWS 1 PRECEDING) = 2 AND bool_and(odd) {W[:-1]} ROWS 1 PRECEDING) AS review FROM review_rows)""")


def blamed(spark, sf):
    """Rows with event flags and (stand-in) instant and drift culprits read off the values, then fault labels."""
    rows = runs.sustained(with_departures(spark, sf), "candidate", K.EVENT_MIN_POINTS, "event")

    def hundredths(s):
        return F.round(F.col(s) * 100).cast("bigint")

    return rows.withColumns(
        {
            "instant": F.when(hundredths("turbidity") % 23 == 0, "turbidity").when(hundredths("ph") % 31 == 0, "ph").otherwise(""),
            "drift": F.when(hundredths("dissolved_oxygen") % 19 == 0, "dissolved_oxygen").otherwise(""),
        }
    )


def relabelled(spark, sf):
    rows = verdicts.fault_labels(blamed(spark, sf))
    rows = rows.withColumns({s: F.col(f"raw_{s}") for s in S}).drop(*[f"raw_{s}" for s in S])
    return events.relabel_onsets(rows)


def judged(spark, sf):
    rows = relabelled(spark, sf)
    odd = F.coalesce(F.abs("dep_ph"), F.lit(0.0)) + F.coalesce(F.abs("dep_turbidity"), F.lit(0.0)) > 3.5
    rows = rows.withColumn("odd", odd & ~verdicts.any_fault() & ~F.col("event"))
    rows = runs.sustained(rows, "odd", K.REVIEW_MIN_POINTS, "review")
    return rows.withColumn("verdict", verdicts.verdict())


FAULT_COLS = [f"{s}_fault" for s in S]


@register("i3_fault_labels", f"SELECT station_id, {T0}, {', '.join(FAULT_COLS)} FROM faulted")
def fault_labels(spark, sf):
    return stamped(verdicts.fault_labels(blamed(spark, sf)), FAULT_COLS)


@register("f10_event_onsets", f"SELECT station_id, {T0}, event, {', '.join(FAULT_COLS)} FROM relabelled")
def event_onsets(spark, sf):
    return stamped(relabelled(spark, sf), ["event", *FAULT_COLS])


@register("i4_verdicts", f"SELECT station_id, {T0}, verdict FROM judged")
def verdict_rows(spark, sf):
    return stamped(judged(spark, sf), ["verdict"])


cte("alarms", f"""
SELECT *, coalesce(slot - lag(slot) {W}, 1000) > 7 AS opens FROM judged WHERE verdict IN ('sensor_fault', 'possible_event', 'needs_review')""")
cte("numbered_alarms", f"SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) {W} AS incident FROM alarms")
cte("incident_rows", """
SELECT station_id, make_timestamp(min(slot) * 600000000) AS "start", make_timestamp(max(slot) * 600000000) AS "end",
  string_agg(DISTINCT verdict, ',' ORDER BY verdict) AS verdicts,
  concat_ws(',', """ + ", ".join(f"CASE WHEN bool_or({s}_fault <> '') THEN '{s}' END" for s in S) + """) AS sensors
FROM numbered_alarms GROUP BY station_id, incident""")


@register("g8_incidents", 'SELECT station_id, "start", "end", verdicts, sensors FROM incident_rows')
def incident_rows(spark, sf):
    return incidents.alarm_incidents(judged(spark, sf))


cte("explained_rows", """
SELECT i.*, EXISTS (SELECT 1 FROM episodes e WHERE e.station_id = i.station_id AND e."start" - INTERVAL 1 HOUR <= i."end"
  AND e."end" + INTERVAL 6 HOUR >= i."start") AS explained FROM incident_rows i""")


@register("d14_explained_incidents", 'SELECT station_id, "start", "end", explained FROM explained_rows')
def explained(spark, sf):
    found = incidents.alarm_incidents(judged(spark, sf))
    return incidents.explained_incidents(found, tables.episodes(spark, sf)).select("station_id", "start", "end", "explained")


@register("i8_incident_scores", """
SELECT count(*) AS incidents, count(*) FILTER (NOT explained) AS false_incidents,
  round(count(*) FILTER (NOT explained) / (SELECT sum(span) / 1008.0 FROM (SELECT max(slot) - min(slot) AS span FROM d_slot_grid GROUP BY station_id)), 3) AS false_alarms_per_station_week,
  round(count(*) FILTER (explained) / count(*)::DOUBLE, 3) AS incident_precision FROM explained_rows""")
def incident_scores(spark, sf):
    rows = judged(spark, sf)
    found = incidents.explained_incidents(incidents.alarm_incidents(rows), tables.episodes(spark, sf))
    return incidents.incident_scores(found, dense_grid(spark, sf))


cte("episode_hits", """
SELECT e.ep, e.station_id, e.kind, e.sensor, e."start", e."end",
  min(CASE WHEN (e.kind = 'event' AND j.event) OR (e.kind = 'dropout' AND j.verdict = 'missing')
            OR (e.kind NOT IN ('event', 'dropout') AND CASE e.sensor """ + " ".join(f"WHEN '{s}' THEN j.{s}_fault" for s in S) + """ END <> '') THEN j.slot END) AS hit,
  coalesce(bool_or(""" + " OR ".join(f"j.{s}_fault <> ''" for s in S) + """), false) AS any_fault
FROM episodes e LEFT JOIN judged j ON j.station_id = e.station_id AND make_timestamp(j.slot * 600000000) BETWEEN e."start" AND e."end"
GROUP BY ALL""")
cte("episode_scores", """
SELECT ep, station_id, kind, sensor, hit IS NOT NULL AS detected, round((hit * 600000000 - epoch_us("start")) / 3600000000.0::DOUBLE, 2) AS delay_hours,
  kind = 'event' AND hit IS NULL AND any_fault AS blamed_on_sensor FROM episode_hits""")


@register("i6_episode_scores", "SELECT * FROM episode_scores")
def episode_scores(spark, sf):
    return incidents.episode_scores(judged(spark, sf), tables.episodes(spark, sf)).drop("start", "end")


@register("i7_kind_scores", """
SELECT kind, count(*) AS episodes, count(*) FILTER (detected) AS detected, round(avg(CASE WHEN detected THEN 1.0 ELSE 0.0 END), 3) AS recall,
  round(median(delay_hours), 6) AS median_delay_hours FROM episode_scores GROUP BY 1""")
def kind_scores(spark, sf):
    scored = materialise(incidents.episode_scores(judged(spark, sf), tables.episodes(spark, sf)), "episode_scores")
    return incidents.kind_scores(scored).withColumn("median_delay_hours", F.round("median_delay_hours", 6))


@register("i10_check_coverage", "SELECT " + ", ".join(f"round(count(CASE WHEN dep_{s} <> 0 THEN 1 END) / greatest(count({s}), 1)::DOUBLE, 3) AS {s}" for s in S) + " FROM blame")
def check_coverage(spark, sf):
    out = with_departures(spark, sf)
    out = out.select(*[F.col(f"raw_{s}").alias(s) for s in S], *[F.when(F.col(f"dep_{s}") != 0, F.col(f"dep_{s}")).alias(f"{s}_z") for s in S])
    return incidents.consistency_coverage(out)


# ---------------------------------------------------------------------------- culprit isolation, two-sided z

cte("culprit_inputs", """
SELECT event_id AS src_ord, """ + ", ".join(
    [f"((v * {3 + i}) % 400) / 100.0::DOUBLE AS own_{s}" for i, s in enumerate(S)]
    + [f"CASE WHEN (v + {i * 7 + j}) % 13 <> 0 THEN ((v * {11 + 5 * i + j}) % 250) / 100.0::DOUBLE END AS rest_{s}_{j}" for i, s in enumerate(S) for j in range(3)]
) + " FROM ev")


def culprit_inputs(spark, sf):
    e = tables._events(spark, sf)
    own = {f"own_{s}": F.expr(f"(v * {3 + i}) % 400") / 100 for i, s in enumerate(S)}
    rest = {
        f"rest_{s}_{j}": F.when(F.expr(f"(v + {i * 7 + j}) % 13 <> 0"), F.expr(f"(v * {11 + 5 * i + j}) % 250") / 100)
        for i, s in enumerate(S)
        for j in range(3)
    }
    return e.select(F.col("event_id").alias("src_ord"), *[c.alias(n) for n, c in {**own, **rest}.items()])


_REM = {s: f"coalesce(greatest(rest_{s}_0, rest_{s}_1, rest_{s}_2), 0)" for s in S}
_QUAL = {s: f"CASE WHEN own_{s} > 1 AND {_REM[s]} <= 1 THEN {_REM[s]} END" for s in S}
_BEST = f"least({', '.join(_QUAL.values())})"


@register("i1_isolate_culprit", f"""
SELECT src_ord, CASE WHEN {_BEST} IS NULL THEN '' {' '.join(f"WHEN {_QUAL[s]} = {_BEST} THEN '{s}'" for s in S)} END AS culprit FROM culprit_inputs""")
def isolate_culprit(spark, sf):
    df = culprit_inputs(spark, sf)
    own = {s: F.col(f"own_{s}") for s in S}
    others = {s: [F.col(f"rest_{s}_{j}") for j in range(3)] for s in S}
    return df.select("src_ord", verdicts.isolate(own, others).alias("culprit"))


@register("f12_two_sided_z", """
SELECT src_ord, CASE WHEN raw IS NOT NULL THEN CASE WHEN sign(raw) = sign(flat) THEN round(sign(raw) * least(abs(raw), abs(flat)), 9) + 0.0 ELSE 0.0 END END AS z
FROM (SELECT src_ord, CASE WHEN src_ord % 17 <> 0 THEN ph - 7.5 END AS raw, oxygen - 7 AS flat FROM graded_rows)""")
def two_sided_z(spark, sf):
    df = tables.graded_rows(spark, sf).select(
        "src_ord", F.when(F.col("src_ord") % 17 != 0, F.col("ph") - 7.5).alias("raw"), (F.col("oxygen") - 7).alias("flat")
    )
    return df.select("src_ord", r9(events.two_sided("raw", "flat")).alias("z"))


# ---------------------------------------------------------------------------- recursions

W48 = 1 - math.exp(-1 / 48)
cte("smooth_inputs", f"""
SELECT station_id, hour, row_number() OVER (PARTITION BY station_id ORDER BY hour) AS rn, hour % 101 = 0 AS reset,
  CASE WHEN temperature IS NOT NULL THEN least(greatest(temperature - 22, -4), 4) END AS x FROM d_hour_grid""")
cte("smooth_levels", f"""
SELECT station_id, hour, rn, recursive_step, x FROM (SELECT station_id, hour, rn, x,
  CASE WHEN reset OR x IS NULL THEN 0.0::DOUBLE ELSE least(greatest({W48} * x, -1.2), 1.2) END AS recursive_step FROM smooth_inputs WHERE rn = 1)
UNION ALL
SELECT i.station_id, i.hour, i.rn, CASE WHEN i.reset THEN 0.0 WHEN i.x IS NULL THEN l.recursive_step
  ELSE least(greatest(l.recursive_step + {W48} * (i.x - l.recursive_step), -1.2), 1.2) END, i.x
FROM smooth_levels l JOIN smooth_inputs i ON i.station_id = l.station_id AND i.rn = l.rn + 1""")


def smooth_inputs(spark, sf):
    hours = grid.hourly_grid(tables.dense(spark, sf))
    x = F.col("temperature") - 22
    return hours.select(
        "station_id", "hour", F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-4.0)), F.lit(4.0))).alias("x"),
        (F.col("hour") % 101 == 0).alias("reset"),
    )


@register("f13_reset_capped_ewma", 'SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", round(recursive_step, 9) + 0.0 AS level FROM smooth_levels')
def reset_capped_ewma(spark, sf):
    scans = {"level": smoothing(F.col("x"), W48, F.col("reset"), F.lit(1.2))}
    out = clipped_scan(smooth_inputs(spark, sf), ["station_id"], "hour", scans, HOUR_CHUNK)
    return out.select("station_id", from_hour(F.col("hour")).alias("timestamp"), r9("level").alias("level"))


WL, WS = events.slot_weight(K.DRIFT_HOURS), events.slot_weight(K.DRIFT_CONFIRM_HOURS)
cte("drift_inputs", """
SELECT z.station_id, z.slot, row_number() OVER (PARTITION BY z.station_id ORDER BY z.slot) AS rn, CASE WHEN z.temperature IS NOT NULL THEN least(greatest(z.temperature, -4), 4) END AS za,
  CASE WHEN z.temperature IS NOT NULL THEN least(greatest(z.temperature + 0.5, -4), 4) END AS ra,
  CASE WHEN z.dissolved_oxygen IS NOT NULL THEN least(greatest(z.dissolved_oxygen, -4), 4) END AS zb,
  CASE WHEN z.dissolved_oxygen IS NOT NULL THEN least(greatest(z.dissolved_oxygen - 0.25, -4), 4) END AS rb,
  d.candidate AS reset FROM dep_z z JOIN departing d USING (station_id, slot)""")


def _sql_smooth(prev, x, weight, cap):
    step = f"{prev} + {weight} * (i.{x} - {prev})"
    bounded = f"least(greatest({step}, -{cap}), {cap})" if cap else step
    return f"CASE WHEN i.reset THEN 0.0 WHEN i.{x} IS NULL THEN {prev} ELSE {bounded} END"


# Limits 0.9 and 1.0 stand in for learned ones; the cap is 1.5 times the limit.
_DRIFT_STEP = (("za", WL, 1.35), ("ra", WS, None), ("zb", WL, 1.5), ("rb", WS, None))
cte("drift_scan", f"""
SELECT i.station_id, i.slot, i.rn, {', '.join(f"{_sql_smooth('0.0::DOUBLE', x, w, c)} AS l_{x}" for x, w, c in _DRIFT_STEP)}, 1 AS recursive_step
FROM drift_inputs i WHERE i.rn = 1
UNION ALL
SELECT i.station_id, i.slot, i.rn, {', '.join(_sql_smooth(f'l.l_{x}', x, w, c) for x, w, c in _DRIFT_STEP)}, 1
FROM drift_scan l JOIN drift_inputs i ON i.station_id = l.station_id AND i.rn = l.rn + 1""")


@register("f14_drift_level", f"""
SELECT station_id, {T0}, round(CASE WHEN sign(l_za) = sign(l_ra) AND abs(l_ra) >= 0.45 THEN abs(l_za) / 0.9 ELSE 0 END, 9) AS temperature,
  round(CASE WHEN sign(l_zb) = sign(l_rb) AND abs(l_rb) >= 0.5 THEN abs(l_zb) / 1.0 ELSE 0 END, 9) AS dissolved_oxygen FROM drift_scan""")
def drift_level(spark, sf):
    z = with_departures(spark, sf).select("station_id", "slot", "candidate", "dep_temperature", "dep_dissolved_oxygen")
    pairs = {
        "temperature": (F.col("dep_temperature"), F.col("dep_temperature") + 0.5, F.col("candidate")),
        "dissolved_oxygen": (F.col("dep_dissolved_oxygen"), F.col("dep_dissolved_oxygen") - 0.25, F.col("candidate")),
    }
    out = events.drift_levels(z, pairs, {"temperature": F.lit(0.9), "dissolved_oxygen": F.lit(1.0)})
    return stamped(out, [r9("temperature").alias("temperature"), r9("dissolved_oxygen").alias("dissolved_oxygen")])


cte("gappy_base", """SELECT a.hour, a.rain_mm, a.air_temperature, a.cloud_cover FROM gappy_hours a""")
cte("weather_memory_rows", "SELECT t.hour, " + ", ".join(
    [f"ln(1 + sum(coalesce(s.rain_mm, 0) * exp((s.hour - t.hour) / {h}.0::DOUBLE))) AS rain_{h}h" for h in K.RAIN_MEMORY_HOURS]
    + [f"sum(s.air_temperature * exp((s.hour - t.hour) / {h}.0::DOUBLE)) / sum(CASE WHEN s.air_temperature IS NOT NULL THEN exp((s.hour - t.hour) / {h}.0::DOUBLE) END) AS air_{h}h" for h in K.AIR_MEMORY_HOURS]
    + ["sum(s.cloud_cover * exp((s.hour - t.hour) / 3.0::DOUBLE)) / sum(CASE WHEN s.cloud_cover IS NOT NULL THEN exp((s.hour - t.hour) / 3.0::DOUBLE) END) AS cloud_3h"]
) + " FROM gappy_base t JOIN gappy_base s ON s.hour <= t.hour GROUP BY t.hour")
MEMORY = [*[f"rain_{h}h" for h in K.RAIN_MEMORY_HOURS], *[f"air_{h}h" for h in K.AIR_MEMORY_HOURS], "cloud_3h"]


@register("f15_weather_memory", f"""
SELECT make_timestamp(hour * 3600000000) AS "timestamp", {', '.join(f'round({c}, 8) + 0.0 AS {c}' for c in MEMORY)} FROM weather_memory_rows""")
def memory(spark, sf):
    out = weather_memory(tables.weather_gappy(spark, sf))
    return out.select(from_hour(F.col("hour")).alias("timestamp"), *[(F.round(c, 8) + 0.0).alias(c) for c in MEMORY])


# ---------------------------------------------------------------------------- time joins (D12, D13), injected faults

cte("lab_beside_sensors", """
SELECT l.src_ord, l.station_id, h.temperature, h.ph, h.turbidity, h.dissolved_oxygen
FROM lab l ASOF JOIN (SELECT station_id, make_timestamp((hour + 1) * 3600000000) AS hour_end, temperature, ph, turbidity, dissolved_oxygen FROM hour_grid) h
ON l.station_id = h.station_id AND l."timestamp" >= h.hour_end
WHERE l."timestamp" - h.hour_end <= INTERVAL 2 HOUR AND h.temperature IS NOT NULL AND h.ph IS NOT NULL AND h.turbidity IS NOT NULL AND h.dissolved_oxygen IS NOT NULL""")


@register("d12_as_of_join", "SELECT src_ord, station_id, " + ", ".join(f"round({s}, 9) AS {s}" for s in S) + " FROM lab_beside_sensors")
def lab_beside_sensors(spark, sf):
    from tarnwatch.operators.lab import beside_sensors

    hourly = grid.hourly_grid(tables.readings(spark, sf))
    out = beside_sensors(tables.lab(spark, sf), hourly)
    return out.select("src_ord", "station_id", *[r9(s).alias(s) for s in S])


@register("d12_as_of_raw_readings", """
SELECT l.src_ord, CASE WHEN l."timestamp" - r."timestamp" <= INTERVAL 2 HOUR THEN r.src_ord END AS reading
FROM lab l ASOF LEFT JOIN (SELECT station_id, "timestamp", max(src_ord) AS src_ord FROM readings GROUP BY ALL) r
ON l.station_id = r.station_id AND l."timestamp" >= r."timestamp" """)
def as_of_raw(spark, sf):
    lab = tables.lab(spark, sf).select("station_id", "src_ord", micros(F.col("timestamp")).alias("at"))
    facts = tables.readings(spark, sf).select("station_id", F.col("src_ord").alias("reading"), micros(F.col("timestamp")).alias("at"))
    out = joins.as_of_row(lab, facts, ["station_id"], "at", ["reading"], 2 * joins.HOUR_US)
    return out.select("src_ord", "reading")


@register("d13_interval_join", """
SELECT e.ep, r.src_ord FROM episodes e JOIN readings r ON r.station_id = e.station_id AND r."timestamp" BETWEEN e."start" AND e."end" """)
def interval_join(spark, sf):
    points = tables.readings(spark, sf).select("station_id", "src_ord", micros(F.col("timestamp")).alias("at"))
    spans = tables.episodes(spark, sf).select("ep", "station_id", micros(F.col("start")).alias("lo"), micros(F.col("end")).alias("hi"))
    out = joins.interval_pairs(points, spans, ["station_id"], "at", "lo", "hi", joins.HOUR_US)
    return out.select("ep", "src_ord")


@register("d13_interval_totals", """
SELECT e.ep, count(*) AS points, round(sum(r.temperature), 6) AS total, min(r.temperature) AS least, max(r.temperature) AS greatest
FROM episodes e JOIN readings r ON r.station_id = e.station_id AND r."timestamp" BETWEEN e."start" AND e."end" GROUP BY 1""")
def interval_totals(spark, sf):
    points = tables.readings(spark, sf).withColumn("at", micros(F.col("timestamp")))
    spans = tables.episodes(spark, sf).withColumns({"lo": micros(F.col("start")), "hi": micros(F.col("end"))})
    out = joins.interval_totals(points, spans, ["station_id"], "ep", "at", "lo", "hi", "temperature", joins.HOUR_US)
    return out.select("ep", "points", F.round("total", 6).alias("total"), "least", "greatest")


cte("fault_log_base", """
SELECT ep, station_id, "start", "start" + (2 + ep % 9) * INTERVAL 1 HOUR AS "end" FROM episodes
UNION ALL SELECT ep + 1000003, station_id, "start", "start" + (1 + ep % 17) * INTERVAL 1 HOUR FROM episodes WHERE ep % 4 = 0
UNION ALL SELECT ep + 2000003, station_id, "start" - INTERVAL 3 HOUR, "start" + INTERVAL 11 HOUR FROM episodes WHERE ep % 6 = 0""")
cte("fault_log", """
SELECT ep, station_id, "start", "end", (CASE WHEN ep % 2 = 0 THEN 1 ELSE -1 END) * (0.8 + (ep % 7) / 10.0::DOUBLE) AS size,
  ['spike', 'offset', 'drift', 'oscillation', 'flatline', 'event', 'dropout'][1 + ep % 7] AS kind,
  CASE WHEN ep % 7 >= 5 THEN '' ELSE ['temperature', 'ph', 'turbidity', 'dissolved_oxygen'][1 + (ep // 7) % 4] END AS sensor FROM fault_log_base""")


def fault_log(spark, sf):
    """Episodes of unequal length, some with a second one of the same start, some inside a longer one."""
    kinds = F.array(*[F.lit(k) for k in ("spike", "offset", "drift", "oscillation", "flatline", "event", "dropout")])
    sensors = F.array(*[F.lit(s) for s in S])
    ep = F.col("ep")
    log = tables.episodes(spark, sf).select("ep", "station_id", "start")

    def hours(n):
        return F.make_dt_interval(F.lit(0), n.cast("int"))

    same = log.filter("ep % 4 = 0").select((ep + 1000003).alias("ep"), "station_id", "start", (F.col("start") + hours(1 + ep % 17)).alias("end"))
    around = log.filter("ep % 6 = 0").select((ep + 2000003).alias("ep"), "station_id", (F.col("start") - hours(F.lit(3))).alias("start"), (F.col("start") + hours(F.lit(11))).alias("end"))
    log = log.withColumn("end", F.col("start") + hours(2 + ep % 9)).unionByName(same).unionByName(around)
    return log.select(
        "ep", "station_id", "start", "end",
        (F.when(ep % 2 == 0, 1.0).otherwise(-1.0) * (0.8 + (ep % 7) / 10)).alias("size"),
        F.get(kinds, (ep % 7).cast("int")).alias("kind"),
        F.when(ep % 7 >= 5, "").otherwise(F.get(sensors, F.expr("cast((ep div 7) % 4 as int)"))).alias("sensor"),
    )


cte("fault_spans", """
SELECT * FROM (SELECT ep, station_id, kind, sensor, size, CAST(ceil(epoch_us("start") / 600000000.0) AS BIGINT) AS first, epoch_us("end") // 600000000 AS last FROM fault_log)
WHERE last >= first""")
cte("fault_acting", """
SELECT g.station_id, g.slot, e.* EXCLUDE (station_id) FROM slot_grid g JOIN fault_spans e ON e.station_id = g.station_id AND g.slot BETWEEN e.first AND e.last
QUALIFY row_number() OVER (PARTITION BY g.station_id, g.slot ORDER BY e.first DESC, e.ep) = 1""")
cte("fault_rows", """
SELECT g.station_id, g.slot, g.temperature, g.ph, g.turbidity, g.dissolved_oxygen, e.ep, coalesce(e.kind, '') AS kind, e.sensor, e.size,
  g.slot - e.first AS pos, e.last - e.first AS span
FROM slot_grid g LEFT JOIN fault_acting e USING (station_id, slot)""")
cte("fault_held", "SELECT *, " + ", ".join(
    f"first_value({s} IGNORE NULLS) OVER (PARTITION BY station_id, ep ORDER BY slot ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS held_{s}" for s in S)
    + """, CASE WHEN span > 0 THEN pos / span::DOUBLE ELSE 0 END AS along FROM fault_rows""")


def _sql_fault(s):
    w = f"ln(1 + greatest({s}, 0))" if s == "turbidity" else s

    def back(x):
        y = f"(exp({x}) - 1)" if s == "turbidity" else f"({x})"
        return f"greatest({y}, 0)" if s in ("turbidity", "dissolved_oxygen") else y

    arms = ["WHEN kind = 'dropout' OR " + s + " IS NULL AND NOT (kind = 'flatline' AND sensor = '" + s + "') THEN NULL"]
    if s in K.EVENT_EFFECT:
        pulse = "least(greatest(least(along / 0.2, (1.0 - along) / 0.4), 0), 1)"
        arms.append(f"WHEN kind = 'event' THEN {back(f'{w} + abs(size) * {K.EVENT_EFFECT[s]} * {pulse}')}")
    arms.append(f"WHEN kind = 'flatline' AND sensor = '{s}' THEN coalesce(held_{s}, {s})")
    for k, shape in (("spike", "1"), ("offset", "1"), ("drift", "along"), ("oscillation", "CASE WHEN pos % 2 = 0 THEN 1 ELSE -1 END")):
        arms.append(f"WHEN kind = '{k}' AND sensor = '{s}' THEN {back(f'{w} + size * {K.FAULT_SIZE[k][s]} * ({shape})')}")
    return f"round(CASE {' '.join(arms)} ELSE {s} END, 9) + 0.0 AS {s}"


@register("i9_apply_episodes", f"SELECT station_id, {T0}, kind, {', '.join(_sql_fault(s) for s in S)} FROM fault_held")
def apply_episodes(spark, sf):
    out = faults.apply_episodes(grid.slot_grid(tables.readings(spark, sf)), fault_log(spark, sf))
    return stamped(out, ["kind", *[r9(s).alias(s) for s in S]])


# ---------------------------------------------------------------------------- detector inputs

cte("scaled_steps", "SELECT c.station_id, c.slot, " + ", ".join(
    f"(c.{s} - lag(c.{s}) OVER (PARTITION BY c.station_id ORDER BY c.slot)) / (SELECT scale FROM own_step_scales x WHERE x.sensor = '{s}' AND x.station_id = c.station_id) AS {s}" for s in S) + " FROM clean c")
W6 = "OVER (PARTITION BY station_id ORDER BY slot ROWS 5 PRECEDING)"


@register("f27_wobble", f"""
SELECT station_id, {T0}, {', '.join(f"round(CASE WHEN count({s}) {W6} >= 2 THEN stddev_samp({s}) {W6} END, 7) AS {s}" for s in S)} FROM scaled_steps""")
def wobble(spark, sf):
    from tarnwatch.operators.chunks import framed

    g = dense_grid(spark, sf)
    scales = robust.step_scales(g)
    flagged = lake_qc.rule_tests(robust.scale_columns(g, scales, K.RESOLUTION))
    clean = lake_qc.clean_values(flagged, K.SHAPE_FAULTS)

    def step(w):
        return {f"_st_{s}": (F.col(s) - F.lag(s).over(w)) / F.col(f"scale_{s}") for s in S}

    def spread(w):
        six = w.rowsBetween(-5, 0)
        return {f"_wb_{s}": F.when(F.count(f"_st_{s}").over(six) >= 2, F.stddev_samp(f"_st_{s}").over(six)) for s in S}

    out = framed(clean, ["station_id"], "slot", [step, spread], before=6, width=SLOT_CHUNK)
    return stamped(out, [F.round(f"_wb_{s}", 7).alias(s) for s in S])


F288 = "OVER (PARTITION BY station_id ORDER BY slot ROWS 287 PRECEDING)"


@register("h12_design_matrix", f"""
SELECT c.station_id, make_timestamp(c.slot * 600000000) AS "timestamp", round(c.anchor, 9) AS temperature_anchor, round(sin(2 * pi() * (c.slot % 144) / 144), 9) + 0.0 AS hour_sin,
  round(cos(2 * pi() * (c.slot % 144) / 144), 9) + 0.0 AS hour_cos, round(coalesce(m.rain_36h, 0), 8) + 0.0 AS rain_36h, round(m.air_96h, 8) AS air_96h, round(m.cloud_3h, 8) AS cloud_3h
FROM (SELECT *, CASE WHEN count(temperature) {F288} >= 144 THEN median(temperature) {F288} END AS anchor FROM clean) c LEFT JOIN weather_memory_rows m ON m.hour = c.slot // 6""")
def design_matrix(spark, sf):
    from tarnwatch.models.detector import LakeDetector

    detector = LakeDetector()
    w = tables.weather_gappy(spark, sf)
    detector._remember(w)
    clean = clean_grid(spark, sf)
    anchored = robust.trailing_medians(clean, ["temperature"], K.ANCHOR_SLOTS, K.SLOTS_PER_DAY, "_anchor")
    out = detector.design(anchored.withColumnRenamed("temperature_anchor", "anchor"), w)
    cols = ["rain_36h", "air_96h", "cloud_3h"]
    return stamped(out, [r9("anchor").alias("temperature_anchor"), r9("hour_sin").alias("hour_sin"), r9("hour_cos").alias("hour_cos"), *[(F.round(c, 8) + 0.0).alias(c) for c in cols]])
