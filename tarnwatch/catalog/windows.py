"""Queries for robust statistics, lake QC, run lengths and long medians."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_slot
from tarnwatch.functions.working import r9
from tarnwatch.operators import grid, lake_qc, robust
from tarnwatch.operators.chunks import SLOT_CHUNK, framed
from tarnwatch.sources import tables

from .oracle import cte
from .registry import register

S = K.LAKE_SENSORS
T0 = 'make_timestamp(slot * 600000000) AS "timestamp"'
W = "OVER (PARTITION BY station_id ORDER BY slot)"


def dense_grid(spark, sf):
    return grid.slot_grid(tables.dense(spark, sf))


def stamped(df, cols):
    return df.select("station_id", from_slot(F.col("slot")).alias("timestamp"), *cols)


def _sql_working(s):
    lo, hi = K.VALID_RANGES[s]
    x = f"CASE WHEN {s} BETWEEN {lo} AND {hi} THEN {s} END"
    return f"ln(1 + {x})" if s == "turbidity" else x


cte("work", "SELECT station_id, slot, " + ", ".join(f"{_sql_working(s)} AS {s}" for s in S) + " FROM d_slot_grid")
cte("work_steps", "SELECT station_id, slot, " + ", ".join(f"{s} - lag({s}) {W} AS {s}" for s in S) + " FROM work")


def _sql_long(table, keys="station_id"):
    return " UNION ALL ".join(f"SELECT {keys}, '{s}' AS sensor, {s} AS value FROM {table} WHERE {s} IS NOT NULL" for s in S)


def _floors(values):
    return "CASE sensor " + " ".join(f"WHEN '{s}' THEN {v}" for s, v in values.items()) + " END"


cte("work_long", _sql_long("work"))
cte("step_long", _sql_long("work_steps"))
cte("scale_mid", """
SELECT station_id, sensor, median(value) AS mid FROM work_long GROUP BY GROUPING SETS ((station_id, sensor), (sensor))""")
cte("work_scales", f"""
SELECT m.station_id, m.sensor, greatest(1.4826 * median(abs(l.value - m.mid)), {_floors(K.MIN_SCALE).replace('sensor', 'm.sensor')}) AS scale
FROM work_long l JOIN scale_mid m ON l.sensor = m.sensor AND (m.station_id IS NULL OR l.station_id = m.station_id) GROUP BY m.station_id, m.sensor""")
cte("step_mid", "SELECT station_id, sensor, median(value) AS mid FROM step_long GROUP BY ALL")
cte("own_step_scales", f"""
SELECT l.station_id, l.sensor, greatest(1.4826 * median(abs(l.value - m.mid)), {_floors(K.RESOLUTION).replace('sensor', 'l.sensor')}) AS scale
FROM step_long l JOIN step_mid m USING (station_id, sensor) GROUP BY l.station_id, l.sensor""")
cte("step_scales", """
SELECT * FROM own_step_scales UNION ALL SELECT NULL, sensor, median(scale) FROM own_step_scales GROUP BY sensor""")


@register("e5_robust_std", f"""
SELECT l.sensor, round(greatest(1.4826 * median(abs(l.value - m.mid)), {_floors(K.MIN_SCALE).replace('sensor', 'l.sensor')}), 9) AS scale
FROM work_long l JOIN (SELECT sensor, median(value) AS mid FROM work_long GROUP BY 1) m USING (sensor) GROUP BY l.sensor""")
def robust_std(spark, sf):
    from tarnwatch.operators.order_stats import robust_std as spread

    values = robust.long(robust.working(dense_grid(spark, sf)), ["station_id"])
    return spread(values, ["sensor"], "value", robust.per_sensor(K.MIN_SCALE)).withColumn("scale", r9("scale"))


def by_sensor(table):
    """A wide parameter table as (station_id, sensor, scale) rows."""
    out = table.unpivot(["station_id"], [f"scale_{s}" for s in S], "sensor", "scale")
    return out.select("station_id", F.regexp_replace("sensor", "^scale_", "").alias("sensor"), r9("scale").alias("scale"))


@register("e6_scales_two_level", "SELECT station_id, sensor, round(scale, 9) AS scale FROM work_scales")
def scales_two_level(spark, sf):
    return by_sensor(robust.scales(robust.working(dense_grid(spark, sf))))


@register("e6_scale_lookup", f"""
SELECT a.station_id, {', '.join(f"round(coalesce(max(w.scale) FILTER (w.sensor = '{s}'), max(p.scale) FILTER (p.sensor = '{s}')), 9) AS scale_{s}" for s in S)}
FROM (SELECT DISTINCT station_id FROM readings) a LEFT JOIN work_scales w USING (station_id) LEFT JOIN (SELECT * FROM work_scales WHERE station_id IS NULL) p ON true
GROUP BY 1""")
def scale_lookup(spark, sf):
    table = robust.scales(robust.working(dense_grid(spark, sf)))
    # Stations st2 and st3 were never seen in the dense table, so the all-station scale stands in.
    stations = tables.readings(spark, sf).select("station_id").distinct()
    out = robust.scale_columns(stations, table)
    return out.select("station_id", *[r9(f"scale_{s}").alias(f"scale_{s}") for s in S])


@register("e7_step_scale", "SELECT station_id, sensor, round(scale, 9) AS scale FROM step_scales")
def step_scale(spark, sf):
    return by_sensor(robust.step_scales(dense_grid(spark, sf)))


def _sql_bands(table, keys):
    return ", ".join(
        f"CASE WHEN count({s}) >= 144 THEN quantile_cont({s}, 0.001) - 0.1 * (quantile_cont({s}, 0.999) - quantile_cont({s}, 0.001)) END AS {s}_low, "
        f"CASE WHEN count({s}) >= 144 THEN quantile_cont({s}, 0.999) + 0.1 * (quantile_cont({s}, 0.999) - quantile_cont({s}, 0.001)) END AS {s}_high"
        for s in S
    )


cte("month_bands", f"""
SELECT station_id, month(make_timestamp(slot * 600000000)) AS month, {_sql_bands('work', '')} FROM work GROUP BY 1, 2""")
cte("work_envelope", f"""
SELECT station_id, {_sql_bands('work', '')} FROM work GROUP BY GROUPING SETS ((station_id), ())""")
BAND_COLS = [f"{s}_{side}" for s in S for side in ("low", "high")]


@register("e8_monthly_bands", f"SELECT station_id, CAST(month AS BIGINT) AS month, {', '.join(f'round({c}, 9) AS {c}' for c in BAND_COLS)} FROM month_bands")
def monthly_bands(spark, sf):
    out = robust.monthly_bands(robust.working(dense_grid(spark, sf)))
    return out.select("station_id", F.col("month").cast("bigint").alias("month"), *[r9(c).alias(c) for c in BAND_COLS])


@register("e8_envelope_two_level", f"SELECT station_id, {', '.join(f'round({c}, 9) AS {c}' for c in BAND_COLS)} FROM work_envelope")
def envelope_two_level(spark, sf):
    out = robust.envelope(robust.working(dense_grid(spark, sf)))
    return out.select("station_id", *[r9(c).alias(c) for c in BAND_COLS])


@register("h13_inside_envelope", f"""
SELECT w.station_id, {T0}, {', '.join(f"coalesce(w.{s} BETWEEN e.{s}_low AND e.{s}_high, false) AS inside_{s}" for s in S)}
FROM work w JOIN (SELECT station_id, {_sql_bands('work', '')} FROM work WHERE slot % 3 = 0 GROUP BY 1) e USING (station_id)""")
def inside_envelope(spark, sf):
    work = robust.working(dense_grid(spark, sf))
    table = robust.envelope(work.filter("slot % 3 = 0"))
    return stamped(robust.inside_envelope(work, table, S), [f"inside_{s}" for s in S])


@register("f1_one_step_difference", f"SELECT station_id, {T0}, {', '.join(f'round({s}, 9) + 0.0 AS {s}' for s in S)} FROM work_steps")
def one_step(spark, sf):
    return stamped(robust.steps(robust.working(dense_grid(spark, sf))), [r9(s).alias(s) for s in S])


cte("temp_same", f"""
SELECT station_id, slot, temperature, coalesce(abs(temperature - lag(temperature) {W}) <= 0.001, false) AS same FROM d_slot_grid""")


@register("f2_run_length", f"""
SELECT station_id, {T0}, CAST(CASE WHEN same THEN slot - max(CASE WHEN NOT same THEN slot END) {W} ELSE 0 END AS BIGINT) + 1 AS repeats FROM temp_same""")
def run_length(spark, sf):
    from tarnwatch.operators.runs import unchanged_run

    return stamped(unchanged_run(dense_grid(spark, sf), "temperature", K.RESOLUTION["temperature"]), ["repeats"])


F5 = "OVER (PARTITION BY station_id ORDER BY slot ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)"
cte("work_off", "SELECT station_id, slot, " + ", ".join(
    f"CASE WHEN count({s}) {F5} >= 3 THEN abs({s} - median({s}) {F5}) END AS {s}" for s in S) + " FROM work")


@register("f3_spike_deviation", f"SELECT station_id, {T0}, {', '.join(f'round({s}, 9) + 0.0 AS {s}' for s in S)} FROM work_off")
def spike_deviation(spark, sf):
    def off(w):
        five = w.rowsBetween(-2, 2)
        return {
            f"off_{s}": F.when(F.count(s).over(five) >= 3, F.abs(F.col(s) - F.percentile(s, F.lit(0.5)).over(five))) for s in S
        }

    out = framed(robust.working(dense_grid(spark, sf)), ["station_id"], "slot", [off], before=2, after=2, width=SLOT_CHUNK)
    return stamped(out, [r9(f"off_{s}").alias(s) for s in S])


@register("f4_rate_of_change", f"""
SELECT station_id, {T0}, {', '.join(f"round(abs(st.{s}) / (SELECT scale FROM own_step_scales o WHERE o.sensor = '{s}' AND o.station_id = st.station_id), 9) AS {s}" for s in S)}
FROM work_steps st""")
def rate_of_change(spark, sf):
    g = dense_grid(spark, sf)
    rates = robust.scale_columns(robust.steps(robust.working(g)), robust.step_scales(g), K.RESOLUTION)
    return stamped(rates, [r9(F.abs(F.col(s)) / F.col(f"scale_{s}")).alias(s) for s in S])


def _sql_qc(bands):
    """The rule tests written over whole stations, one sensor at a time."""
    parts = []
    for s in S:
        lo, hi = K.VALID_RANGES[s]
        season = f"coalesce(w < {s}_low OR w > {s}_high, false)" if bands else "false"
        parts.append(f"""
  SELECT station_id, slot, '{s}' AS sensor,
    CASE WHEN x IS NULL THEN 9 WHEN NOT (x BETWEEN {lo} AND {hi}) OR coalesce(off / scale >= 12, false) OR repeats >= 24 THEN 4
         WHEN {season} OR coalesce(off / scale >= 6, false) OR coalesce(rate / scale >= 8, false) OR repeats >= 12 THEN 3 ELSE 1 END AS qc,
    CASE WHEN x IS NULL THEN 'missing' WHEN NOT (x BETWEEN {lo} AND {hi}) THEN 'out_of_range' WHEN repeats >= 12 THEN 'flatline'
         WHEN coalesce(off / scale >= 6, false) THEN 'spike' WHEN coalesce(rate / scale >= 8, false) THEN 'rate_of_change'
         WHEN {season} THEN 'climatology' ELSE '' END AS reason
  FROM (SELECT g.station_id, g.slot, g.{s} AS x, w.{s} AS w, o.{s} AS off, abs(st.{s}) AS rate, r.repeats,
          (SELECT scale FROM own_step_scales c WHERE c.sensor = '{s}' AND c.station_id = g.station_id) AS scale{f", b.{s}_low, b.{s}_high" if bands else ""}
        FROM d_slot_grid g JOIN work w USING (station_id, slot) JOIN work_off o USING (station_id, slot) JOIN work_steps st USING (station_id, slot)
        JOIN (SELECT station_id, slot, CASE WHEN same THEN slot - max(CASE WHEN NOT same THEN slot END) {W} ELSE 0 END + 1 AS repeats
              FROM (SELECT station_id, slot, coalesce(abs({s} - lag({s}) {W}) <= {K.RESOLUTION[s]}, false) AS same FROM d_slot_grid)) r USING (station_id, slot)
        {"LEFT JOIN month_bands b ON b.station_id = g.station_id AND b.month = month(make_timestamp(g.slot * 600000000)) + 0" if bands else ""})""")
    return " UNION ALL ".join(parts)


cte("qc_long", _sql_qc(False))
cte("qc_season_long", _sql_qc(True))


def _sql_qc_wide(table):
    cols = ", ".join(
        f"max(qc) FILTER (sensor = '{s}') AS {s}_qc, max(reason) FILTER (sensor = '{s}') AS {s}_reason" for s in S
    )
    return f"SELECT station_id, slot, {cols} FROM {table} GROUP BY 1, 2"


cte("qc_wide", _sql_qc_wide("qc_long"))
QC_COLS = [f"{s}_{k}" for s in S for k in ("qc", "reason")]


def scaled_grid(spark, sf):
    g = dense_grid(spark, sf)
    return robust.scale_columns(g, robust.step_scales(g), K.RESOLUTION)


@register("f6_qc_flags", f"SELECT station_id, {T0}, {', '.join(QC_COLS)} FROM qc_wide")
def qc_flags(spark, sf):
    return stamped(lake_qc.rule_tests(scaled_grid(spark, sf)), QC_COLS)


@register("f5_qc_with_season", f"SELECT station_id, {T0}, {', '.join(QC_COLS)} FROM ({_sql_qc_wide('qc_season_long')})")
def qc_with_season(spark, sf):
    g = scaled_grid(spark, sf)
    banded = robust.with_monthly_bands(g, robust.monthly_bands(robust.working(g)))
    return stamped(lake_qc.rule_tests(banded, bands=True), QC_COLS)


@register("d8_climatology_lookup", f"""
SELECT g.station_id, {T0}, {', '.join(f'round(b.{c}, 9) AS {c}' for c in BAND_COLS)}
FROM slot_grid g LEFT JOIN month_bands b ON b.station_id = g.station_id AND b.month = month(make_timestamp(g.slot * 600000000))""")
def climatology_lookup(spark, sf):
    table = robust.monthly_bands(robust.working(dense_grid(spark, sf)))
    out = robust.with_monthly_bands(grid.slot_grid(tables.readings(spark, sf)), table)
    return stamped(out, [r9(c).alias(c) for c in BAND_COLS])


def clean_grid(spark, sf):
    """Working-scale readings that pass the shape tests."""
    flagged = lake_qc.rule_tests(scaled_grid(spark, sf))
    return lake_qc.clean_values(flagged, K.SHAPE_FAULTS).select("station_id", "slot", *S)


cte("clean", "SELECT w.station_id, w.slot, " + ", ".join(
    f"CASE WHEN q.{s}_reason NOT IN ('out_of_range', 'flatline', 'spike') THEN w.{s} END AS {s}" for s in S)
    + " FROM work w JOIN qc_wide q USING (station_id, slot)")
F1008 = "OVER (PARTITION BY station_id ORDER BY slot ROWS 1007 PRECEDING)"
cte("baseline", "SELECT station_id, slot, " + ", ".join(
    f"CASE WHEN count({s}) {F1008} >= 144 THEN median({s}) {F1008} END AS {s}_base, {s}" for s in S) + " FROM clean")


@register("f7_trailing_median", f"""
SELECT station_id, {T0}, {', '.join(f'round({s}_base, 9) AS {s}' for s in S)} FROM baseline""")
def trailing_median(spark, sf):
    out = robust.trailing_medians(clean_grid(spark, sf), S, K.BASELINE_SLOTS, K.SLOTS_PER_DAY)
    return stamped(out, [r9(f"{s}_base").alias(s) for s in S])


@register("f11_detrend", f"""
SELECT station_id, {T0}, {', '.join(f'round({s} - coalesce({s}_base, 0), 9) + 0.0 AS {s}' for s in S)} FROM baseline""")
def detrend(spark, sf):
    out = robust.trailing_medians(clean_grid(spark, sf), S, K.BASELINE_SLOTS, K.SLOTS_PER_DAY)
    return stamped(out, [r9(F.col(s) - F.coalesce(F.col(f"{s}_base"), F.lit(0.0))).alias(s) for s in S])
