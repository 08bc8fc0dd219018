"""Queries for row-level grading: air units and index, WQI, CPCB class, trophic state, bands (section C)."""

from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import airindex, checks, odds, timing, water
from tarnwatch.functions.parse import parse_numeric
from tarnwatch.functions.working import r9
from tarnwatch.operators.order_stats import median
from tarnwatch.sources import tables

from .oracle import cte
from .registry import register

cte("graded_rows", """
SELECT event_id AS src_ord, CASE WHEN event_id % 29 <> 0 THEN ((13 * v) % 1400) / 100.0::DOUBLE END AS oxygen,
  5.5 + ((7 * v) % 400) / 100.0::DOUBLE AS ph, ((3 * v) % 101) / 100.0::DOUBLE AS p_bod_2, ((5 * v) % 101) / 100.0::DOUBLE AS p_bod_3,
  ((11 * v) % 101) / 100.0::DOUBLE AS p_coliform_50, ((17 * v) % 101) / 100.0::DOUBLE AS p_coliform_500,
  ((19 * v) % 101) / 100.0::DOUBLE AS p_coliform_5000, 1 + (v % 900) / 10.0::DOUBLE AS chlorophyll,
  ((v * v) % 9000)::DOUBLE AS coliform, v % 72 - 12 AS horizon
FROM ev""")
cte("lab_numbers", """
SELECT *, CASE WHEN bod LIKE '<%' THEN try_cast(substr(bod, 2) AS DOUBLE) / 2 ELSE try_cast(bod AS DOUBLE) END AS bod_n,
  CASE WHEN chlorophyll_a LIKE '<%' THEN try_cast(substr(chlorophyll_a, 2) AS DOUBLE) / 2 ELSE try_cast(chlorophyll_a AS DOUBLE) END AS chl_n,
  CASE WHEN total_coliform LIKE '<%' THEN try_cast(substr(total_coliform, 2) AS DOUBLE) / 2 ELSE try_cast(total_coliform AS DOUBLE) END AS col_n
FROM lab""")


def _sql_mass(gas):
    return f"{gas} * {K.MOLECULAR_WEIGHT[gas]} * 1000 / 24.45" + (" / 1000" if gas == "co" else "")


def _sql_sub_index(expr, pollutant):
    """Piecewise line written as a sum of clipped segments, independent of the Spark expression's shape."""
    pts, edges = K.BREAKPOINTS[pollutant], K.INDEX_EDGES
    parts = [
        f"greatest(0, least({expr}, {x1}) - {x0}) * ({(y1 - y0)}::DOUBLE / {x1 - x0})"
        for x0, x1, y0, y1 in zip(pts, pts[1:], edges, edges[1:])
    ]
    return f"CASE WHEN {expr} IS NOT NULL THEN {' + '.join(parts)} END"


SQL_CATEGORY = "CASE WHEN {x} IS NULL THEN 'insufficient data' " + " ".join(
    f"WHEN round_even({{x}}, 0) <= {u} THEN '{n}'" for u, n, _ in K.AQI_CATEGORIES[:-1]) + " ELSE 'Severe' END"


def sql_category(x):
    return SQL_CATEGORY.replace("{x}", x)


@register("c9_ppm_to_mass", f"""
SELECT src_ord, {', '.join(f'round({_sql_mass(g)}, 9) + 0.0 AS {g}' for g in ('o3', 'no2', 'co', 'so2'))} FROM air""")
def ppm_to_mass(spark, sf):
    return tables.air(spark, sf).select(
        "src_ord", *[r9(airindex.ppm_to_mass(g, g)).alias(g) for g in ("o3", "no2", "co", "so2")]
    )


@register("c10_detection_floor", """
SELECT src_ord, CASE WHEN so2 >= -0.027 THEN greatest(so2, 0) END AS so2, so2 < -0.027 AS negative FROM air""")
def detection_floor(spark, sf):
    return tables.air(spark, sf).select(
        "src_ord", airindex.detection_floor("so2", "so2").alias("so2"), airindex.too_negative("so2", "so2").alias("negative")
    )


@register("c11_humidity_growth", """
SELECT "timestamp", round(CASE WHEN rh <= 0 THEN 1 ELSE 1 + (0.4 / 1.65) / (1 / (least(rh, 95) / 100) - 1) END, 9) AS growth
FROM (SELECT "timestamp", relative_humidity * 1.3 - 26 AS rh FROM weather)""")
def humidity_growth(spark, sf):
    w = tables.weather(spark, sf).withColumn("rh", F.col("relative_humidity") * 1.3 - 26)
    return w.select("timestamp", r9(airindex.humidity_growth("rh")).alias("growth"))


_WQI_SQL = " + ".join(
    f"greatest(0, ({c} - {K.WQI_IDEAL[n]}) * 100.0 / ({'CASE WHEN ph < 7 THEN 6.5 ELSE 8.5 END' if n == 'ph' else K.WQI_STANDARD[n]} - {K.WQI_IDEAL[n]})) / {K.WQI_STANDARD[n]}"
    for n, c in (("ph", "ph"), ("dissolved_oxygen", "oxygen"), ("turbidity", "turbidity"), ("bod", "bod_n"), ("conductivity", "conductivity"), ("nitrate", "nitrate"))
)
_WQI_K = " + ".join(f"1.0::DOUBLE / {s}" for s in K.WQI_STANDARD.values())
_WQI_CLASS = "CASE WHEN {x} <= 25 THEN 'Excellent' WHEN {x} <= 50 THEN 'Good' WHEN {x} <= 75 THEN 'Poor' WHEN {x} <= 100 THEN 'Very Poor' WHEN {x} IS NOT NULL THEN 'Unsuitable' END"
cte("wqi_inputs", """
SELECT l.src_ord, l.station_id, l."timestamp", g.ph, g.oxygen, 0.05 * (g.src_ord % 300) AS turbidity, l.bod_n, l.conductivity, l.nitrate
FROM lab_numbers l JOIN graded_rows g USING (src_ord)""")
cte("wqi_rows", f"""
SELECT src_ord, station_id, "timestamp", CASE WHEN oxygen IS NOT NULL AND bod_n IS NOT NULL THEN ({_WQI_SQL}) / ({_WQI_K}) END AS wqi FROM wqi_inputs""")


def wqi_inputs(spark, sf):
    """Lab rows with the lake columns the WQI needs (joined on the event they were drawn from)."""
    lab = tables.lab(spark, sf).withColumn("bod", parse_numeric("bod"))
    rows = tables.graded_rows(spark, sf).select(
        "src_ord", "ph", F.col("oxygen").alias("dissolved_oxygen"),
        (F.lit(0.05) * (F.col("src_ord") % 300)).alias("turbidity"),
    )
    return lab.join(rows, "src_ord")


def wqi_rows(spark, sf):
    return wqi_inputs(spark, sf).withColumn("wqi", water.wqi())


@register("c14_quality_rating", f"""
SELECT src_ord, round({_WQI_SQL.split(' + ')[0]} * 8.5, 9) + 0.0 AS ph, CASE WHEN oxygen IS NOT NULL THEN round(greatest(0, (oxygen - 14.6) * 100.0 / (5.0 - 14.6)), 9) + 0.0 END AS dissolved_oxygen
FROM wqi_inputs""")
def quality_rating(spark, sf):
    return wqi_inputs(spark, sf).select(
        "src_ord", *[r9(water.quality_rating(n, n)).alias(n) for n in ("ph", "dissolved_oxygen")]
    )


@register("c15_wqi_and_class", f"""
SELECT src_ord, round(wqi, 6) AS wqi, {_WQI_CLASS.replace('{x}', 'wqi')} AS wqi_class FROM wqi_rows""")
def wqi_and_class(spark, sf):
    return wqi_rows(spark, sf).select("src_ord", F.round("wqi", 6).alias("wqi"), water.wqi_class("wqi").alias("wqi_class"))


@register("c15_wqi_lab_override", f"""
SELECT src_ord, round(({_WQI_SQL.replace('(ph -', '(ph + 0.5 -').replace('ph < 7', 'ph + 0.5 < 7')}) / ({_WQI_K}), 6) AS wqi
FROM wqi_inputs WHERE oxygen IS NOT NULL AND bod_n IS NOT NULL""")
def wqi_lab_override(spark, sf):
    df = wqi_inputs(spark, sf).withColumn("lab_ph", F.col("ph") + 0.5)
    out = df.withColumn("wqi", water.wqi(water.label_columns(df.columns)))
    return out.filter("wqi is not null").select("src_ord", F.round("wqi", 6).alias("wqi"))


@register("c16_wqi_class_bounds", f"""
SELECT src_ord, {_WQI_CLASS.replace('{x}', 'edge')} AS wqi_class FROM (SELECT src_ord, (src_ord % 9) * 12.5 + CASE WHEN src_ord % 2 = 0 THEN 0 ELSE 0.01 END AS edge FROM lab)""")
def wqi_class_bounds(spark, sf):
    edge = (F.col("src_ord") % 9) * 12.5 + F.when(F.col("src_ord") % 2 == 0, 0.0).otherwise(0.01)
    return tables.lab(spark, sf).select("src_ord", water.wqi_class(edge).alias("wqi_class"))


@register("c18_sub_index", f"""
SELECT src_ord, {', '.join(f"round({_sql_sub_index(e, p)}, 9) + 0.0 AS {p}" for p, e in (('pm25', 'pm25'), ('pm10', 'pm10 * 2'), ('co', 'co * 10'), ('o3', 'o3 * 10000')))} FROM air""")
def sub_index(spark, sf):
    scaled = {"pm25": F.col("pm25"), "pm10": F.col("pm10") * 2, "co": F.col("co") * 10, "o3": F.col("o3") * 10000}
    return tables.air(spark, sf).select("src_ord", *[r9(airindex.sub_index(x, p)).alias(p) for p, x in scaled.items()])


@register("c19_aqi_category", f"""
SELECT src_ord, {sql_category('x')} AS category FROM (SELECT src_ord, CASE WHEN src_ord % 31 <> 0 THEN (src_ord % 1100) / 2.0 END AS x FROM graded_rows)""")
def aqi_category(spark, sf):
    x = F.when(F.col("src_ord") % 31 != 0, (F.col("src_ord") % 1100) / 2.0)
    return tables.graded_rows(spark, sf).select("src_ord", airindex.aqi_category(x).alias("category"))


_ADVICE = "CASE category " + " ".join(f"WHEN '{n}' THEN '{t}'" for _, n, t in K.AQI_CATEGORIES) + " ELSE '' END"


@register("c20_advice", f"""
SELECT category, {_ADVICE} AS advice, count(*) AS n FROM (
  SELECT {sql_category('x')} AS category FROM (SELECT CASE WHEN src_ord % 31 <> 0 THEN (src_ord % 1100) / 2.0 END AS x FROM graded_rows)) GROUP BY 1, 2""")
def advice(spark, sf):
    rows = aqi_category(spark, sf).groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("advice", airindex.aqi_advice("category"))


def _sql_cpcb(p_col):
    """CPCB class with optional coliform, as SQL; `p_col` maps limit -> SQL or None."""
    arms = []
    for name, do_min, bod, col, lo, hi, missing in K.CPCB_CLASSES:
        p = [f"p_bod_{bod:g}"] if bod is not None else []
        if p_col and col is not None:
            p.append(p_col[col])
        p = " * ".join(p) or "1.0::DOUBLE"
        cond = f"ph BETWEEN {lo} AND {hi} AND ({p}) >= 0.5" + (f" AND oxygen >= {do_min}" if do_min else "")
        note = "" if (p_col and col is not None) else missing
        arms.append((cond, name, p, note))
    cls = "CASE WHEN oxygen IS NULL OR ph IS NULL THEN 'unknown' " + " ".join(f"WHEN {c} THEN '{n}'" for c, n, _, _ in arms) + " ELSE 'below E' END"
    conf = "CASE WHEN oxygen IS NULL OR ph IS NULL THEN NULL " + " ".join(f"WHEN {c} THEN {p}" for c, _, p, _ in arms) + " END"
    note = "CASE WHEN oxygen IS NULL OR ph IS NULL THEN '' " + " ".join(f"WHEN {c} THEN '{m}'" for c, _, _, m in arms) + " ELSE '' END"
    return f"{cls} AS cpcb_class, round({conf}, 9) AS cpcb_confidence, {note} AS cpcb_not_assessed"


P_BOD = {2.0: "p_bod_2", 3.0: "p_bod_3"}
P_COL = {50.0: "p_coliform_50", 500.0: "p_coliform_500", 5000.0: "p_coliform_5000"}


def _cpcb(df, p_coliform=None):
    out = df.withColumn("g", water.cpcb_class("oxygen", "ph", P_BOD, p_coliform))
    return out.select("src_ord", "g.cpcb_class", r9("g.cpcb_confidence").alias("cpcb_confidence"), "g.cpcb_not_assessed")


@register("c22_cpcb_class", f"SELECT src_ord, {_sql_cpcb(None)} FROM graded_rows")
def cpcb(spark, sf):
    return _cpcb(tables.graded_rows(spark, sf))


@register("c22_cpcb_with_coliform", f"SELECT src_ord, {_sql_cpcb(P_COL)} FROM graded_rows")
def cpcb_with_coliform(spark, sf):
    return _cpcb(tables.graded_rows(spark, sf), P_COL)


@register("c23_carlson_tsi", """
SELECT src_ord, round(9.81 * ln(chlorophyll) + 30.6, 9) AS tsi, round(exp((9.81 * ln(chlorophyll) + 30.6 - 30.6) / 9.81), 9) AS back FROM graded_rows""")
def carlson(spark, sf):
    df = tables.graded_rows(spark, sf).withColumn("t", water.carlson_tsi("chlorophyll"))
    return df.select("src_ord", r9("t").alias("tsi"), r9(water.chlorophyll_at("t")).alias("back"))


_TROPHIC = "CASE WHEN {x} < 40 THEN 'oligotrophic' WHEN {x} < 50 THEN 'mesotrophic' WHEN {x} < 70 THEN 'eutrophic' WHEN {x} IS NOT NULL THEN 'hypereutrophic' END"
_WHO = "CASE WHEN {b} >= 0.5 THEN 'Alert Level 1+ (check for scum)' WHEN {a} >= 0.5 THEN 'Alert Level 1' ELSE 'Vigilance' END"


@register("c24_trophic_class", f"""
SELECT src_ord, {_TROPHIC.replace('{x}', '(src_ord % 17) * 5')} AS on_edges, {_TROPHIC.replace('{x}', '(9.81 * ln(chlorophyll) + 30.6)')} AS trophic_class FROM graded_rows""")
def trophic_class(spark, sf):
    return tables.graded_rows(spark, sf).select(
        "src_ord",
        water.trophic_class((F.col("src_ord") % 17) * 5).alias("on_edges"),
        water.trophic_class(water.carlson_tsi("chlorophyll")).alias("trophic_class"),
    )


@register("c25_trophic_odds", """
SELECT src_ord, round(1 - a, 9) + 0.0 AS p_oligotrophic, round(a - b, 9) + 0.0 AS p_mesotrophic, round(b - c, 9) + 0.0 AS p_eutrophic, round(c, 9) + 0.0 AS p_hypereutrophic
FROM (SELECT src_ord, greatest(p_bod_2, p_bod_3, p_coliform_50) AS a, p_bod_2 + p_bod_3 + p_coliform_50 - greatest(p_bod_2, p_bod_3, p_coliform_50) - least(p_bod_2, p_bod_3, p_coliform_50) AS b,
  least(p_bod_2, p_bod_3, p_coliform_50) AS c FROM graded_rows)""")
def trophic_odds(spark, sf):
    df = tables.graded_rows(spark, sf).withColumn("p", odds.uncrossed("p_bod_2", "p_bod_3", "p_coliform_50"))
    chances = water.trophic_odds([F.col("p")[2], F.col("p")[1], F.col("p")[0]])
    return df.select("src_ord", *[r9(c).alias(n) for n, c in chances.items()])


@register("c26_who_level", f"""
SELECT src_ord, {_WHO.replace('{a}', 'p_bod_3').replace('{b}', 'p_bod_2')} AS who_level FROM graded_rows""")
def who_level(spark, sf):
    return tables.graded_rows(spark, sf).select("src_ord", water.who_level("p_bod_3", "p_bod_2").alias("who_level"))


@register("c27_coliform_band", """
SELECT src_ord, CASE WHEN c <= 50 THEN 'A (<=50)' WHEN c <= 500 THEN 'B (<=500)' WHEN c <= 5000 THEN 'C (<=5000)' ELSE 'above C' END AS band
FROM (SELECT src_ord, CASE WHEN src_ord % 3 = 0 THEN [50, 500, 5000][1 + src_ord % 2] ELSE coliform END AS c FROM graded_rows)""")
def coliform_band(spark, sf):
    edge = F.when(F.col("src_ord") % 2 == 0, 50.0).otherwise(500.0)
    count = F.when(F.col("src_ord") % 3 == 0, edge).otherwise(F.col("coliform"))
    return tables.graded_rows(spark, sf).select("src_ord", water.band_of_count(count).alias("band"))


@register("c28_coliform_band_odds", """
SELECT src_ord, CASE WHEN 1 - p_coliform_50 >= 0.5 THEN 'A (<=50)' WHEN 1 - p_coliform_500 >= 0.5 THEN 'B (<=500)'
  WHEN 1 - p_coliform_5000 >= 0.5 THEN 'C (<=5000)' ELSE 'above C' END AS band FROM graded_rows""")
def coliform_band_odds(spark, sf):
    return tables.graded_rows(spark, sf).select("src_ord", water.band_of_nowcast(P_COL).alias("band"))


@register("c29_cyclic_hour", """
SELECT src_ord, round(sin(2 * pi() * t / 24), 9) + 0.0 AS hour_sin, round(cos(2 * pi() * t / 24), 9) + 0.0 AS hour_cos
FROM (SELECT src_ord, hour("timestamp") + minute("timestamp") / 60.0::DOUBLE AS t FROM readings)""")
def cyclic_hour(spark, sf):
    s, c = timing.cyclic(F.hour("timestamp") + F.minute("timestamp") / 60.0)
    return tables.readings(spark, sf).select("src_ord", r9(s).alias("hour_sin"), r9(c).alias("hour_cos"))


@register("c30_weekend", """
SELECT src_ord, dayofweek("timestamp") IN (0, 6) AS weekend FROM readings""")
def weekend(spark, sf):
    return tables.readings(spark, sf).select("src_ord", timing.is_weekend("timestamp").alias("weekend"))


@register("c31_horizon_bucket", """
SELECT src_ord, CASE WHEN horizon BETWEEN 1 AND 3 THEN '1-3h' WHEN horizon BETWEEN 4 AND 6 THEN '4-6h' WHEN horizon BETWEEN 7 AND 12 THEN '7-12h'
  WHEN horizon BETWEEN 13 AND 24 THEN '13-24h' WHEN horizon BETWEEN 25 AND 36 THEN '25-36h' WHEN horizon BETWEEN 37 AND 48 THEN '37-48h' ELSE '' END AS lake,
  CASE WHEN horizon BETWEEN 1 AND 6 THEN '1-6h' WHEN horizon BETWEEN 7 AND 24 THEN '7-24h' WHEN horizon BETWEEN 25 AND 48 THEN '25-48h' ELSE '' END AS air
FROM graded_rows""")
def horizon_bucket(spark, sf):
    return tables.graded_rows(spark, sf).select(
        "src_ord",
        timing.horizon_bucket("horizon", K.LAKE_BUCKETS).alias("lake"),
        timing.horizon_bucket("horizon", K.AIR_BUCKETS).alias("air"),
    )


_SEEN = {"temperature": (18.0, 25.0), "ph": (6.5, 9.0), "turbidity": (1.0, 30.0), "dissolved_oxygen": (5.0, 12.0)}


def _sql_checks():
    err, warn = [], []
    for s, (lo, hi) in _SEEN.items():
        a, b = K.VALID_RANGES[s]
        err.append(f"CASE WHEN {s} IS NULL THEN '{s} must be a number' WHEN {s} NOT BETWEEN {a} AND {b} THEN '{s} is outside the physical range {a:g}-{b:g}' END")
        warn.append(f"CASE WHEN {s} BETWEEN {a} AND {b} AND {s} NOT BETWEEN {lo} AND {hi} THEN '{s} is outside the training range {lo:g}-{hi:g}; trust this prediction less' END")
    return f"concat_ws(' | ', {', '.join(err)}) AS errors, concat_ws(' | ', {', '.join(warn)}) AS warnings"


@register("c32_reading_checks", f"SELECT src_ord, {_sql_checks()} FROM dense")
def reading_checks(spark, sf):
    df = tables.dense(spark, sf)
    return df.select(
        "src_ord",
        F.array_join(checks.reading_errors(K.LAKE_SENSORS), " | ").alias("errors"),
        F.array_join(checks.reading_warnings(_SEEN), " | ").alias("warnings"),
    )


@register("c36_impossible_unit", """
SELECT station_id, round(median(dissolved_oxygen * 4), 9) AS median_oxygen, median(dissolved_oxygen * 4) > 25 AS impossible FROM readings GROUP BY 1""")
def impossible_unit(spark, sf):
    df = tables.readings(spark, sf).withColumn("mg_l", F.col("dissolved_oxygen") * 4)
    return median(df, ["station_id"], "mg_l").select(
        "station_id", r9("median").alias("median_oxygen"), (F.col("median") > K.DO_CEILING).alias("impossible")
    )
