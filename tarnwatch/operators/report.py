"""The daily report: one nested section per station, and its text rendering as ordered lines.

Arrays inside a section hold a day's incidents, a week's nights or a handful of alerts; their size follows from the
report window, not from the volume of readings.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_day, from_hour

from .alerts import latest_readings, minute, sensor_health, severity_rank


def _r(x, digits: int = 2) -> Column:
    return F.round(F.col(x) if isinstance(x, str) else x, digits)


def _listed(df: DataFrame, name: str, order, fields: dict) -> DataFrame:
    item = F.struct(*[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)], *[c.alias(n) for n, c in fields.items()])
    rows = df.groupBy("station_id").agg(F.array_sort(F.collect_list(item)).alias(name))
    return rows.withColumn(name, F.transform(name, lambda s: F.struct(*[s[n].alias(n) for n in fields])))


def station_sections(
    flagged: DataFrame,
    incidents: DataFrame,
    alerts: DataFrame,
    wqi: DataFrame | None = None,
    bod: DataFrame | None = None,
    algae: DataFrame | None = None,
    coliform: DataFrame | None = None,
    forecast: DataFrame | None = None,
    nights: DataFrame | None = None,
) -> DataFrame:
    """One row per station: latest, sensor_health, incidents, now, algae, coliform, outlook_48h, nights, alerts.

    `flagged` and `incidents` cover the report window; estimates hold one (the latest) row per station.
    """
    stations = flagged.select("station_id").distinct()
    latest = latest_readings(flagged)
    latest = latest.select("station_id", F.struct(minute("time").alias("time"), *[_r(s, 3).alias(s) for s in K.LAKE_SENSORS]).alias("latest"))
    kinds = F.split("fault_types", ",")
    health = sensor_health(flagged).groupBy("station_id").agg(
        F.map_from_entries(F.collect_list(F.struct(
            "sensor", F.struct("faulty_readings", F.filter(kinds, lambda k: k != "").alias("fault_types")).alias("v")
        ))).alias("sensor_health")
    )
    parts = [latest, health]
    parts.append(_listed(incidents, "incidents", ["start"], {
        "start": minute("start"), "end": minute("end"), "kinds": F.col("verdicts"), "sensors": F.col("sensors"),
    }))
    if wqi is not None:
        chances = F.create_map(*[x for c in K.WQI_CLASSES for x in (F.lit(c), F.col(f"p_{c}"))])
        parts.append(wqi.select("station_id", F.struct(
            F.col("predicted_class").alias("wqi_class"), _r(F.element_at(chances, F.col("predicted_class"))).alias("wqi_probability"),
        ).alias("wqi")))
    if bod is not None:
        parts.append(bod.select("station_id", F.struct(
            minute("timestamp").alias("date"), _r("bod").alias("bod_mg_l"), F.array(_r("bod_lo"), _r("bod_hi")).alias("bod_range_mg_l"),
            _r("p_above_3").alias("p_bod_above_3"), "cpcb_class", "cpcb_not_assessed",
        ).alias("bod")))
    if algae is not None:
        parts.append(algae.select("station_id", F.struct(
            minute("timestamp").alias("date"), _r("chlorophyll_a", 1).alias("chlorophyll_a_ug_l"),
            F.array(_r("chlorophyll_a_lo", 1), _r("chlorophyll_a_hi", 1)).alias("range_ug_l"), _r("tsi", 1).alias("trophic_state_index"),
            "trophic_class", _r("p_above_12").alias("p_above_12"), _r("p_above_24").alias("p_above_24"), "who_level",
        ).alias("algae")))
    if coliform is not None:
        parts.append(coliform.select("station_id", F.struct(
            minute("timestamp").alias("date"), _r("total_coliform", 0).alias("total_coliform_mpn_100ml"),
            F.array(_r("total_coliform_lo", 0), _r("total_coliform_hi", 0)).alias("range_mpn_100ml"),
            _r("p_above_500").alias("p_above_500"), _r("p_above_5000").alias("p_above_5000"), "cpcb_band",
        ).alias("coliform")))
    if forecast is not None:
        parts.append(outlook(forecast))
    if nights is not None:
        parts.append(_listed(nights, "nights", ["night_of"], {
            "date": F.date_format(from_day(F.col("night_of")), "yyyy-MM-dd"), "oxygen_min_mg_l": _r("mid"),
            "range": F.array(_r("lo"), _r("hi")), "p_below_alert": _r("p_below_alert"),
            "alert": F.col("p_below_alert") >= K.ALERT_PROBABILITY,
        }))
    raised = alerts.withColumnRenamed("station", "station_id").withColumn("_rank", severity_rank())
    parts.append(_listed(raised, "alerts", ["_rank", "message"], {"severity": F.col("severity"), "message": F.col("message")}))
    return reduce(lambda a, b: a.join(b, "station_id", "left"), parts, stations)


def outlook(forecast: DataFrame, turbidity_unit: str = "NTU") -> DataFrame:
    """Per station the hour of least oxygen and of most turbidity in the coming hours; the first hour wins a tie."""
    oxygen, murky = F.col("sensor") == "dissolved_oxygen", F.col("sensor") == "turbidity"
    row = F.struct("target_hour", "lo", "mid", "hi")
    out = forecast.groupBy("station_id").agg(
        F.min("hour").alias("_issued"),
        F.min_by(row, F.when(oxygen & F.col("mid").isNotNull(), F.struct(F.col("mid"), F.col("target_hour")))).alias("_low"),
        F.min_by(row, F.when(murky & F.col("mid").isNotNull(), F.struct(-F.col("mid"), F.col("target_hour")))).alias("_high"),
    )
    return out.select("station_id", F.struct(
        minute(from_hour(F.col("_issued"))).alias("issued_at"),
        F.struct(
            _r(F.col("_low.mid")).alias("mg_l"), minute(from_hour(F.col("_low.target_hour"))).alias("time"),
            F.array(_r(F.col("_low.lo")), _r(F.col("_low.hi"))).alias("range"),
        ).alias("lowest_oxygen"),
        F.struct(
            _r(F.col("_high.mid"), 1).alias("value"), F.lit(turbidity_unit).alias("unit"),
            minute(from_hour(F.col("_high.target_hour"))).alias("time"),
        ).alias("highest_turbidity"),
    ).alias("outlook_48h"))


def report_lines(sections: DataFrame) -> DataFrame:
    """The report as text: (station_id, line_no, line), each station's lines in reading order."""
    have = set(sections.columns)
    text = [F.concat(F.lit("=== "), F.col("station_id"), F.lit(" ==="))]
    reading = F.concat_ws(", ", *[F.concat(F.lit(f"{s} "), F.col(f"latest.{s}").cast("string")) for s in K.LAKE_SENSORS])
    text.append(F.concat(F.lit("Latest ("), F.col("latest.time"), F.lit("): "), reading))
    faulty = F.filter(F.map_entries("sensor_health"), lambda e: e["value"]["faulty_readings"] > 0)
    named = F.array_join(F.array_sort(F.transform(faulty, lambda e: F.concat(e["key"], F.lit(" "), e["value"]["faulty_readings"].cast("string")))), ", ")
    text.append(F.concat(F.lit("Sensor health: "), F.when(F.size(faulty) == 0, "all good").otherwise(F.concat(F.lit("faulty readings "), named))))

    def spread(column):
        return F.concat(F.lit("["), F.array_join(F.transform(column, lambda x: x.cast("string")), ", "), F.lit("]"))

    if "bod" in have:
        text.append(F.concat(
            F.lit("Now: BOD "), F.col("bod.bod_mg_l").cast("string"), F.lit(" mg/L "), spread(F.col("bod.bod_range_mg_l")), F.lit("; CPCB class "),
            F.col("bod.cpcb_class"), F.lit(" (not assessed: "), F.when(F.col("bod.cpcb_not_assessed") == "", "-").otherwise(F.col("bod.cpcb_not_assessed")), F.lit(")"),
        ))
    if "wqi" in have:
        text.append(F.concat(F.lit("WQI now: "), F.col("wqi.wqi_class")))
    if "algae" in have:
        text.append(F.concat(
            F.lit("Algae: chlorophyll-a "), F.col("algae.chlorophyll_a_ug_l").cast("string"), F.lit(" ug/L "), spread(F.col("algae.range_ug_l")),
            F.lit(", TSI "), F.col("algae.trophic_state_index").cast("string"), F.lit(" ("), F.col("algae.trophic_class"), F.lit("), WHO: "), F.col("algae.who_level"),
        ))
    if "coliform" in have:
        text.append(F.concat(
            F.lit("Total coliform: "), F.format_string("%.0f", F.col("coliform.total_coliform_mpn_100ml")), F.lit(" MPN/100 mL "),
            spread(F.col("coliform.range_mpn_100ml")), F.lit(", CPCB band "), F.col("coliform.cpcb_band"),
        ))
    if "outlook_48h" in have:
        text.append(F.concat(
            F.lit("Next 48 h: lowest oxygen "), F.col("outlook_48h.lowest_oxygen.mg_l").cast("string"), F.lit(" mg/L at "),
            F.col("outlook_48h.lowest_oxygen.time"), F.lit(", turbidity peak "), F.col("outlook_48h.highest_turbidity.value").cast("string"),
            F.lit(" "), F.col("outlook_48h.highest_turbidity.unit"),
        ))
    if "nights" in have:
        nights = F.transform("nights", lambda n: F.concat(
            n["date"], F.lit(" "), n["oxygen_min_mg_l"].cast("string"), F.lit(" ("), F.format_string("%.0f%%", n["p_below_alert"] * 100), F.lit(")"),
            F.when(n["alert"], " !").otherwise(""),
        ))
        text.append(F.concat(F.lit("Pre-dawn oxygen minimum: "), F.array_join(nights, "; ")))
    raised = F.transform(
        F.coalesce("alerts", F.array()), lambda a: F.concat(F.lit("  ["), F.rpad(F.upper(a["severity"]), 6, " "), F.lit("] "), a["message"])
    )
    lines = F.array_compact(F.concat(F.array(*text), raised))
    return sections.select("station_id", F.posexplode(lines).alias("line_no", "line"))


def report_header(flagged: DataFrame, window_hours: int, trained_at: str, recalibrated: bool, weather_short: DataFrame | None = None) -> DataFrame:
    """One row of report-wide facts."""
    short = weather_short.scalar() if weather_short is not None else F.lit(False)
    return flagged.agg(minute(F.max("timestamp")).alias("generated_at")).withColumns(
        {
            "window_hours": F.lit(window_hours), "models_trained_at": F.lit(trained_at),
            "forecast_ranges_recalibrated": F.lit(recalibrated), "weather_forecast_short": short,
        }
    )
