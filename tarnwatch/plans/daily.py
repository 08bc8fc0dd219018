"""The daily run: readings in, flags, forecasts, estimates, alerts and a report out."""

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions import water
from tarnwatch.models.classifier import WqiClassifier
from tarnwatch.operators import alerts, grading, incidents, readiness, report, soft_features
from tarnwatch.operators import forecast_features as ff
from tarnwatch.operators import grid as grids
from tarnwatch.operators.lineage import materialise
from tarnwatch.operators.recent import recent
from tarnwatch.sources import readers, sinks, vendor
from tarnwatch.streaming import intake

from .training import Models, complete_hours, soft_rows

__all__ = ["daily_run", "inbox_run", "write_run"]


def _estimates(models: Models, target: str, hourly: DataFrame, weather: DataFrame | None) -> DataFrame | None:
    """Daily estimates of one lab value with its range and odds, or None without a model."""
    sensor = models.soft.get(target)
    if sensor is None:
        return None
    rows = soft_rows(soft_features.estimate_times(hourly), hourly, weather, target)
    out = sensor.estimate(rows)
    odds = [f"p_above_{lv:g}" for lv in K.EXCEEDANCE_LEVELS[target]]
    keep = [
        "station_id", "timestamp", F.col(f"{target}_est").alias(target), f"{target}_lo", f"{target}_hi", *odds,
        F.col("now_dissolved_oxygen").alias("dissolved_oxygen"), F.col("now_ph").alias("ph"),
    ]
    return out.select(*keep)


def daily_run(export: DataFrame, mapping: vendor.VendorMapping, models: Models, weather_raw: DataFrame | None = None,
              window_hours: int = 24, trained_at: str = "", order: str = "src_ord") -> dict[str, DataFrame]:
    """Every result table of a run by name: flags, incidents, hourly, nightly, bod, algae, coliform, alerts, sections, lines, header."""
    export = recent(vendor.normalise(export, mapping), "timestamp", days=K.RECENT_DAYS)
    export = materialise(export, "export")
    grid = grids.slot_grid(export, order)
    flagged = materialise(models.detector.detect(grid, weather_raw), "flagged")
    window = materialise(recent(flagged, "timestamp", hours=window_hours), "window")
    found = materialise(incidents.alarm_incidents(window), "incidents")

    hourly = materialise(grids.on_calendar(grids.hourly_values(grids.mask_faulty(flagged)), "hour"), "hourly")
    weather = materialise(grids.weather_grid(weather_raw, K.WEATHER_LAKE), "weather") if weather_raw is not None else None
    hours = materialise(ff.working_hours(hourly), "hours")
    end = hours.agg((F.max("hour") + 1).alias("e")).first()["e"]
    refresh = end - K.RECALIBRATE_DAYS * 24 > models.trained_until

    latest = materialise(ff.latest_complete_hour(hours), "latest")
    out: dict[str, DataFrame] = {"flags": window, "incidents": found}
    raised = [alerts.stale_alerts(window), alerts.incident_alerts(found)]
    short = None
    if models.hourly is not None:
        if refresh:
            origins = ff.origin_hours(hours, 3, since=end - K.RECALIBRATE_DAYS * 24)
            models.hourly.calibrate(materialise(models.hourly.working_forecast(hours, origins, weather, noisy=True), "recalibration"))
        path = materialise(models.hourly.working_forecast(hours, latest, weather), "path")
        out["hourly"] = materialise(models.hourly.finished(path).drop("actual"), "hourly_forecast")
        raised.append(alerts.no_forecast_notes(hours, latest))
        if weather is not None:
            first = latest.agg(F.min("hour")).first()[0]
            if first is not None:
                short = readiness.weather_short(weather, first, first + K.MAX_HORIZON, K.WEATHER_LAKE)
    if models.nightly is not None:
        nights = ff.nightly_rows(hours, weather).join(
            ff.coming_nights(latest).select("station_id", "issue_day", "days_ahead"), ["station_id", "issue_day", "days_ahead"]
        )
        oxygen = path.filter(F.col("sensor") == "dissolved_oxygen") if models.hourly is not None else None
        out["nightly"] = materialise(models.nightly.finished(models.nightly.working_forecast(hours, weather, oxygen, nights)), "nightly_forecast")
        raised.append(alerts.oxygen_alerts(out["nightly"]))

    bod, algae, coliform = (_estimates(models, t, hourly, weather) for t in ("bod", "chlorophyll_a", "total_coliform"))
    if coliform is not None:
        limits = {lv: f"p_above_{lv:g}" for lv, _ in K.COLIFORM_BANDS}
        coliform = materialise(coliform.withColumn("cpcb_band", water.band_of_nowcast(limits)), "coliform")
    if bod is not None:
        bod = materialise(grading.graded(bod) if coliform is None else grading.graded_with_coliform(bod, coliform), "bod")
    if algae is not None:
        tsi = water.carlson_tsi("chlorophyll_a")
        algae = materialise(
            algae.withColumns({"tsi": F.round(tsi, 1), "trophic_class": water.trophic_class(tsi), "who_level": water.who_level("p_above_12", "p_above_24")}),
            "algae",
        )
    now = {}
    for name, table, rule in (("bod", bod, alerts.bod_alerts), ("algae", algae, alerts.algae_alerts), ("coliform", coliform, alerts.coliform_alerts)):
        if table is not None:
            out[name] = table
            now[name] = alerts.latest_per_station(table, "timestamp")
            raised.append(rule(now[name]))
    if isinstance(models.wqi, WqiClassifier):
        now["wqi"] = materialise(models.wqi.classify(alerts.latest_per_station(complete_hours(hourly), "hour")), "wqi_now")
        raised.append(alerts.wqi_alerts(now["wqi"]))
    if mapping.limits:
        counts = vendor.censor_counts(export)
        raised.append(alerts.sensor_limit_notes(counts, mapping.limits))
    out["alerts"] = materialise(alerts.union(raised), "alerts")
    out["sections"] = materialise(
        report.station_sections(window, found, out["alerts"], forecast=out.get("hourly"), nights=out.get("nightly"), **now), "sections"
    )
    out["lines"] = report.report_lines(out["sections"])
    out["header"] = report.report_header(window, window_hours, trained_at, bool(refresh), short)
    return out


def inbox_run(spark: SparkSession, inbox: str, log: str, checkpoint: str, mapping: vendor.VendorMapping, models: Models,
              weather_raw: DataFrame | None = None, **options) -> dict[str, DataFrame]:
    """Take the waiting exports of a folder into the history log, then run on the log's last days.

    Only folders of days that the run can need are read: the newest day less `RECENT_DAYS`, and two days more, as a
    vendor's local day may lie beside ours. Days that several drops wrote to are compacted afterwards by `compact_days`.
    """
    station, stamp = mapping.columns["station_id"], mapping.columns["timestamp"]
    waiting = intake.inbox_stream(spark, inbox, list(mapping.columns.values()))
    intake.take_in(waiting, stamp, log, checkpoint).awaitTermination()
    newest = intake.last_day(spark, log)
    since = str(newest - datetime.timedelta(days=K.RECENT_DAYS + 2)) if newest else None
    export = intake.history(spark, log, station, stamp, since).withColumn("src_ord", F.struct("_batch", *readers.ARRIVAL))
    return daily_run(export, mapping, models, weather_raw, **options)


def write_run(result: dict[str, DataFrame], folder: str) -> list[str]:
    """The run's folder: result tables, one JSON section per station, ordered alerts, and the text report."""
    tables = {k: v for k, v in result.items() if k in ("flags", "incidents", "hourly", "nightly", "bod", "algae", "coliform")}
    written = sinks.write_tables(tables, folder)
    sinks.write_json(result["header"], f"{folder}/report_header")
    sinks.write_json(result["sections"], f"{folder}/report_stations")
    sinks.write_json(alerts.most_severe_first(result["alerts"]), f"{folder}/report_alerts")
    sinks.write_lines(result["lines"], f"{folder}/report_text")
    return written

