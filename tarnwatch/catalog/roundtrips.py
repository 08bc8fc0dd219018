"""Queries that go through files and streams.

Each writes tables of this data as files, runs an operator on them and reads back what it left; the SQL states what that must
be. Streams run to the end of their input (`availableNow`) with a checkpoint, in as many batches as there are drops of files;
some rows of the second drop come too late for the watermark.
"""

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_hour
from tarnwatch.functions.working import r9
from tarnwatch.operators import alerts, grid, incidents, report, scoring
from tarnwatch.operators.lineage import materialise, shared_folder
from tarnwatch.sources import readers, sinks, tables
from tarnwatch.streaming import intake, smoothing, windows

from .detection import W48, judged, smooth_inputs
from .evaluation import _J1, forecasts
from .intake import rounded
from .oracle import cte
from .registry import register

S = K.LAKE_SENSORS


def folder(spark, name: str) -> str:
    """A new folder under the shared one."""
    return f"{shared_folder(spark)}/tarnwatch/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def dropped(df: DataFrame, path: str, order: str, files: int, fmt: str = "csv") -> None:
    """Adds files to a folder whose names and rows are in the given order."""
    rows = df.repartitionByRange(files, order).sortWithinPartitions(order)
    rows.write.mode("append").option("header", True).format(fmt).save(path)


# ---------------------------------------------------------------------------- scans (A1, A2)

STAMP = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def export(spark, sf) -> DataFrame:
    """Readings as a logger's text: every 41st temperature and every 97th time cannot be read."""
    r, n = tables.readings(spark, sf), F.col("src_ord")
    stamp = F.when(n % 97 == 0, "soon").otherwise(F.date_format("timestamp", STAMP))
    junk = F.when(n % 41 == 0, "err").otherwise(F.col("temperature").cast("string"))
    return r.select(n.cast("string").alias("n"), "station_id", stamp.alias("timestamp"), junk.alias("temperature"), *[F.col(s).cast("string").alias(s) for s in S[1:]])


cte("exported", f"""
SELECT src_ord, station_id, CASE WHEN src_ord % 97 <> 0 THEN "timestamp" END AS "timestamp", CASE WHEN src_ord % 41 <> 0 THEN temperature END AS temperature, {', '.join(S[1:])} FROM readings""")


@register("a1_csv_scan", f"SELECT src_ord, station_id, \"timestamp\", {', '.join(S)} FROM exported")
def csv_scan(spark, sf):
    rows = export(spark, sf)
    path = folder(spark, "csv")
    rows.write.option("header", True).csv(path)
    back = readers.read_readings(readers.read_csv(spark, path, rows.columns), order=F.col("n").cast("bigint"))
    return back.select("src_ord", "station_id", "timestamp", *S)


@register("a2_inbox_first_wins", f"""
SELECT station_id, make_timestamp(slot * 600000000) AS "timestamp", {', '.join(S)} FROM (
  SELECT *, CAST(round_even(epoch_us("timestamp") / 600000000.0, 0) AS BIGINT) AS slot FROM exported WHERE "timestamp" IS NOT NULL)
QUALIFY row_number() OVER (PARTITION BY station_id, slot ORDER BY src_ord) = 1""")
def inbox_first_wins(spark, sf):
    rows = export(spark, sf).withColumn("_n", F.col("n").cast("bigint"))
    path = folder(spark, "inbox")
    rows.repartitionByRange(6, "_n").sortWithinPartitions("_n").drop("_n").write.option("header", True).csv(path)
    columns = [c for c in rows.columns if c != "_n"]
    return grid.with_timestamp(grid.first_per_slot(readers.read_readings(readers.read_inbox(spark, path, columns))))


# ---------------------------------------------------------------------------- sinks


@register("b1_run_tables", " UNION ALL ".join(
    f"SELECT '{fmt}' AS format, 'readings,weather' AS written, station_id, \"timestamp\", ph, rain_mm FROM readings LEFT JOIN weather USING (\"timestamp\")" for fmt in ("parquet", "csv"))
    + " UNION ALL " + " UNION ALL ".join(f"SELECT '{fmt}', 'readings,weather', NULL, \"timestamp\", NULL, rain_mm FROM weather" for fmt in ("parquet", "csv")))
def run_tables(spark, sf):
    run = {"readings": tables.readings(spark, sf).select("station_id", "timestamp", "ph"), "nothing": tables.readings(spark, sf).limit(0),
           "absent": None, "weather": tables.weather(spark, sf).select("timestamp", "rain_mm")}
    out = []
    for fmt in ("parquet", "csv"):
        path = folder(spark, "run")
        names = sinks.write_tables(run, path, fmt)
        back = {}
        for name in names:
            reader = spark.read.schema(run[name].schema)
            back[name] = reader.option("header", True).csv(f"{path}/{name}") if fmt == "csv" else reader.parquet(f"{path}/{name}")
        both = [back["readings"].join(back["weather"], "timestamp", "left"), back["weather"].withColumns({"station_id": F.lit(None).cast("string"), "ph": F.lit(None).cast("double")})]
        written = F.lit(",".join(names))
        out += [b.select(F.lit(fmt).alias("format"), written.alias("written"), "station_id", "timestamp", "ph", "rain_mm") for b in both]
    return reduce(DataFrame.unionByName, out)


def sections(spark, sf) -> DataFrame:
    flagged = materialise(judged(spark, sf).select("station_id", "slot", "verdict", *S, *[f"{s}_fault" for s in S]), "flagged")
    found = materialise(incidents.alarm_incidents(flagged), "incidents")
    return materialise(report.station_sections(flagged, found, alerts.incident_alerts(found)), "sections")


cte("last_seen", "SELECT station_id, make_timestamp(slot * 600000000) AS seen_at, " + ", ".join(f"round({s}, 3) AS {s}" for s in S) + """ FROM d_slot_grid
WHERE temperature IS NOT NULL OR ph IS NOT NULL OR turbidity IS NOT NULL OR dissolved_oxygen IS NOT NULL QUALIFY row_number() OVER (PARTITION BY station_id ORDER BY slot DESC) = 1""")
cte("faults_seen", " UNION ALL ".join(
    f"SELECT station_id, '{s}' AS sensor, count(*) FILTER ({s}_fault <> '') AS faulty, coalesce(list_sort(list(DISTINCT {s}_fault) FILTER ({s}_fault <> '')), []) AS kinds FROM judged GROUP BY 1" for s in S))
_ISO = "'%Y-%m-%dT%H:%M'"


@register("b2_station_documents", f"""
SELECT l.station_id, strftime(l.seen_at, {_ISO}) AS latest_time, l.ph AS latest_ph, f.faulty AS turbidity_faults, array_to_string(f.kinds, ',') AS turbidity_kinds,
  (SELECT count(*) FROM incident_rows i WHERE i.station_id = l.station_id)::INTEGER AS incidents, (SELECT strftime(min(i."start"), {_ISO}) FROM incident_rows i WHERE i.station_id = l.station_id) AS first_incident
FROM last_seen l JOIN faults_seen f ON f.station_id = l.station_id AND f.sensor = 'turbidity'""")
def station_documents(spark, sf):
    docs = sections(spark, sf)
    path = folder(spark, "documents")
    sinks.write_json(docs, path)
    back = spark.read.schema(docs.schema).json(path)
    health = F.element_at("sensor_health", "turbidity")
    return back.select(
        "station_id", F.col("latest.time").alias("latest_time"), F.col("latest.ph").alias("latest_ph"), health["faulty_readings"].alias("turbidity_faults"),
        F.array_join(health["fault_types"], ",").alias("turbidity_kinds"), F.size("incidents").alias("incidents"), F.col("incidents")[0]["start"].alias("first_incident"))


@register("b3_report_text", f"""
SELECT '=== ' || station_id || ' ===' AS line FROM last_seen
UNION ALL SELECT 'Latest (' || strftime(seen_at, {_ISO}) || '): ' || concat_ws(', ', {', '.join(f"'{s} ' || {s}" for s in S)}) FROM last_seen
UNION ALL SELECT 'Sensor health: ' || coalesce('faulty readings ' || string_agg(sensor || ' ' || faulty, ', ' ORDER BY sensor) FILTER (faulty > 0), 'all good') FROM faults_seen GROUP BY station_id
UNION ALL SELECT '  [' || rpad(upper(severity), 6, ' ') || '] ' || message FROM incident_messages""")
def report_text(spark, sf):
    lines = report.report_lines(sections(spark, sf))
    path = folder(spark, "text")
    sinks.write_lines(lines, path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@register("b5_score_history", f"""
SELECT run, sensor, bucket, round(m, 4) AS mae, round(1 - m / least(p, s), 3) AS skill FROM (SELECT 'even' AS run, * FROM ({_J1.replace('{extra}', '').replace('WHERE', 'WHERE hour % 2 = 0 AND')})
  UNION ALL SELECT 'odd', * FROM ({_J1.replace('{extra}', '').replace('WHERE', 'WHERE hour % 2 = 1 AND')}))""")
def score_history(spark, sf):
    fc, path = materialise(forecasts(spark, sf), "forecasts"), folder(spark, "scores")
    for run, rest in (("even", 0), ("odd", 1)):
        sinks.append_scores(scoring.hourly_report(fc.filter(F.col("hour") % 2 == rest)), path, run)
    return spark.read.parquet(path).select("run", "sensor", "bucket", "mae", "skill")


# ---------------------------------------------------------------------------- streams


@register("g4_intake_history", f"""
SELECT station_id, stamp, max_by(temperature, src_ord) AS temperature, count(DISTINCT "drop") AS drops FROM (
  SELECT station_id, strftime("timestamp", '%Y-%m-%d %H:00') AS stamp, temperature, src_ord, src_ord % 5 < 2 AS "drop" FROM readings WHERE src_ord % 5 < 2 OR src_ord % 3 = 0)
GROUP BY 1, 2""".replace("max_by(temperature, src_ord)", 'max_by(temperature, ("drop", src_ord))'))
def intake_history(spark, sf):
    r, n = tables.readings(spark, sf), F.col("src_ord")
    rows = r.select("src_ord", "station_id", F.date_format("timestamp", "yyyy-MM-dd HH:00").alias("stamp"), F.col("temperature").cast("string").alias("temperature"))
    inbox, log, checkpoint = (folder(spark, x) for x in ("inbox", "log", "checkpoint"))
    columns = ["src_ord", "station_id", "stamp", "temperature"]
    # Two drops, each taken in once; the second holds newer copies of the first one's hours.
    for some in ((n % 5 >= 2) & (n % 3 == 0), n % 5 < 2):
        dropped(rows.filter(some), inbox, "src_ord", 3)
        intake.take_in(intake.inbox_stream(spark, inbox, columns), "stamp", log, checkpoint).awaitTermination()
    drops = spark.read.parquet(log).groupBy("station_id", "stamp").agg(F.count_distinct("_batch").alias("drops"))
    newest = intake.history(spark, log, "station_id", "stamp").select("station_id", "stamp", F.col("temperature").cast("double").alias("temperature"))
    return newest.join(drops, ["station_id", "stamp"])


# The month's two halves, then every 50th row: rows of the first half are too late by then, as a batch leaves out what lay
# behind the watermark of the batch before it.
cte("streamed", """
SELECT r.*, CASE WHEN src_ord % 50 = 0 THEN 3 WHEN d <= 19738 THEN 1 ELSE 2 END AS batch FROM readings r JOIN (SELECT event_id, d FROM ev) e ON e.event_id = r.src_ord""")
cte("watermarks", """
SELECT epoch_us(max("timestamp") FILTER (batch = 1)) // 1000 * 1000 - 7200000000 AS late, epoch_us(max("timestamp")) // 1000 * 1000 - 7200000000 AS closed FROM streamed""")


def stream(spark, df: DataFrame, *drops) -> DataFrame:
    """The table as drops of one file each, read one after the other."""
    path = folder(spark, "stream")
    for some in drops:
        df.filter(some).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def readings_stream(spark, sf) -> DataFrame:
    early, last = F.unix_date(F.to_date("timestamp")) <= 19738, F.col("src_ord") % 50 == 0
    return windows.event_time(stream(spark, tables.readings(spark, sf), early & ~last, ~early & ~last, last))


def ended(df: DataFrame, spark) -> DataFrame:
    """Runs a stream to the end of its input and reads what it wrote."""
    path = folder(spark, "streamed")
    running = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", folder(spark, "checkpoint"))
    running.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(df.schema).parquet(path)


def _hour(ts):
    return F.floor(F.unix_micros(ts) / 3_600_000_000)


cte("closed_hours", f"""
SELECT station_id, hour, {', '.join(f"CASE WHEN count({s}) >= 3 THEN avg({s}) END AS {s}" for s in S)}
FROM (SELECT *, epoch_us("timestamp") // 3600000000 AS hour FROM streamed), watermarks
WHERE (batch < 3 OR (hour + 1) * 3600000000 > late) AND (hour + 1) * 3600000000 <= closed GROUP BY 1, 2""")


@register("g6_hourly_stream", f"SELECT station_id, make_timestamp(hour * 3600000000) AS \"timestamp\", {rounded(S)} FROM closed_hours")
def hourly_stream(spark, sf):
    means = windows.hourly_means(readings_stream(spark, sf))
    out = ended(means.select("station_id", F.col("window.start").alias("start"), *S), spark)
    return out.select("station_id", from_hour(_hour("start")).alias("timestamp"), *[r9(s).alias(s) for s in S])


@register("g7_sliding_stream", """
SELECT station_id, make_timestamp((s + 8) * 3600000000) AS until, round(CASE WHEN count(ph) >= 6 THEN avg(ph) END, 9) + 0.0 AS ph
FROM (SELECT station_id, ph, unnest(generate_series(hour - 7, hour)) AS s FROM closed_hours), watermarks WHERE (s + 8) * 3600000000 <= closed GROUP BY 1, 2""")
def sliding_stream(spark, sf):
    sliding = windows.sliding_means(windows.hourly_means(readings_stream(spark, sf), ["ph"]), ["ph"], 8, 6)
    out = ended(sliding.select("station_id", F.col("span.end").alias("end"), "ph"), spark)
    return out.select("station_id", from_hour(_hour("end")).alias("until"), r9("ph").alias("ph"))


@register("g9_late_rows", """
SELECT station_id, count(*) AS kept_in_batch, count(*) FILTER (batch < 3 OR epoch_us("timestamp") > late) AS kept_in_stream FROM streamed, watermarks GROUP BY 1""")
def late_rows(spark, sf):
    twice = readings_stream(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    once = windows.deduplicated(twice, ["src_ord"])
    seen = ended(once.select("station_id", "src_ord"), spark).groupBy("station_id").agg(F.count(F.lit(1)).alias("kept_in_stream"))
    every = tables.readings(spark, sf).groupBy("station_id").agg(F.count(F.lit(1)).alias("kept_in_batch"))
    return every.join(seen, "station_id")


@register("g5_smoothed_stream", 'SELECT station_id, make_timestamp(hour * 3600000000) AS "timestamp", round(recursive_step, 9) + 0.0 AS level FROM smooth_levels')
def smoothed_stream(spark, sf):
    rows = materialise(smooth_inputs(spark, sf).select("station_id", F.col("hour").alias("slot"), "x", "reset"), "inputs")
    middle = rows.agg(F.avg("slot").cast("bigint")).first()[0]
    out = ended(smoothing.smoothed(stream(spark, rows, F.col("slot") <= middle, F.col("slot") > middle), W48, 1.2), spark)
    return out.select("station_id", from_hour(F.col("slot")).alias("timestamp"), r9("level").alias("level"))
