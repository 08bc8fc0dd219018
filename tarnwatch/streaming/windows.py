"""Windowed streams: hourly means, sliding regulatory averages, alarm sessions. Event time is `ts`, a TIMESTAMP.

Rows later than the watermark are left out here and kept by the batch operators, which the nightly run repeats.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import micros


def event_time(df: DataFrame, column: str = "timestamp") -> DataFrame:
    """Zone-free times as an event-time column, read as UTC whatever the session's zone."""
    return df.withColumn("ts", F.timestamp_micros(micros(F.col(column))))


def deduplicated(stream: DataFrame, keys, delay: str = "2 hours") -> DataFrame:
    """Repeated readings dropped while their first copy is within the watermark."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def hourly_means(stream: DataFrame, sensors=K.LAKE_SENSORS, min_valid: int = K.MIN_PER_HOUR, delay: str = "2 hours") -> DataFrame:
    """Tumbling hourly means; a sensor with too few readings stays NULL."""
    hours = stream.withWatermark("ts", delay).groupBy(F.window("ts", "1 hour"), "station_id")
    return hours.agg(*[F.when(F.count(s) >= min_valid, F.avg(s)).alias(s) for s in sensors])


def sliding_means(hourly: DataFrame, columns, hours: int, least: int) -> DataFrame:
    """Means over the last `hours` hourly values, one row per hour the window ends at."""
    sliding = hourly.groupBy(F.window(F.window_time("window"), f"{hours} hours", "1 hour").alias("span"), "station_id")
    return sliding.agg(*[F.when(F.count(c) >= least, F.avg(c)).alias(c) for c in columns])


def alarm_sessions(flagged: DataFrame, sensors=K.LAKE_SENSORS, delay: str = "2 hours") -> DataFrame:
    """Alarms at most 70 minutes apart as one incident; `end` is the last alarm, not the end of the wait."""
    alarms = flagged.filter(F.col("verdict").isin(K.ALARM_VERDICTS)).withWatermark("ts", delay)
    sessions = alarms.groupBy(F.session_window("ts", f"{K.INCIDENT_GAP_MINUTES} minutes"), "station_id")
    found = sessions.agg(
        F.min("ts").alias("start"),
        F.max("ts").alias("end"),
        F.array_join(F.array_sort(F.collect_set("verdict")), ",").alias("verdicts"),
        *[F.max(F.when(F.col(f"{s}_fault") != "", 1).otherwise(0)).alias(f"_{s}") for s in sensors],
    )
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{s}") == 1, s) for s in sensors])), ",")
    return found.select("station_id", "start", "end", "verdicts", named.alias("sensors"))
