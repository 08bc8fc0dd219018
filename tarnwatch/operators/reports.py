"""One-row data reports: what cleaning dropped, added and masked."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.clock import from_slot, nearest_slot




def prepare_report(readings: DataFrame, order: str = "src_ord") -> DataFrame:
    """Rows in, bad times, duplicates, gap rows added, stations and the time span of the gridded readings.

    The grid itself is not built: its size follows from each station's first and last slot.
    """
    raw = readings.withColumn("slot", nearest_slot(F.col("timestamp")))
    raw = raw.groupBy("station_id", "slot").agg(F.count(F.lit(1)).alias("rows"))
    timed = F.col("slot").isNotNull()
    per_station = raw.groupBy("station_id").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(~timed, F.col("rows"))), F.lit(0)).alias("bad"),
        F.count_if(timed).alias("kept"),
        F.min("slot").alias("lo"),
        F.max("slot").alias("hi"),
    )
    size = F.when(F.col("lo").isNotNull(), F.col("hi") - F.col("lo") + 1).otherwise(0)
    total = per_station.agg(
        F.sum("rows").alias("rows_in"),
        F.sum("bad").alias("bad_timestamp_dropped"),
        (F.sum("rows") - F.sum("bad") - F.sum("kept")).alias("duplicates_dropped"),
        (F.sum(size) - F.sum("kept")).alias("gap_rows_added"),
        F.sum(size).alias("rows_out"),
        F.count_if(F.col("lo").isNotNull()).alias("stations"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
    )
    return total.withColumns({"first_time": from_slot(F.col("lo")), "last_time": from_slot(F.col("hi"))}).drop("lo", "hi")
