"""Exports that appear in a folder, taken in once each; the newest copy of a reading wins."""

import datetime
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tarnwatch.operators.grid import latest_wins
from tarnwatch.sources import snapshots
from tarnwatch.sources.readers import ARRIVAL


def inbox_stream(spark: SparkSession, folder: str, columns, files_per_batch: int = 200) -> DataFrame:
    """New CSV files of a folder as text columns, with the file and block they came from, so many files a batch."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    rows = spark.readStream.schema(schema).option("header", True).option("maxFilesPerTrigger", files_per_batch).csv(folder)
    return rows.select(
        "*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    )


def take_in(inbox: DataFrame, stamp: str, log: str, checkpoint: str) -> StreamingQuery:
    """Append every waiting file to the history log, once each, partitioned by the reading's day.

    The log is a table of snapshots (`sources.snapshots`): a batch becomes visible as a whole, and one that is retried after
    a failure is left out if it was committed before. Nothing older is rewritten, however long the history is.
    """

    def append(batch: DataFrame, batch_id: int) -> None:
        day = F.coalesce(F.substring(F.trim(F.col(stamp)), 1, 10), F.lit("unknown"))
        rows = batch.withColumns({"_batch": F.lit(batch_id).cast("bigint"), "_row": F.monotonically_increasing_id(), "_day": day})
        snapshots.append(rows.repartition("_day"), log, "_day", checkpoint, batch_id)

    return inbox.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def history(spark: SparkSession, log: str, station: str, stamp: str, since: str | None = None) -> DataFrame:
    """The log's newest snapshot with one row per station and raw time text, the last to arrive.

    `since` (a day as it begins the time texts) reads only the folders of that day and later; a reading's day follows from
    its time text, so it is a key and filters on `_day` reach the scan.
    """
    return latest_wins(snapshots.read(spark, log, least=since), [station, stamp, "_day"], ["_batch", *ARRIVAL])


def last_day(spark: SparkSession, log: str) -> datetime.date | None:
    """The newest day that the log holds, read from its manifest. Values that are no day (`unknown`) do not count."""
    now = snapshots.snapshot(spark, log)
    days = [d for _, v in now.entries if (d := _day(now.value(v)))] if now else []
    return max(days, default=None)


def _day(text: str | None) -> datetime.date | None:
    try:
        return datetime.date.fromisoformat(text or "")
    except ValueError:
        return None


def compact(spark: SparkSession, log: str, station: str, stamp: str, target: str) -> None:
    """Write the deduplicated history as a new table, one set of files per day."""
    history(spark, log, station, stamp).repartition("_day").write.mode("errorifexists").partitionBy("_day").parquet(target)


def compact_days(spark: SparkSession, log: str, station: str, stamp: str) -> list[str]:
    """Rewrite in place the days that several batches wrote to, one row per station and time. Returns these days.

    Batches that arrive meanwhile stay as they are and still win over what is compacted, as rows keep their arrival columns.
    """
    base = snapshots.snapshot(spark, log)
    writes = Counter(v for _, v in base.entries) if base else {}
    days = sorted(base.value(v) for v, n in writes.items() if n > 1)
    if days:
        rows = snapshots.read(spark, log, base).filter(F.col("_day").isin(days))
        once = latest_wins(rows, [station, stamp, "_day"], ["_batch", *ARRIVAL])
        snapshots.replace(once.repartition("_day"), log, base, days)
    return days
