"""Where results go: one folder per run, parallel writers only, nothing gathered on the driver."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Spark writes milliseconds unless it is told otherwise.
CSV = {"header": True, "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> list[str]:
    """Each non-empty table under `folder/<name>`; returns the names written. An existing run is never overwritten."""
    written = []
    for name, df in tables.items():
        if df is None or df.isEmpty():
            continue
        writer = df.write.mode("errorifexists")
        (writer.options(**CSV).csv if fmt == "csv" else writer.parquet)(f"{folder}/{name}")
        written.append(name)
    return written


def write_json(df: DataFrame, folder: str) -> None:
    """One JSON document per row: a report has one line per station, whatever the size of the fleet."""
    df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("errorifexists").text(folder)


def write_lines(lines: DataFrame, folder: str, order=("station_id", "line_no")) -> None:
    """Text lines in reading order across files: ranges of `order` go to successive files, sorted inside each."""
    ranged = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.select("line").write.mode("errorifexists").text(folder)


def append_scores(scores: DataFrame, folder: str, run: str) -> None:
    """Scores of a training run, added to the history of runs as their own partition."""
    scores.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(folder)
