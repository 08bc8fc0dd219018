"""File and payload readers. Everything arrives as text and is typed by the caller's operators."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch import constants as K
from tarnwatch.functions.parse import parse_numeric, parse_time

from .contracts import require_columns


def read_csv(spark: SparkSession, path, columns=None) -> DataFrame:
    """CSV with a header, every column as text. With `columns` the schema is explicit and no file is opened early."""
    reader = spark.read.option("header", True).option("enforceSchema", False)
    if columns is not None:
        reader = reader.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
    return reader.csv(path)


# The order in which an inbox's rows count: by file name, then by place in the file.
ARRIVAL = ["_file", "_block", "_row"]


def read_inbox(spark: SparkSession, folder: str, columns) -> DataFrame:
    """All exports of a folder, with sortable arrival columns (`ARRIVAL`) for first-wins and last-wins rules."""
    return (
        read_csv(spark, folder, columns)
        .select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
        .withColumn("_row", F.monotonically_increasing_id())
    )


def read_readings(df: DataFrame, order: Column | None = None) -> DataFrame:
    """Lake readings as typed columns. Unreadable numbers and times become NULL.

    `src_ord` is the order in which rows count: `order`, else the arrival columns of an inbox (file by file, by place in
    the file), else the order of the table's partitions.
    """
    require_columns(df, K.READING_COLUMNS, "sensor data")
    if order is None:
        order = F.struct(*ARRIVAL) if set(ARRIVAL) <= set(df.columns) else F.monotonically_increasing_id()
    return df.select(
        F.col("station_id").cast("string").alias("station_id"),
        _time(df, "timestamp").alias("timestamp"),
        *[parse_numeric(s).alias(s) for s in K.LAKE_SENSORS],
        order.alias("src_ord"),
    )


def _time(df: DataFrame, name: str) -> Column:
    return F.col(name) if df.schema[name].dataType == T.TimestampNTZType() else parse_time(name)


def read_lab(df: DataFrame, target: str, limits=None) -> DataFrame:
    """Lab rows with their parsed target and whether each can be used: a known time and a positive value in range."""
    require_columns(df, ["station_id", "timestamp", target], "lab data")
    low, high = limits or K.LAB_LIMITS[target]
    out = df.withColumns({"station_id": F.col("station_id").cast("string"), "timestamp": _time(df, "timestamp")})
    out = out.withColumn(target, parse_numeric(target))
    usable = F.col("timestamp").isNotNull() & (F.col(target) > 0) & F.col(target).between(low, high)
    return out.withColumn("usable", F.coalesce(usable, F.lit(False)))


WEATHER_PAYLOAD = T.StructType(
    [
        T.StructField(
            "hourly",
            T.StructType(
                [
                    T.StructField("time", T.ArrayType(T.StringType())),
                    *[T.StructField(v, T.ArrayType(T.DoubleType())) for v in K.WEATHER_VARIABLES],
                ]
            ),
        )
    ]
)


def weather_from_payload(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Hourly weather rows from a forecast service's JSON of parallel arrays, in this library's names and units."""
    hourly = df.select(F.from_json(payload, WEATHER_PAYLOAD).alias("p")).select("p.hourly.*")
    # A variable the service did not send is unknown at every hour.
    unknown = F.transform("time", lambda t: F.lit(None).cast("double"))
    hourly = hourly.withColumns({v: F.coalesce(F.col(v), unknown) for v in K.WEATHER_VARIABLES})
    rows = hourly.select(F.explode(F.arrays_zip("time", *K.WEATHER_VARIABLES)).alias("r"))
    return rows.select(
        parse_time("r.time").alias("timestamp"),
        *[(F.col(f"r.{v}") * factor).alias(name) for v, (name, factor) in K.WEATHER_VARIABLES.items()],
    )
