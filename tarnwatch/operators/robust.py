"""Robust scales, seasonal bands and long trailing medians of lake sensors."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwatch import constants as K
from tarnwatch.functions.clock import from_slot
from tarnwatch.functions.working import in_range, to_working

from .chunks import CHUNK, CORE, SLOT_CHUNK, framed, with_halo
from .lineage import materialise
from .order_stats import POOLED, median, quantiles, robust_std, table_of


def per_sensor(values: dict) -> Column:
    """A value per sensor name, looked up by the `sensor` column."""
    pairs = [F.lit(x) for s, v in values.items() for x in (s, float(v))]
    return F.try_element_at(F.create_map(*pairs), F.col("sensor"))


def long(df: DataFrame, keys, sensors=K.LAKE_SENSORS, name: str = "value") -> DataFrame:
    """One row per key and sensor."""
    return df.select(*keys, *sensors).unpivot(keys, sensors, "sensor", name)


def working(grid: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """In-range readings on the working scale."""
    return grid.withColumns({s: to_working(F.when(in_range(s, K.VALID_RANGES[s]), F.col(s)), s) for s in sensors})


def steps(grid: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """One-step differences on a gap-free slot grid; a gap on either side gives NULL."""
    return framed(
        grid,
        ["station_id"],
        "slot",
        [lambda w: {s: F.col(s) - F.lag(s).over(w) for s in sensors}],
        before=1,
        width=SLOT_CHUNK,
    )


def widened(table: DataFrame, value: str, sensors, name: str) -> DataFrame:
    """A (station_id, sensor) parameter table as one written row per station, the pooled key as NULL."""
    cols = [F.max(F.when(F.col("sensor") == s, F.col(value))).alias(f"scale_{s}") for s in sensors]
    wide = table.groupBy("station_id").agg(*cols)
    return materialise(wide.withColumn("station_id", F.when(F.col("station_id") != POOLED, F.col("station_id"))), name)


def scales(values: DataFrame, floors=K.MIN_SCALE, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Robust `scale_<sensor>` per station, plus the all-station scales under the key NULL, from one grouping."""
    rows = table_of(values.select("station_id", *sensors))
    out = robust_std(long(rows, ["station_id"], sensors), ["station_id", "sensor"], "value", per_sensor(floors), pooled="station_id")
    return widened(out, "scale", sensors, "scales")


def scale_columns(df: DataFrame, table: DataFrame, floors=K.MIN_SCALE, sensors=K.LAKE_SENSORS, prefix="scale_") -> DataFrame:
    """Adds `<prefix><sensor>` per row: the station's own scale, else the all-station one, else the floor.

    The lookup is one row per station; Spark broadcasts it while its measured size allows and shuffles it otherwise.
    """
    own = table.filter(F.col("station_id").isNotNull())
    pooled = table.filter(F.col("station_id").isNull())
    found = {s: f"_own_{prefix}{s}" for s in sensors}
    out = df.join(own.select("station_id", *[F.col(f"scale_{s}").alias(n) for s, n in found.items()]), "station_id", "left")
    out = out.withColumns(
        {
            f"{prefix}{s}": F.coalesce(F.col(n), pooled.select(f"scale_{s}").scalar(), F.lit(float(floors[s])))
            for s, n in found.items()
        }
    )
    return out.drop(*found.values())


def step_scales(grid: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Robust scale of one-step changes per station; the key NULL holds each sensor's median over stations."""
    changes = long(table_of(steps(working(grid, sensors), sensors).select("station_id", *sensors)), ["station_id"], sensors)
    own = materialise(robust_std(changes, ["station_id", "sensor"], "value", per_sensor(K.RESOLUTION)), "step_scales")
    shared = median(own, ["sensor"], "scale", "scale").select(F.lit(POOLED).alias("station_id"), "sensor", "scale")
    return widened(own.unionByName(shared), "scale", sensors, "step_scales")


def bands(values: DataFrame, keys, sensors=K.LAKE_SENSORS, probs=K.BAND_QUANTILES, margin=K.BAND_MARGIN, pooled: str | None = None) -> DataFrame:
    """Per key and sensor the outer quantiles widened by a margin; NULL with fewer than a day of values."""
    rows = table_of(values.select(*keys, *sensors))
    q = quantiles(long(rows, keys, sensors), [*keys, "sensor"], "value", {"q_low": probs[0], "q_high": probs[1]}, pooled)
    pad = F.lit(float(margin)) * (F.col("q_high") - F.col("q_low"))
    known = F.col("n") >= K.BAND_MIN_VALUES
    return q.select(
        *keys, "sensor", F.when(known, F.col("q_low") - pad).alias("low"), F.when(known, F.col("q_high") + pad).alias("high")
    )


def wide_bands(band_table: DataFrame, keys, sensors=K.LAKE_SENSORS) -> DataFrame:
    """One row per key with `<sensor>_low` and `<sensor>_high`."""
    cols = [
        F.max(F.when(F.col("sensor") == s, F.col(side))).alias(f"{s}_{side}") for s in sensors for side in ("low", "high")
    ]
    return band_table.groupBy(*keys).agg(*cols)


def monthly_bands(values: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Seasonal band per station and month."""
    dated = values.withColumn("month", F.month(from_slot(F.col("slot"))))
    keys = ["station_id", "month"]
    return materialise(wide_bands(bands(dated, keys, sensors), keys, sensors), "bands")


def envelope(values: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Training envelope per station, plus the all-station one under the key NULL."""
    out = wide_bands(bands(values, ["station_id"], sensors, pooled="station_id"), ["station_id"], sensors)
    return materialise(out.withColumn("station_id", F.when(F.col("station_id") != POOLED, F.col("station_id"))), "envelope")


def with_monthly_bands(grid: DataFrame, table: DataFrame) -> DataFrame:
    """Each slot beside its station-month band; a month never seen has none."""
    dated = grid.withColumn("month", F.month(from_slot(F.col("slot"))))
    return dated.join(table, ["station_id", "month"], "left").drop("month")


def inside_envelope(df: DataFrame, table: DataFrame, sensors) -> DataFrame:
    """Adds `inside_<sensor>`: within the station's envelope (the all-station one where it has none)."""
    pooled, own = table.filter(F.col("station_id").isNull()), table.filter(F.col("station_id").isNotNull())
    sides = [f"{s}_{side}" for s in sensors for side in ("low", "high")]
    out = df.join(own.select("station_id", *sides), "station_id", "left")
    limit = {c: F.coalesce(F.col(c), pooled.select(F.max(c)).scalar()) for c in sides}
    inside = {
        f"inside_{s}": F.coalesce(F.col(s).between(limit[f"{s}_low"], limit[f"{s}_high"]), F.lit(False)) for s in sensors
    }
    return out.withColumns(inside).drop(*sides)


def trailing_medians(grid: DataFrame, columns, window: int, min_count: int, suffix: str = "_base") -> DataFrame:
    """Adds a trailing median per column over `window` slots, NULL with fewer than `min_count` values.

    A sorted frame of a thousand rows per row is too slow as a Spark window, so pandas slides it inside
    (station, chunk) groups; each group carries the window's overlap, so chunk edges change nothing.
    """
    chunked = with_halo(grid, "slot", SLOT_CHUNK, before=window - 1)
    schema = T.StructType(
        [f for f in chunked.schema.fields if f.name not in (CHUNK, CORE)]
        + [T.StructField(f"{c}{suffix}", T.DoubleType()) for c in columns]
    )

    def slide(pdf):
        pdf = pdf.sort_values("slot").reset_index(drop=True)
        middle = pdf[list(columns)].astype(float).rolling(window, min_periods=min_count).median().add_suffix(suffix)
        out = pd.concat([pdf.drop(columns=[CHUNK, CORE]), middle], axis=1)
        return out.loc[pdf[CORE].to_numpy(dtype=bool)]

    return chunked.groupBy("station_id", CHUNK).applyInPandas(slide, schema)
