"""Departures from each station's own baseline, sustained events, event onsets, and the two-sided z."""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.working import count_true

from .chunks import SLOT_CHUNK, framed
from .lake_qc import any_of
from .recursions import clipped_scan, smoothing
from .robust import scale_columns, scales, trailing_medians


def with_baseline(clean: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Adds `<s>_base`, the trailing weekly median, unless it is there: write the result where several steps need it."""
    if all(f"{s}_base" in clean.columns for s in sensors):
        return clean
    return trailing_medians(clean, sensors, K.BASELINE_SLOTS, K.SLOTS_PER_DAY)


def departure_scales(clean: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Normal spread of each sensor around its trailing weekly median, per station and over all stations."""
    based = with_baseline(clean, sensors)
    return scales(based.select("station_id", *[(F.col(s) - F.col(f"{s}_base")).alias(s) for s in sensors]), sensors=sensors)


def departures(clean: DataFrame, scale_table: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Adds `dep_<s>` (departure from the trailing weekly median in normal spreads), how many depart, and whether
    enough do to make an event candidate."""
    based = scale_columns(with_baseline(clean, sensors), scale_table, prefix="_dscale_")
    out = based.withColumns({f"dep_{s}": (F.col(s) - F.col(f"{s}_base")) / F.col(f"_dscale_{s}") for s in sensors})
    n = count_true([(F.abs(F.col(f"dep_{s}")) > K.EVENT_Z) & F.col(s).isNotNull() for s in sensors])
    out = out.withColumn("n_departing", n).withColumn("candidate", F.col("n_departing") >= K.EVENT_MIN_SENSORS)
    return out.drop(*[f"_dscale_{s}" for s in sensors], *[f"{s}_base" for s in sensors])


def two_sided(raw, trend_free) -> Column:
    """The smaller of two z values where they agree in sign, 0 where they do not, NULL without a raw value."""
    raw, flat = F.col(raw) if isinstance(raw, str) else raw, F.col(trend_free) if isinstance(trend_free, str) else trend_free
    both = F.signum(raw) * F.least(F.abs(raw), F.abs(flat))
    return F.when(raw.isNotNull(), F.when(F.signum(raw) == F.signum(flat), both).otherwise(0.0))


def relabel_onsets(df: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Rows with only soft faults in the lead-up to a confirmed event become part of it; their soft faults clear.

    Needs `event` and `<s>_fault` on a gap-free slot grid; looks one slot back and `ONSET_SLOTS` ahead.
    """
    soft = any_of([F.col(f"{s}_fault").isin(K.SOFT_FAULTS) for s in sensors])
    shape = any_of([F.col(f"{s}_fault").isin(K.SHAPE_FAULTS) for s in sensors])

    def starts(w):
        return {"_start": F.col("event") & ~F.coalesce(F.lag("event").over(w), F.lit(False))}

    def ahead(w):
        coming = F.bool_or("_start").over(w.rowsBetween(1, K.ONSET_SLOTS))
        return {"_onset": F.coalesce(coming, F.lit(False)) & soft & ~shape}

    out = framed(df, ["station_id"], "slot", [starts, ahead], before=1, after=K.ONSET_SLOTS + 1, width=SLOT_CHUNK)
    out = out.withColumns(
        {
            f"{s}_fault": F.when(F.col("_onset") & F.col(f"{s}_fault").isin(K.SOFT_FAULTS), "").otherwise(F.col(f"{s}_fault"))
            for s in sensors
        }
    )
    return out.withColumn("event", F.col("event") | F.col("_onset")).drop("_start", "_onset")


def slot_weight(hours: float) -> float:
    """Smoothing weight of a time constant in hours on the 10-minute grid."""
    return 1 - math.exp(-1 / (hours * K.SLOTS_PER_HOUR))


def drift_levels(df: DataFrame, pairs: dict, limits: dict) -> DataFrame:
    """Adds drift alarm levels (1 = alarm), zero unless the last hour of plain disagreement leans the same way.

    `pairs[name]` is `(z, raw, reset)` as Columns; `limits[name]` the learned alarm level as a Column.
    """

    def clipped(x):
        return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(-K.DRIFT_CLIP)), F.lit(K.DRIFT_CLIP)))

    scans = {}
    for name, (z, raw, reset) in pairs.items():
        scans[f"_long_{name}"] = smoothing(clipped(z), slot_weight(K.DRIFT_HOURS), reset, limits[name] * K.DRIFT_CAP)
        scans[f"_last_{name}"] = smoothing(clipped(raw), slot_weight(K.DRIFT_CONFIRM_HOURS), reset)
    out = clipped_scan(df, ["station_id"], "slot", scans, SLOT_CHUNK)

    def level(name):
        long, last, limit = F.col(f"_long_{name}"), F.col(f"_last_{name}"), limits[name]
        sure = (F.signum(long) == F.signum(last)) & (F.abs(last) >= limit * K.DRIFT_CONFIRM_FRACTION)
        return F.when(sure, F.abs(long) / limit).otherwise(0.0)

    return out.withColumns({name: level(name) for name in pairs}).drop(*scans)
