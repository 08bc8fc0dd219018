"""Vendor exports: rename, alias, local time, sensor-limit censoring and unit conversion, as one projection."""

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.parse import local_time, parse_numeric, parse_time
from tarnwatch.functions.water import calibrated_turbidity, do_percent_to_mgl

from .contracts import require_columns


@dataclass
class VendorMapping:
    """How one vendor writes our columns. `limits` gives each sensor's measuring range; None censors nothing there."""

    columns: dict[str, str] = field(default_factory=lambda: {c: c for c in K.READING_COLUMNS})
    stations: dict[str, str] = field(default_factory=dict)
    oxygen_unit: str = "mg/L"
    turbidity_unit: str = "NTU"
    turbidity_calibration: tuple[float, float] | None = None
    limits: dict[str, tuple[float | None, float | None]] = field(default_factory=dict)
    pressure_atm: float = K.PRESSURE_ATM
    timezone: str | None = None

    def __post_init__(self):
        for name, unit, known in (
            ("dissolved_oxygen", self.oxygen_unit, ("mg/L", "percent")),
            ("turbidity", self.turbidity_unit, ("NTU", "percent")),
        ):
            if unit not in known:
                raise ValueError(f"unit {unit!r} for {name} is not one of {known}")

    @property
    def reported_turbidity_unit(self) -> str:
        return "%" if self.turbidity_unit == "percent" and self.turbidity_calibration is None else "NTU"


def at_limit(sensor: str, limits) -> Column:
    low, high = limits
    cond = F.lit(False)
    if low is not None:
        cond = cond | (F.col(sensor) <= low)
    if high is not None:
        cond = cond | (F.col(sensor) >= high)
    return F.coalesce(cond, F.lit(False))


def renamed(raw: DataFrame, mapping: VendorMapping) -> DataFrame:
    """Our column names, trimmed and aliased stations, local times, numbers. Other columns (arrival order) stay."""
    require_columns(raw, mapping.columns.values(), "the export")
    out = raw.withColumnsRenamed({vendor: ours for ours, vendor in mapping.columns.items()})
    station = F.trim(F.col("station_id").cast("string"))
    if mapping.stations:
        alias = F.create_map(*[F.lit(x) for pair in mapping.stations.items() for x in pair])
        station = F.coalesce(F.try_element_at(alias, station), station)
    stamp = local_time("timestamp", mapping.timezone) if mapping.timezone else parse_time("timestamp")
    return out.withColumns(
        {"station_id": station, "timestamp": stamp, **{s: parse_numeric(s) for s in K.LAKE_SENSORS}}
    )


def censored(df: DataFrame, mapping: VendorMapping) -> DataFrame:
    """Readings pinned at a sensor's range limit become NULL, remembered in `<sensor>_at_limit`."""
    flags = {f"{s}_at_limit": at_limit(s, mapping.limits[s]) if s in mapping.limits else F.lit(False) for s in K.LAKE_SENSORS}
    out = df.withColumns(flags)
    return out.withColumns({s: F.when(~F.col(f"{s}_at_limit"), F.col(s)) for s in mapping.limits})


def converted(df: DataFrame, mapping: VendorMapping) -> DataFrame:
    """Oxygen in mg/L and, with a calibration, turbidity in NTU."""
    changes = {}
    if mapping.oxygen_unit == "percent":
        changes["dissolved_oxygen"] = do_percent_to_mgl("dissolved_oxygen", "temperature", mapping.pressure_atm)
    if mapping.turbidity_unit == "percent" and mapping.turbidity_calibration:
        changes["turbidity"] = calibrated_turbidity("turbidity", *mapping.turbidity_calibration)
    return df.withColumns(changes) if changes else df


def normalise(raw: DataFrame, mapping: VendorMapping) -> DataFrame:
    """A vendor export as readings every operator expects; rows without a readable time are left out."""
    return converted(censored(renamed(raw, mapping), mapping), mapping).filter(F.col("timestamp").isNotNull())


def censor_counts(df: DataFrame) -> DataFrame:
    """Per station and sensor, how many readings sat at a range limit (only where any did)."""
    long = df.unpivot(["station_id"], [f"{s}_at_limit" for s in K.LAKE_SENSORS], "sensor", "hit").filter("hit")
    sensor = F.regexp_replace("sensor", "_at_limit$", "")
    return long.groupBy("station_id", sensor.alias("sensor")).agg(F.count(F.lit(1)).alias("readings"))


def ingest_report(raw: DataFrame, mapping: VendorMapping) -> DataFrame:
    """One row: rows read, rows without a time, and readings at a limit per sensor, in one pass over the export."""
    df = censored(renamed(raw, mapping), mapping)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("timestamp").isNull()).alias("rows_without_time"),
        *[F.count_if(f"{s}_at_limit").alias(f"{s}_at_limit") for s in K.LAKE_SENSORS],
    )
