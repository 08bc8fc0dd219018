"""Lab samples: cleaning, last results, and the sensors' last complete hour beside each sample."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import hour_no, micros
from tarnwatch.functions.working import all_present

from .chunks import carry_last
from .grid import earliest_wins
from .joins import HOUR_US, as_of_row
from .lineage import materialise


def clean_lab(lab: DataFrame, target: str, order: str = "src_ord") -> DataFrame:
    """Usable samples (see `readers.read_lab`), the first to arrive per station and time."""
    # Written first: a filter on parsed columns is pushed into the scan with the parsing in it, several times over.
    parsed = materialise(lab.select("station_id", "timestamp", target, order, "usable"), "lab")
    kept = parsed.filter("usable").drop("usable")
    return earliest_wins(kept, ["station_id", "timestamp"], [order])


def lab_report(lab: DataFrame) -> DataFrame:
    """Samples in, unusable ones, duplicates and what is left, in one grouped pass."""
    times = lab.groupBy("station_id", "timestamp").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("usable").alias("ok")
    )
    return times.agg(
        F.sum("n").alias("samples_in"),
        (F.sum("n") - F.sum("ok")).alias("unusable_dropped"),
        (F.sum("ok") - F.count_if(F.col("ok") > 0)).alias("duplicates_dropped"),
        F.count_if(F.col("ok") > 0).alias("samples_out"),
    )


def beside_sensors(lab: DataFrame, hourly: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Each sample with the sensors' last hour that ended at most two hours before it; only complete hours.

    Sensor columns the lab measured too are kept as `lab_<name>`.
    """
    own = {s: f"lab_{s}" for s in sensors if s in lab.columns}
    asked = lab.withColumnsRenamed(own).filter(F.col("timestamp").isNotNull()).withColumn("_us", micros(F.col("timestamp")))
    facts = hourly.withColumn("_us", (F.col("hour") + 1) * HOUR_US)
    out = as_of_row(asked, facts, ["station_id"], "_us", sensors, K.SLOT_MINUTES * 12 * 60_000_000)
    return out.filter(all_present(sensors)).drop("_us")


def with_previous(lab: DataFrame, target: str, name: str = "previous") -> DataFrame:
    """Adds the station's previous result of `target` (in time order), across any gap."""
    timed = lab.withColumn("_us", micros(F.col("timestamp"))).withColumn("_hour", hour_no(F.col("timestamp")))
    row = F.struct(F.col(target).alias("v"))
    out = carry_last(timed, ["station_id"], "_hour", {"_p": row}, 24, inclusive=False, order=["_us"])
    return out.withColumn(name, F.col("_p.v")).drop("_us", "_hour", "_p")
