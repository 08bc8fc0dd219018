"""Runs of equal or flagged rows on a gap-free grid."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SLOT_CHUNK, carry_last, framed
from .lake_qc import run_of
from .lineage import materialise


def unchanged_run(grid: DataFrame, column: str, resolution: float, name: str = "repeats") -> DataFrame:
    """Adds how many readings in a row (this one included) stayed within `resolution`; a missing value breaks a run.

    A run's length is the distance to the last break, which crosses chunk edges as one carried slot number.
    """
    same = F.coalesce(F.abs(F.col(column) - F.col("_prev")) <= resolution, F.lit(False))
    out = framed(grid, ["station_id"], "slot", [lambda w: {"_prev": F.lag(column).over(w)}], before=1, width=SLOT_CHUNK)
    out = materialise(out.withColumn("_same", same), "runs")
    out = carry_last(out, ["station_id"], "slot", {"_break": F.when(~F.col("_same"), F.col("slot"))}, SLOT_CHUNK)
    return out.withColumn(name, F.col("slot") - F.col("_break") + 1).drop("_prev", "_same", "_break")


def sustained(grid: DataFrame, flag: str, min_points: int, name: str) -> DataFrame:
    """Adds whether `flag` has held for at least `min_points` rows in a row, this one included."""
    return framed(
        grid, ["station_id"], "slot", [lambda w: {name: run_of(flag, min_points, w)}], before=min_points - 1, width=SLOT_CHUNK
    )
