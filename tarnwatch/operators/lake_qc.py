"""Rule tests on the 10-minute grid: missing, out of range, flat line, spike, rate of change, seasonal band."""

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.working import in_range, to_working

from .chunks import SLOT_CHUNK, framed

REACH_BACK = K.FLAT_FAIL  # the longest run a test looks at


def _no(cond: Column) -> Column:
    return F.coalesce(cond, F.lit(False))


def run_of(flag: str, n: int, w) -> Column:
    """Whether this row and the `n - 1` before it exist and all carry `flag`."""
    frame = w.rowsBetween(-(n - 1), 0)
    return _no(F.bool_and(flag).over(frame) & (F.count(F.lit(1)).over(frame) == n))


def rule_tests(grid: DataFrame, sensors=K.LAKE_SENSORS, bands: bool = False) -> DataFrame:
    """Adds `<s>_qc` (1 pass, 3 suspect, 4 fail, 9 missing) and `<s>_reason` per sensor.

    `grid` is gap-free, with `scale_<s>` (normal step size) and, when `bands`, `<s>_low`/`<s>_high`. Every frame is
    bounded, so all tests of all sensors share one shuffle and one sort by (station, chunk).
    """

    def basics(w):
        out = {}
        for s in sensors:
            x = F.col(s)
            out[f"_out_{s}"] = _no(~in_range(s, K.VALID_RANGES[s]))
            out[f"_same_{s}"] = _no(F.abs(x - F.lag(x).over(w)) <= K.RESOLUTION[s])
            out[f"_w_{s}"] = to_working(F.when(in_range(s, K.VALID_RANGES[s]), x), s)
        return out

    def tests(w):
        out = {}
        five = w.rowsBetween(-2, 2)
        for s in sensors:
            x = F.col(f"_w_{s}")
            # A run of n equal readings is n - 1 unchanged steps in a row.
            out[f"_flat_{s}"] = run_of(f"_same_{s}", K.FLAT_SUSPECT - 1, w)
            out[f"_dead_{s}"] = run_of(f"_same_{s}", K.FLAT_FAIL - 1, w)
            middle = F.when(F.count(x).over(five) >= 3, F.percentile(x, F.lit(0.5)).over(five))
            out[f"_off_{s}"] = F.abs(x - middle) / F.col(f"scale_{s}")
            out[f"_rate_{s}"] = _no(F.abs(x - F.lag(x).over(w)) / F.col(f"scale_{s}") >= K.RATE_LIMIT)
        return out

    out = framed(grid, ["station_id"], "slot", [basics, tests], before=REACH_BACK, after=2, width=SLOT_CHUNK)
    final = {}
    for s in sensors:
        x, w = F.col(s), F.col(f"_w_{s}")
        spike, bad_spike = _no(F.col(f"_off_{s}") >= K.SPIKE_SUSPECT), _no(F.col(f"_off_{s}") >= K.SPIKE_FAIL)
        season = _no((w < F.col(f"{s}_low")) | (w > F.col(f"{s}_high"))) if bands else F.lit(False)
        final[f"{s}_qc"] = (
            F.when(x.isNull(), K.QC_MISSING)
            .when(F.col(f"_out_{s}") | bad_spike | F.col(f"_dead_{s}"), K.QC_FAIL)
            .when(season | F.col(f"_rate_{s}") | spike | F.col(f"_flat_{s}"), K.QC_SUSPECT)
            .otherwise(K.QC_PASS)
        )
        final[f"{s}_reason"] = (
            F.when(x.isNull(), "missing")
            .when(F.col(f"_out_{s}"), "out_of_range")
            .when(F.col(f"_flat_{s}"), "flatline")
            .when(spike, "spike")
            .when(F.col(f"_rate_{s}"), "rate_of_change")
            .when(season, "climatology")
            .otherwise("")
        )
    out = out.withColumns(final)
    return out.drop(*[f"_{t}_{s}" for s in sensors for t in ("out", "same", "w", "flat", "dead", "off", "rate")])


def clean_values(flagged: DataFrame, rejecting, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Working-scale readings without those whose reason is in `rejecting`."""
    return flagged.withColumns(
        {
            s: to_working(
                F.when(in_range(s, K.VALID_RANGES[s]) & ~F.col(f"{s}_reason").isin(list(rejecting)), F.col(s)), s
            )
            for s in sensors
        }
    )


def any_of(conditions) -> Column:
    return reduce(or_, conditions)
