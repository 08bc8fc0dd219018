"""Water quality grading as column expressions: oxygen units, WQI, CPCB use class, trophic state, coliform bands."""

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch import constants as K

from .working import as_col, at_least, finite


def do_saturation(temp_c, pressure_atm: float = 1.0) -> Column:
    """Freshwater oxygen saturation in mg/L (Benson and Krause 1984)."""
    t = as_col(temp_c) + 273.15
    ln_c = (
        F.lit(-139.34411) + F.lit(1.575701e5) / t - F.lit(6.642308e7) / (t * t) + F.lit(1.2438e10) / (t * t * t)
        - F.lit(8.621949e11) / (t * t * t * t)
    )
    return F.exp(ln_c) * F.lit(float(pressure_atm))


def do_percent_to_mgl(percent, temp_c, pressure_atm: float = 1.0) -> Column:
    return as_col(percent) / 100.0 * do_saturation(temp_c, pressure_atm)


def oxygen_deficit(temperature="temperature", oxygen="dissolved_oxygen", pressure_atm: float = K.PRESSURE_ATM) -> Column:
    return do_saturation(temperature, pressure_atm) - as_col(oxygen)


def calibrated_turbidity(percent, slope: float, intercept: float) -> Column:
    return at_least(F.lit(float(slope)) * as_col(percent) + F.lit(float(intercept)), 0.0)


def quality_rating(name: str, value) -> Column:
    """0 at the ideal value, 100 at the permissible standard; acidic pH is rated against its lower standard."""
    x, ideal = as_col(value), K.WQI_IDEAL[name]
    rating = (x - ideal) * 100.0 / (K.WQI_STANDARD[name] - ideal)
    if name in K.WQI_LOWER_STANDARD:
        low = (x - ideal) * 100.0 / (K.WQI_LOWER_STANDARD[name] - ideal)
        rating = F.when(x < ideal, low).otherwise(rating)
    return at_least(rating, 0.0)


def label_columns(columns) -> dict[str, str]:
    """Which column grades each WQI parameter: `lab_<name>` when the table has it, else `<name>`."""
    return {n: f"lab_{n}" if f"lab_{n}" in columns else n for n in K.WQI_STANDARD}


def wqi(columns: dict[str, str] | None = None) -> Column:
    columns = columns or {n: n for n in K.WQI_STANDARD}
    scale = 1.0 / sum(1.0 / s for s in K.WQI_STANDARD.values())
    return reduce(add, [quality_rating(n, columns[n]) * (scale / si) for n, si in K.WQI_STANDARD.items()])


def _first_bound(x, bounds, beyond: str, inclusive: bool) -> Column:
    x = as_col(x)
    chain = F.when(x.isNull(), None)
    for upper, label in bounds:
        chain = chain.when(x <= upper if inclusive else x < upper, label)
    return chain.otherwise(beyond)


def wqi_class(value) -> Column:
    return _first_bound(value, K.WQI_CLASS_BOUNDS, K.WQI_WORST, inclusive=True)


def class_rank(label) -> Column:
    """0 for the cleanest WQI class."""
    return F.array_position(F.array(*[F.lit(c) for c in K.WQI_CLASSES]), as_col(label)) - 1


def cpcb_class(oxygen, ph, p_bod: dict, p_coliform: dict | None = None) -> Column:
    """Struct of best designated-use class met, its confidence, and what was not assessed.

    `p_bod` and `p_coliform` map each limit to P(value <= limit), taken as independent.
    """
    do, ph = as_col(oxygen), as_col(ph)

    def row(cls, confidence, unassessed):
        return F.struct(
            F.lit(cls).alias("cpcb_class"),
            confidence.cast("double").alias("cpcb_confidence"),
            F.lit(unassessed).alias("cpcb_not_assessed"),
        )

    chain = F.when(do.isNull() | ph.isNull(), row("unknown", F.lit(None), ""))
    for name, do_min, bod_max, coliform_max, ph_low, ph_high, missing in K.CPCB_CLASSES:
        p = F.lit(1.0)
        if bod_max is not None:
            p = p * as_col(p_bod[bod_max])
        known = coliform_max is not None and p_coliform is not None
        if known:
            p = p * as_col(p_coliform[coliform_max])
        met = ph.between(ph_low, ph_high) & (p >= 0.5)
        if do_min is not None:
            met = met & (do >= do_min)
        chain = chain.when(met, row(name, p, "" if known else missing))
    return chain.otherwise(row("below E", F.lit(None), ""))


def carlson_tsi(chlorophyll) -> Column:
    return F.lit(9.81) * F.ln(as_col(chlorophyll)) + 30.6


def chlorophyll_at(tsi) -> Column:
    return F.exp((as_col(tsi) - 30.6) / 9.81)


def trophic_class(tsi) -> Column:
    return _first_bound(tsi, K.TROPHIC_BOUNDS, K.TROPHIC_WORST, inclusive=False)


def trophic_odds(p_above: list) -> dict[str, Column]:
    """Chance of each class from the chances of exceeding the three inner bounds."""
    edges = [F.lit(1.0), *[as_col(p) for p in p_above], F.lit(0.0)]
    names = [n for _, n in K.TROPHIC_BOUNDS] + [K.TROPHIC_WORST]
    return {f"p_{n}": edges[i] - edges[i + 1] for i, n in enumerate(names)}


def who_level(p_above_12, p_above_24, alert: float = K.ALERT_PROBABILITY) -> Column:
    return (
        F.when(as_col(p_above_24) >= alert, "Alert Level 1+ (check for scum)")
        .when(as_col(p_above_12) >= alert, "Alert Level 1")
        .otherwise("Vigilance")
    )


def band_of_count(count) -> Column:
    return _first_bound(count, K.COLIFORM_BANDS, K.COLIFORM_WORST, inclusive=True)


def band_of_nowcast(p_above: dict) -> Column:
    """The cleanest band whose limit the count more likely than not stays within."""
    chain = None
    for limit, label in K.COLIFORM_BANDS:
        ok = (F.lit(1.0) - as_col(p_above[limit])) >= 0.5
        chain = F.when(ok, label) if chain is None else chain.when(ok, label)
    return chain.otherwise(K.COLIFORM_WORST)


def mask_out_of_range(name: str, value) -> Column:
    x = finite(value)
    return F.when(x.between(*K.VALID_RANGES[name.removeprefix("lab_")]), x)
