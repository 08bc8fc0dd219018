"""Air columns: mass units, humidity growth, sub-indices, index categories."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch import constants as K

from .working import as_col, at_least, clip, count_true


def ppm_to_mass(ppm, gas: str) -> Column:
    """ug/m3 (mg/m3 for CO) at 25 C and 1 atm."""
    per_ppm = K.MOLECULAR_WEIGHT[gas] * 1000 / K.MOLAR_VOLUME
    return as_col(ppm) * (per_ppm / 1000 if gas == "co" else per_ppm)


def humidity_growth(rh, kappa: float = K.KAPPA) -> Column:
    """How far an optical counter over-reads in humid air: 1 in dry air, capped at 95% humidity."""
    water = clip(rh, 0.0, 95.0) / 100.0
    grown = F.lit(1.0) + F.lit(kappa / 1.65) / (F.lit(1.0) / F.when(water > 0, water) - 1.0)
    return F.when(water == 0, F.lit(1.0)).otherwise(grown)


def detection_floor(x, gas: str) -> Column:
    """Clean-air noise clips to zero; far below zero is no reading at all."""
    x = as_col(x)
    return F.when(x >= -3 * K.DETECTION_LIMIT[gas], at_least(x, 0.0))


def too_negative(x, gas: str) -> Column:
    return F.coalesce(as_col(x) < -3 * K.DETECTION_LIMIT[gas], F.lit(False))


def sub_index(concentration, pollutant: str) -> Column:
    """Straight line inside the breakpoint band the concentration falls in; 500 beyond the last."""
    c = at_least(concentration, 0.0)
    points = K.BREAKPOINTS[pollutant]
    chain = F.when(c.isNull(), F.lit(None).cast("double"))
    for (x0, x1), (y0, y1) in zip(zip(points, points[1:]), zip(K.INDEX_EDGES, K.INDEX_EDGES[1:])):
        chain = chain.when(c < x1, F.lit(float(y0)) + (c - float(x0)) * float((y1 - y0) / (x1 - x0)))
    return chain.otherwise(F.lit(500.0))


def aqi_category(index) -> Column:
    """Category of the whole-number index. The index is written once, so callers may pass a large expression."""
    whole = F.bround(as_col(index), 0)
    bounds = F.array(*[F.lit(float(upper)) for upper, _, _ in K.AQI_CATEGORIES[:-1]])
    names = F.array(*[F.lit(label) for _, label, _ in K.AQI_CATEGORIES])
    passed = F.when(whole.isNotNull(), F.size(F.filter(bounds, lambda b: b < whole)))
    return F.coalesce(F.get(names, passed), F.lit("insufficient data"))


def aqi_advice(category) -> Column:
    pairs = [F.lit(x) for _, label, text in K.AQI_CATEGORIES for x in (label, text)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), as_col(category)), F.lit(""))


def sub_indices(pollutants) -> Column:
    """The pollutants' sub-indices as one array, in breakpoint order."""
    return F.array(*[sub_index(p, p) for p in K.BREAKPOINTS if p in pollutants])


def enough_pollutants(pollutants) -> Column:
    """At least three known pollutants, one of them particulate."""
    known = [F.col(p).isNotNull() for p in K.BREAKPOINTS if p in pollutants]
    particle = [F.col(p).isNotNull() for p in ("pm25", "pm10") if p in pollutants]
    return (count_true(known) >= K.MIN_POLLUTANTS) & (count_true(particle) >= 1)


def prominent(subs, pollutants) -> Column:
    """The pollutant that sets the index; the first in breakpoint order wins a tie."""
    names = F.array(*[F.lit(p) for p in K.BREAKPOINTS if p in pollutants])
    return F.get(names, (F.array_position(subs, F.array_max(subs)) - 1).cast("int"))
