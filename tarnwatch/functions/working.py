"""Small numeric column helpers shared by every operator: null-safe clipping, working scale, rounding."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x) -> Column:
    """NaN and the infinities become NULL, the only missing value inside this library."""
    x = as_col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def at_least(x, low) -> Column:
    """max(x, low) that stays NULL when x is NULL (`greatest` alone would return `low`)."""
    x = as_col(x)
    return F.when(x.isNotNull(), F.greatest(x, F.lit(low)))


def at_most(x, high) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(x, F.lit(high)))


def clip(x, low, high) -> Column:
    x = as_col(x)
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def to_working(x, sensor: str) -> Column:
    """Turbidity is modelled as log1p of its non-negative value; every other sensor as it is."""
    x = as_col(x)
    return F.log1p(at_least(x, 0.0)) if sensor == "turbidity" else x


def from_working(x, sensor: str) -> Column:
    x = as_col(x)
    return F.expm1(x) if sensor == "turbidity" else x


def ratio(a, b) -> Column:
    """a / b, NULL where b is 0 (no ANSI error)."""
    return F.try_divide(as_col(a), as_col(b))


def r9(x) -> Column:
    """Rounded to 9 decimals, with negative zero folded into zero."""
    return F.round(as_col(x), 9) + F.lit(0.0)


def in_range(x, bounds) -> Column:
    return as_col(x).between(*bounds)


def all_present(cols) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & as_col(c).isNotNull()
    return cond


def count_true(conditions) -> Column:
    """How many of the conditions hold; NULL counts as false."""
    total = F.lit(0)
    for c in conditions:
        total = total + F.when(c, 1).otherwise(0)
    return total
