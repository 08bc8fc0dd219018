"""Ranges and chances from predicted quantiles or from sorted residuals."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch import constants as K

from .working import as_col, clip


def prob_below(threshold, lo, mid, hi, levels=K.QUANTILES) -> Column:
    """P(value < threshold) on the straight lines through the three quantiles, extended outwards."""
    t, lo, mid, hi = (as_col(c) if not isinstance(c, (int, float)) else F.lit(float(c)) for c in (threshold, lo, mid, hi))
    below = levels[1] - (mid - t) * ((levels[1] - levels[0]) / _floored(mid - lo))
    above = levels[1] + (t - mid) * ((levels[2] - levels[1]) / _floored(hi - mid))
    return clip(F.when(t <= mid, below).otherwise(above), 0.0, 1.0)


def _floored(spread: Column) -> Column:
    return F.when(spread.isNotNull(), F.greatest(spread, F.lit(1e-9)))


def widen(lo, mid, hi, offset) -> dict[str, Column]:
    """Stretch (or shrink) a range by its calibration offset, keeping the median inside."""
    q = F.coalesce(as_col(offset), F.lit(0.0))
    lo, mid, hi = as_col(lo), as_col(mid), as_col(hi)
    return {
        "lo": F.when(lo.isNotNull() & mid.isNotNull(), F.least(lo - q, mid)),
        "mid": mid,
        "hi": F.when(hi.isNotNull() & mid.isNotNull(), F.greatest(hi + q, mid)),
    }


def uncrossed(*quantiles) -> Column:
    """The same quantiles in rising order."""
    return F.array_sort(F.array(*[as_col(q) for q in quantiles]))
