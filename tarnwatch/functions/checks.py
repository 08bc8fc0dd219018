"""Plausibility messages for a reading about to be classified."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwatch import constants as K

from .working import as_col


def reading_errors(names) -> Column:
    """Messages that block a prediction: missing, or outside the physical range."""
    out = []
    for n in names:
        low, high = K.VALID_RANGES[n]
        x = as_col(n)
        out.append(
            F.when(x.isNull(), f"{n} must be a number").when(
                ~x.between(low, high), f"{n} is outside the physical range {low:g}-{high:g}"
            )
        )
    return F.array_compact(F.array(*out))


def reading_warnings(seen: dict) -> Column:
    """Messages for values the model never saw in training (`seen` maps a name to its training range)."""
    out = []
    for n, (low, high) in seen.items():
        x = as_col(n)
        out.append(
            F.when(
                x.between(*K.VALID_RANGES[n]) & ~x.between(low, high),
                f"{n} is outside the training range {low:g}-{high:g}; trust this prediction less",
            )
        )
    return F.array_compact(F.array(*out))
