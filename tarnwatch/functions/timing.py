"""Calendar and lead-time features."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .working import as_col


def cyclic(hour) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * as_col(hour) / 24.0
    return F.sin(angle), F.cos(angle)


def is_weekend(ts) -> Column:
    return F.weekday(as_col(ts)) >= 5


def horizon_bucket(horizon, buckets) -> Column:
    h, chain = as_col(horizon), None
    for lo, hi in buckets:
        label = F.lit(f"{lo}-{hi}h")
        chain = F.when(h.between(lo, hi), label) if chain is None else chain.when(h.between(lo, hi), label)
    return chain.otherwise(F.lit(""))


def lead_group(days_ahead, groups) -> Column:
    d, chain = as_col(days_ahead), None
    for lo, hi in groups:
        label = F.lit(f"{lo}-{hi} days")
        chain = F.when(d.between(lo, hi), label) if chain is None else chain.when(d.between(lo, hi), label)
    return chain
