"""Rows of the last N days or hours of a table."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recent(df: DataFrame, stamp: str, days: int = 0, hours: int = 0) -> DataFrame:
    """Rows later than the latest `stamp` minus the span; the bound is a scalar subquery, the rest a plain scan."""
    bound = df.select((F.max(stamp) - F.make_dt_interval(F.lit(days), F.lit(hours))).alias("since"))
    return df.filter(F.col(stamp) > bound.scalar())
