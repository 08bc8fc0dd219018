"""Required-column contracts, checked by name on the plan's schema: no job runs."""

from pyspark.sql import DataFrame


class MissingColumns(ValueError):
    """A table lacks columns an operator needs."""


def require_columns(df: DataFrame, columns, what: str = "table") -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise MissingColumns(f"{what} is missing columns {missing}; it has {df.columns}")
    return df
