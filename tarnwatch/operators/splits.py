"""Time holdouts that never look ahead."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holdout_with_context(
    df: DataFrame, clock: str, holdout: int, context: int, windowed: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """The last `holdout` clock steps after `windowed`, fed by the `context` steps before the cut, which are dropped.

    Windows see what a live stream would have seen, and the scan reads only the holdout and its context.
    """
    cut = df.select((F.max(clock) - holdout).alias("cut"))
    with_context = df.filter(F.col(clock) > cut.select(F.col("cut") - context).scalar())
    return windowed(with_context).filter(F.col(clock) > cut.scalar())


def blocked_folds(df: DataFrame, clock: str, block: int, folds: int = 5, span_of: DataFrame | None = None) -> tuple[DataFrame, int]:
    """The rows with `fold`, whole stretches of `block` clock steps in turn, and the number of folds.

    There are no more folds than stretches with rows; fewer than two stretches are refused. `span_of` is a cheaper table
    with the same clock.
    """
    stretch = F.floor(F.col(clock) / block)
    first, n = (df if span_of is None else span_of).agg(F.min(stretch), F.count_distinct(stretch)).first()  # two numbers
    if n < 2:
        raise ValueError(f"blocked folds need at least two stretches of {block} steps of {clock}, there are {n}")
    folds = min(folds, n)
    return df.withColumn("fold", F.pmod(stretch - first, F.lit(folds)).cast("int")), folds


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """Per class, rows / (classes x rows of the class): every class weighs the same in training."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    total = counts.select((F.sum("_n") / F.count(F.lit(1))).alias("t")).scalar()
    return counts.select(label, (total / F.col("_n")).alias("weight"))
