"""Permutation importance: how much a score worsens when one input is shuffled across rows."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.operators.chunks import row_index
from tarnwatch.operators.lineage import materialise

SPREAD = 1 << 20
CHUNK_OF_HASHES = 1 << 10


def permuted(df: DataFrame, column: str, keys, seed: int) -> DataFrame:
    """The table with one column dealt out to other rows at random.

    Rows are numbered twice in two hash orders and joined on the number. Numbering runs per hash range with prefix
    counts, so no task sees the whole table.
    """

    def numbered(frame, salt, name):
        clock = F.pmod(F.xxhash64(F.lit(salt), *keys), F.lit(SPREAD))
        out = frame.withColumns({"_all": F.lit(0), "_clock": clock})
        return row_index(out, ["_all"], "_clock", CHUNK_OF_HASHES, name).drop("_all", "_clock")

    here = numbered(df, seed, "_n")
    donor = numbered(df.select(*keys, F.col(column).alias("_dealt")), seed + 1, "_n").select("_n", "_dealt")
    return here.join(donor, "_n").withColumn(column, F.col("_dealt")).drop("_n", "_dealt")


def permutation_importance(df: DataFrame, columns, keys, score: Callable[[DataFrame], DataFrame], repeats: int = 3, seed: int = 42) -> DataFrame:
    """Per column the mean and spread of the drop in `score` (a one-row table with `score`; higher is better)."""
    df = materialise(df, "importance")
    base = score(df).select(F.col("score").alias("base"))
    parts = []
    for i, c in enumerate(columns):
        for r in range(repeats):
            shuffled = score(permuted(df, c, keys, seed + 1000 * i + 10 * r))
            parts.append(shuffled.select(F.lit(c).alias("feature"), "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("drop", base.scalar() - F.col("score"))
    return out.groupBy("feature").agg(F.avg("drop").alias("mean"), F.stddev_pop("drop").alias("std"))
