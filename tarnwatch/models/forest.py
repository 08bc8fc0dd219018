"""Isolation forest: trees grown from 256-row samples in parallel, scored with Arrow batches.

A tree sees only its sample, so growing is one small group per tree; the finished forest has at most 511 nodes per
tree, a fixed size, and is broadcast to the scoring tasks.
"""

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K

EULER = 0.5772156649015329
TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>"


def average_path(n) -> float:
    """Expected depth of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2.0 * (math.log(n - 1) + EULER) - 2.0 * (n - 1) / n


def tree_samples(df: DataFrame, features, keys, trees: int, size: int, seed: int) -> DataFrame:
    """(tree, x): `size` rows per tree drawn by hash of the row's keys, without a global sort."""
    n = max(df.count(), 1)
    rows = df.select(F.array(*features).alias("x"), *keys)

    def unit(*salt):
        return F.pmod(F.xxhash64(*[F.lit(s) if isinstance(s, int) else s for s in salt], *keys), F.lit(1 << 53)) / float(1 << 53)

    # Every row draws the trees it serves by hash, with about twice the rows a tree needs; only drawn rows move.
    share = min(1.0, size * 2.0 / n)
    mine = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: unit(seed, t) < share)
    drawn = rows.withColumn("tree", F.explode(mine)).withColumn("_o", unit(seed, F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_o"))
    return drawn.withColumn("_rank", rank).filter(F.col("_rank") <= size).select("tree", "x")


def _grow(x: np.ndarray, rng, limit: int):
    feature, threshold, left, right, path = [], [], [], [], []

    def node(rows, depth):
        here = len(feature)
        for column in (feature, left, right):
            column.append(-1)
        threshold.append(0.0)
        path.append(depth + average_path(len(rows)))
        low, high = rows.min(axis=0), rows.max(axis=0)
        varying = np.flatnonzero(high > low)
        if depth < limit and len(rows) > 1 and len(varying):
            f = int(rng.choice(varying))
            cut = float(rng.uniform(low[f], high[f]))
            side = rows[:, f] <= cut
            feature[here], threshold[here] = f, cut
            left[here] = node(rows[side], depth + 1)
            right[here] = node(rows[~side], depth + 1)
        return here

    node(x, 0)
    return feature, threshold, left, right, path


class IsolationForest:
    def __init__(self, features, trees: int = K.FOREST_TREES, size: int = K.FOREST_SAMPLE, seed: int = 42):
        self.features, self.trees, self.size, self.seed = list(features), trees, size, seed

    def fit(self, df: DataFrame, keys) -> "IsolationForest":
        seed, limit = self.seed, max(1, math.ceil(math.log2(self.size)))

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            tree = int(pdf["tree"].iloc[0])
            parts = _grow(np.stack(pdf["x"].to_numpy()), np.random.default_rng(seed + tree), limit)
            return pd.DataFrame([(tree, *parts)], columns=["tree", "feature", "threshold", "left", "right", "path"])

        samples = tree_samples(df, self.features, keys, self.trees, self.size, self.seed)
        grown = samples.groupBy("tree").applyInPandas(grow, TREE_SCHEMA)
        # A fixed number of fixed-size trees: the only thing that comes to the driver.
        self.forest = [
            tuple(np.asarray(r[c]) for c in ("feature", "threshold", "left", "right", "path")) for r in grown.orderBy("tree").collect()
        ]
        return self

    def score(self, df: DataFrame, name: str = "anomaly_score") -> DataFrame:
        """Adds the anomaly score in 0..1; higher is more unusual."""
        shared = df.sparkSession.sparkContext.broadcast(self.forest)
        scale = average_path(self.size)

        @F.pandas_udf("double")
        def isolation(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, 1))
            depth = np.zeros(len(rows))
            index = np.arange(len(rows))
            for feature, threshold, left, right, path in shared.value:
                at = np.zeros(len(rows), dtype=int)
                while True:
                    f = feature[at]
                    inner = f >= 0
                    if not inner.any():
                        break
                    down = rows[index, np.where(inner, f, 0)] <= threshold[at]
                    at = np.where(inner, np.where(down, left[at], right[at]), at)
                depth += path[at]
            return pd.Series(2.0 ** (-depth / max(len(shared.value), 1) / scale))

        return df.withColumn(name, isolation(F.array(*self.features)))
