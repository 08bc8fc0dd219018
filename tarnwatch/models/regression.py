"""Regression building blocks: station effects, trend plus boosted trees, out-of-fold prediction, quantile trees.

A station enters a model as its effect: the mean of what the model misses there, shrunken towards none. That is one number in
a table joined by station, so any number of stations are told apart, and one never seen has no effect.
"""

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.odds import uncrossed
from tarnwatch.operators.lineage import materialise
from tarnwatch.operators.order_stats import quantiles

MISSING = -999.0
EFFECT = "_effect"
SHRINK = 20.0  # rows without any deviation that every station is given
PARTS = 5  # parts of a station's rows; a training row's effect comes from the other parts
SPREAD_DEPTH, SPREAD_ROWS = 3, 200  # of the tree that tells where residuals are wide; rows in one of its leaves


def station_effects(rows: DataFrame, missed: Column, inputs) -> tuple[DataFrame, DataFrame]:
    """The rows with `_effect`, and the table (station_id, _effect) to predict with.

    `missed` is what a model leaves over. A row's effect is fitted on the other parts of its station's rows (by a hash of the
    inputs), so that what is fitted on it does not see its own target in it; the table's effect is that of all rows.
    """
    part = F.pmod(F.xxhash64(*inputs), F.lit(PARTS)).cast("int")
    rows = materialise(rows.withColumns({"_missed": missed, "_part": part}), "missed")
    sums = materialise(rows.groupBy("station_id", "_part").agg(F.sum("_missed").alias("_s"), F.count("_missed").alias("_n")), "station_sums")
    whole = sums.groupBy("station_id").agg(F.sum("_s").alias("_sum_all"), F.sum("_n").alias("_n_all"))
    table = materialise(whole.select("station_id", (F.col("_sum_all") / (F.col("_n_all") + SHRINK)).alias(EFFECT)), "station_effects")
    others = (F.col("_sum_all") - F.col("_s")) / (F.col("_n_all") - F.col("_n") + SHRINK)
    each = sums.join(whole, "station_id").select(F.col("station_id").alias("_st"), F.col("_part").alias("_p"), others.alias(EFFECT))
    out = rows.join(each, (F.col("station_id") == F.col("_st")) & (F.col("_part") == F.col("_p")), "left").drop("_st", "_p", "_part", "_missed")
    return out.fillna(0.0, [EFFECT]), table


def with_effect(df: DataFrame, table: DataFrame) -> DataFrame:
    """Adds the station's effect; none for a station never seen or not named."""
    own = table.select(F.col("station_id").alias("_st"), EFFECT)
    return df.join(own, F.col("station_id") == F.col("_st"), "left").drop("_st").fillna(0.0, [EFFECT])


def training_table(df: DataFrame, columns, name: str = "training") -> DataFrame:
    """The rows a fit reads many times, written once with only the columns it needs."""
    return materialise(df.select(*columns), name)


@dataclass
class StationModel:
    """A fitted `TrendPlusTrees`: what the inputs say, the station's effect, and what trees add to both."""

    trend: PipelineModel
    effects: DataFrame
    trees: PipelineModel


class TrendPlusTrees:
    """A ridge regression carries broad relations into unseen seasons; boosted trees add curvature to what it leaves."""

    def __init__(self, inputs, target: str, trees: int = 40, depth: int = 5, ridge: float = 1.0, seed: int = 42):
        self.inputs, self.target = list(inputs), target
        self.trees, self.depth, self.ridge, self.seed = trees, depth, ridge, seed

    def fit(self, df: DataFrame) -> StationModel:
        rows = df.dropna(subset=[*self.inputs, self.target])
        rows = materialise(rows.select("station_id", *self.inputs, self.target), "fit")
        n = max(rows.count(), 1)
        trend = Pipeline(
            stages=[
                VectorAssembler(inputCols=self.inputs, outputCol="_num", handleInvalid="keep"),
                StandardScaler(inputCol="_num", outputCol="_std", withMean=True),
                # Spark's penalty is per row; ridge is the total one.
                LinearRegression(featuresCol="_std", labelCol=self.target, predictionCol="_trend", regParam=self.ridge / n,
                                 elasticNetParam=0.0, standardization=False, solver="l-bfgs"),
            ]
        ).fit(rows)
        rest = trend.transform(rows).drop("_num", "_std")
        rest, effects = station_effects(rest, F.col(self.target) - F.col("_trend"), [*self.inputs, self.target])
        rest = rest.select(*self.inputs, EFFECT, (F.col(self.target) - F.col("_trend") - F.col(EFFECT)).alias("_rest"))
        trees = Pipeline(
            stages=[
                VectorAssembler(inputCols=[*self.inputs, EFFECT], outputCol="_tree_inputs", handleInvalid="keep"),
                GBTRegressor(featuresCol="_tree_inputs", labelCol="_rest", predictionCol="_bump", maxIter=self.trees,
                             maxDepth=self.depth, stepSize=0.1, seed=self.seed),
            ]
        ).fit(materialise(rest, "rest"))
        return StationModel(trend, effects, trees)


def predict(model: StationModel, df: DataFrame, name: str, inputs=None) -> DataFrame:
    """Adds the model's prediction, NULL where one of `inputs` is missing."""
    kept = df.columns
    out = model.trees.transform(with_effect(model.trend.transform(df), model.effects))
    value = F.col("_trend") + F.col(EFFECT) + F.col("_bump")
    if inputs is not None:
        known = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in inputs])
        value = F.when(known, value)
    return out.select(*kept, value.alias(name))


def out_of_fold(df: DataFrame, fit: Callable, apply: Callable, folds: int, fold: str = "fold") -> DataFrame:
    """Every row predicted by a model that never saw its fold; `df` should be a written table."""
    parts = []
    for k in range(folds):
        model = fit(df.filter(F.col(fold) != k))
        parts.append(apply(model, df.filter(F.col(fold) == k)))
    return reduce(DataFrame.unionByName, parts)


class QuantileTrees:
    """One boosted median per target, with the lower and upper quantile of its residuals where the row's conditions put it.

    MLlib has no quantile loss, so the trees minimise absolute error (the median). A small tree fitted to the size of the
    residuals then parts the conditions by how wide they are; the exact quantiles of the residuals in each of its leaves (and
    of `groups`, for instance the horizon bucket) are the spread there. A leaf with few rows takes its group's
    spread. Conformal offsets correct the rest.
    """

    def __init__(self, features, targets: dict, groups=(), trees: int = 40, depth: int = 5, seed: int = 42):
        self.features, self.targets, self.groups = list(features), dict(targets), list(groups)
        self.trees, self.depth, self.seed = trees, depth, seed

    def fit(self, rows: DataFrame) -> "QuantileTrees":
        used = [*self.features, *self.targets.values(), *self.groups, "station_id"]
        table = training_table(rows, dict.fromkeys(used))
        self.models, self.effects, self.widths, residuals = {}, {}, {}, []
        for name, target in self.targets.items():
            known = table.filter(F.col(target).isNotNull())
            mean = known.select(F.avg(target)).scalar()
            known, self.effects[name] = station_effects(known, F.col(target) - mean, [*self.features, target])
            known = materialise(self._vector(known), "vectors")
            model = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="_p", maxIter=self.trees, maxDepth=self.depth,
                                 stepSize=0.1, lossType="absolute", seed=self.seed).fit(known)
            off = model.transform(known).withColumn("_r", F.col(target) - F.col("_p")).withColumn("_abs", F.abs("_r"))
            off = materialise(off.select(*self.groups, "_x", "_r", "_abs"), "residuals")
            width = DecisionTreeRegressor(featuresCol="_x", labelCol="_abs", predictionCol="_width", maxDepth=SPREAD_DEPTH,
                                          minInstancesPerNode=SPREAD_ROWS, seed=self.seed).fit(off).setLeafCol("_leaf")
            self.models[name], self.widths[name] = model, width
            residuals.append(width.transform(off).select(*self.groups, F.lit(name).alias("sensor"), "_leaf", "_r"))
        spread = materialise(reduce(DataFrame.unionByName, residuals), "leaf_residuals")
        probs, keys = {"q_lo": 0.1, "q_hi": 0.9}, ["sensor", *self.groups]
        self.spread = materialise(quantiles(spread, keys, "_r", probs).drop("n"), "spread")
        leaves = quantiles(spread, [*keys, "_leaf"], "_r", probs).filter(F.col("n") >= SPREAD_ROWS)
        self.leaves = materialise(leaves.select(*keys, "_leaf", F.col("q_lo").alias("_leaf_lo"), F.col("q_hi").alias("_leaf_hi")), "leaf_spread")
        return self

    def _vector(self, rows: DataFrame) -> DataFrame:
        # Trees read a value far outside the data as "missing" and can split on it.
        filled = rows.fillna(MISSING, self.features)
        return VectorAssembler(inputCols=[*self.features, EFFECT], outputCol="_x").transform(filled)

    def predict(self, rows: DataFrame, keep) -> DataFrame:
        """Long table: `keep` columns, sensor, and lo <= mid <= hi of each target's change."""
        parts = []
        for name, model in self.models.items():
            out = self.widths[name].transform(model.transform(self._vector(with_effect(rows, self.effects[name]))))
            parts.append(out.select(*keep, *[g for g in self.groups if g not in keep], F.lit(name).alias("sensor"), F.col("_p").alias("mid"), "_leaf"))
        keys = ["sensor", *self.groups]
        table = reduce(DataFrame.unionByName, parts).join(self.spread, keys, "left").join(self.leaves, [*keys, "_leaf"], "left")
        low, high = (F.coalesce(f"_leaf_{side}", f"q_{side}", F.lit(0.0)) for side in ("lo", "hi"))
        table = table.withColumn("_q", uncrossed(F.col("mid") + low, F.col("mid"), F.col("mid") + high))
        table = table.withColumns({"lo": F.get("_q", 0), "mid": F.get("_q", 1), "hi": F.get("_q", 2)})
        return table.drop("_q", "q_lo", "q_hi", "_leaf", "_leaf_lo", "_leaf_hi")
