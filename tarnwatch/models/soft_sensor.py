"""Soft sensors of lab-measured values: candidates on the log scale, ranges and odds from out-of-fold residuals."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.feature import PCA, Imputer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import micros
from tarnwatch.operators import calibration, scoring
from tarnwatch.operators.lineage import materialise
from tarnwatch.operators.order_stats import quantiles

from .regression import out_of_fold


def with_time_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Contiguous folds over time, so validation never interleaves with training weeks."""
    stamped = df.withColumn("_us", micros(F.col("timestamp")).cast("double"))
    cuts = materialise(quantiles(stamped, [], "_us", {f"c{i}": i / folds for i in range(1, folds)}), "cuts")
    fold = F.lit(0)
    for i in range(1, folds):
        fold = fold + F.when(F.col("_us") >= cuts.select(f"c{i}").scalar(), 1).otherwise(0)
    return stamped.withColumn("fold", fold).drop("_us")


class Mean:
    """The mean of the logs, whatever the inputs."""

    def fit(self, df: DataFrame) -> "Mean":
        self.value = df.agg(F.avg("_log")).first()[0]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", F.lit(self.value))


def candidates(features, seed: int = 42, trees: int = 40) -> dict:
    """Estimators of `_log`. PCA regression stands in for partial least squares, and MLlib's trees know no
    monotone constraint; both differences are part of the design."""
    filled = [f"_f_{c}" for c in features]
    prepare = [
        Imputer(strategy="median", relativeError=0.0001, inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
        StandardScaler(inputCol="_raw", outputCol="_x", withMean=True),
    ]
    parts = max(1, min(5, len(features) - 1))
    return {
        "mean_baseline": Mean(),
        "ridge": Pipeline(stages=[*prepare, LinearRegression(featuresCol="_x", labelCol="_log", regParam=0.1, elasticNetParam=0.0)]),
        "components": Pipeline(
            stages=[*prepare, PCA(k=parts, inputCol="_x", outputCol="_c"), LinearRegression(featuresCol="_c", labelCol="_log")]
        ),
        "boosted_trees": Pipeline(
            stages=[*prepare[:2], GBTRegressor(featuresCol="_raw", labelCol="_log", maxIter=trees, maxDepth=3, stepSize=0.1, seed=seed)]
        ),
    }


def _log_prediction(model, df: DataFrame) -> DataFrame:
    return model.transform(df).select(*df.columns, F.col("prediction").alias("log_pred"))


class SoftSensor:
    """A fitted candidate and its out-of-fold residuals, which turn the log estimate into ranges and odds."""

    def __init__(self, target: str, features, folds: int = 5, trees: int = 40, seed: int = 42):
        self.target, self.features, self.folds, self.trees, self.seed = target, list(features), folds, trees, seed

    def _rows(self, df: DataFrame) -> DataFrame:
        # An input that is missing everywhere cannot be imputed.
        present = df.agg(*[F.count(c).alias(c) for c in self.features]).first().asDict()
        self.used = [c for c in self.features if present[c]]
        out = with_time_folds(df.withColumn("_log", F.ln(self.target)), self.folds)
        return materialise(out, "soft_sensor")

    def fit(self, df: DataFrame, name: str | None = None) -> "SoftSensor":
        """Choose by cross-validated error of the log (or take `name`), keep its residuals, refit on everything."""
        rows = self._rows(df)
        estimators = candidates(self.used, self.seed, self.trees)
        held = {
            n: out_of_fold(rows, e.fit, _log_prediction, self.folds).withColumn("residual", F.col("_log") - F.col("log_pred"))
            for n, e in estimators.items()
            if name in (None, n)
        }
        scores = [h.select(F.lit(n).alias("model"), "residual") for n, h in held.items()]
        board = reduce(DataFrame.unionByName, scores)
        board = board.groupBy("model").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("cv_rmse_log"))
        self.leaderboard = materialise(board, "leaderboard")
        self.name = self.leaderboard.orderBy("cv_rmse_log", "model").first()["model"]
        self.residuals = materialise(held[self.name].select("residual"), "residuals")
        self.range = materialise(calibration.residual_range(self.residuals), "residual_range")
        self.model = estimators[self.name].fit(rows)
        return self

    def predict_log(self, df: DataFrame) -> DataFrame:
        return _log_prediction(self.model, df)

    def estimate(self, df: DataFrame, levels=None) -> DataFrame:
        """Adds the estimate, its range, and `p_above_<level>` per limit."""
        levels = K.EXCEEDANCE_LEVELS[self.target] if levels is None else levels
        out = self.predict_log(df)
        for name, shift in ((self.target + "_est", "r_mid"), (self.target + "_lo", "r_lo"), (self.target + "_hi", "r_hi")):
            out = out.withColumn(name, F.exp(F.col("log_pred") + self.range.select(shift).scalar()))
        for level in levels:
            out = out.withColumn("_t", F.ln(F.lit(float(level))) - F.col("log_pred"))
            out = calibration.share_above(out, "_t", self.residuals, name=f"p_above_{level:g}").drop("_t")
        return out.drop("log_pred")


def unseen_station_scores(df: DataFrame, target: str, features, name: str, folds: int | None = None, trees: int = 20) -> DataFrame:
    """Accuracy per station of a model trained on other stations only.

    Each station is left out in turn; with `folds` stations are dealt to that many folds in order of their names. Rows
    without a station are one station of their own.
    """
    # One row per station.
    numbered = df.select("station_id").distinct().withColumn("fold", F.row_number().over(Window.orderBy("station_id")) - 1)
    numbered = materialise(numbered, "stations")
    n = min(numbered.count(), folds or numbered.count())
    numbered = numbered.select(F.col("station_id").alias("_st"), (F.col("fold") % n).alias("fold"))
    rows = df.join(numbered, F.col("station_id").eqNullSafe(F.col("_st"))).drop("_st").withColumn("_log", F.ln(target))
    rows = materialise(rows, "unseen")
    estimator = candidates(features, trees=trees)[name]
    held = out_of_fold(rows, estimator.fit, _log_prediction, n).withColumn("estimate", F.exp("log_pred"))
    held = held.withColumn("_unnamed", F.col("station_id").isNull()).fillna("", ["station_id"])
    out = scoring.accuracy(held, ["station_id", "_unnamed"], target, "estimate")
    return out.withColumn("station_id", F.when(~F.col("_unnamed"), F.col("station_id"))).drop("_unnamed")
