"""WQI class from sensor readings: candidates compared by macro F1 on station-week folds, never on the test period."""

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import micros
from tarnwatch.functions.water import class_rank
from tarnwatch.operators.lineage import materialise
from tarnwatch.operators.order_stats import quantiles
from tarnwatch.operators.scoring import macro_f1
from tarnwatch.operators.splits import balanced_weights

from .regression import out_of_fold


def with_week_folds(df: DataFrame, folds: int = 5) -> DataFrame:
    """Readings of one station and week share a fold, so near-duplicates cannot leak across."""
    week = F.date_format(F.date_trunc("week", F.col("timestamp")), "yyyy-MM-dd")
    number = F.conv(F.substring(F.md5(F.concat_ws("|", "station_id", week)), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("fold", (number % folds).cast("int"))


def time_split(df: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Train on the earlier rows, test on those after the exact time quantile."""
    stamped = df.withColumn("_us", micros(F.col("timestamp")))
    cut = materialise(quantiles(stamped, [], "_us", {"cut": 1 - test_size}).select("cut"), "cut").scalar()
    late = F.col("_us") > cut
    return stamped.filter(~late).drop("_us"), stamped.filter(late).drop("_us")


class Majority:
    """Always the commonest class."""

    def fit(self, df: DataFrame) -> "Majority":
        counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        self.label = counts.orderBy(F.desc("n"), "label").first()["label"]
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        n = len(K.WQI_CLASSES)
        sure = F.array(*[F.lit(1.0 if i == int(self.label) else 0.0) for i in range(n)])
        return df.withColumns({"prediction": F.lit(float(self.label)), "probability": sure})


def candidates(features, trees: int = 60, depth: int = 8, seed: int = 42) -> dict:
    """Estimators by name. Balanced weights everywhere: polluted readings are rare and missing them is the costly error.

    MLlib's boosted classifier is binary only, so the boosted candidate of the reference design is left out.
    """
    filled = [f"_f_{c}" for c in features]
    prepare = [
        Imputer(strategy="median", relativeError=0.0001, inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol="_raw"),
    ]
    scaled = [*prepare, StandardScaler(inputCol="_raw", outputCol="_x", withMean=True)]
    out = {"majority_baseline": Majority()}
    for c in (0.1, 1.0):
        out[f"logistic_regression_{c:g}"] = Pipeline(
            stages=[*scaled, LogisticRegression(featuresCol="_x", weightCol="weight", family="multinomial", regParam=0.01 / c, maxIter=50)]
        )
    out["random_forest"] = Pipeline(
        stages=[*prepare, RandomForestClassifier(featuresCol="_raw", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)]
    )
    return out


def labelled(df: DataFrame) -> DataFrame:
    """Class as its rank (0 is the cleanest) and the balanced weight of its class."""
    weights = balanced_weights(df, "wqi_class")
    return df.join(weights, "wqi_class").withColumn("label", class_rank("wqi_class").cast("double"))


def _predicted(model, df: DataFrame) -> DataFrame:
    out = model.transform(df)
    names = F.array(*[F.lit(c) for c in K.WQI_CLASSES])
    chances = F.col("probability") if dict(out.dtypes)["probability"].startswith("array") else vector_to_array("probability")
    return out.select(
        *df.columns, F.get(names, F.col("prediction").cast("int")).alias("predicted_class"),
        *[F.coalesce(F.get(chances, i), F.lit(0.0)).alias(f"p_{c}") for i, c in enumerate(K.WQI_CLASSES)],
    )


class WqiClassifier:
    def __init__(self, features=K.LAKE_SENSORS, folds: int = 3, trees: int = 60, depth: int = 8, seed: int = 42):
        self.features, self.folds, self.trees, self.depth, self.seed = list(features), folds, trees, depth, seed

    def fit(self, train: DataFrame) -> "WqiClassifier":
        """Choose a candidate by cross-validated macro F1 and refit it on all of `train`."""
        rows = materialise(with_week_folds(labelled(train), self.folds), "wqi_training")
        scores = []
        for name, estimator in candidates(self.features, self.trees, self.depth, self.seed).items():
            held = out_of_fold(rows, estimator.fit, _predicted, self.folds)
            scores.append(macro_f1(held, "wqi_class", "predicted_class").select(F.lit(name).alias("model"), "macro_f1"))
        self.leaderboard = materialise(reduce(DataFrame.unionByName, scores), "leaderboard")
        # One row per candidate.
        self.best = self.leaderboard.orderBy(F.desc("macro_f1"), "model").first()["model"]
        self.model = candidates(self.features, self.trees, self.depth, self.seed)[self.best].fit(rows)
        return self

    def classify(self, df: DataFrame) -> DataFrame:
        """Adds predicted_class and the chance of each class."""
        return _predicted(self.model, df)
