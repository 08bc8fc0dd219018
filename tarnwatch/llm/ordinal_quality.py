"""Ordinal quality classifier: cumulative-link regression with shared hashed-text weights and ordered thresholds.

Ratings are grades 0 < 1 < ... < K. One weight vector over hashed words is shared by all cuts, and cut k has its own
threshold: P(grade >= k) = logistic(w.x - theta_k). All cuts are fitted together as one logistic regression in which
every rated text appears once per cut, with the cut as one more input (the all-threshold form of the model): with
shared weights and nested answers the fitted thresholds come out in order, and are sorted before use in case of a tie.

Inputs are the distinct lower-cased words of a text and the cut's own sign, hashed to `FEATURES` cells.

The fit uses about `SAMPLE` rated texts at most, chosen by a hash of doc_id (a documented bound; whole texts); every
document is scored. The model is a weight vector and K thresholds: its size does not depend on the data.

Defined results: NULL and empty texts score as texts without words; a rating with a NULL part is no rating; rows
without a rating are only scored; repeated ratings count as often as they occur; repeated rows score alike; with no
ratings, or ratings of one grade only, each probability is the share of ratings at or above the grade (0 without any).
"""

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import load, materialise, words_column
from .registry import register

FEATURES = 1 << 18
SAMPLE = 20_000
SELECT = 0.5  # least probability of the grade asked for


@dataclass
class OrdinalModel:
    """Weights and thresholds: P(grade >= k) = logistic(margin + offsets[k-1]); without a fit only the shares."""

    top: int
    weights: LogisticRegressionModel | None
    offsets: list[float]  # of each cut against the first, falling
    shares: list[float]


def _sign(cut) -> Column:
    """The input that stands for a cut: no word, for it holds a blank."""
    return F.concat(F.lit("at least "), cut.cast("string"))


def _hashing() -> HashingTF:
    return HashingTF(inputCol="__w", outputCol="__x", numFeatures=FEATURES, binary=True)


def _inputs(docs: DataFrame, cut) -> DataFrame:
    words = F.concat(F.array_distinct(words_column(F.col("text"), lower=True)), F.array(_sign(cut)))
    return _hashing().transform(docs.withColumn("__w", words)).drop("__w")


def fit(docs: DataFrame, ratings: DataFrame, top: int, sample: int = SAMPLE) -> OrdinalModel:
    """`ratings` has doc_id and grade (0 to `top`); `docs` has doc_id and text."""
    rated = ratings.filter("grade is not null and doc_id is not null").select("doc_id", F.col("grade").cast("int").alias("grade"))
    n = rated.count()
    # Kept by a hash of the id, so that about `sample` remain; the fitted texts do not depend on row order.
    space = 1 << 30
    if n > sample:
        rated = rated.filter(F.pmod(F.xxhash64("doc_id"), F.lit(space)) < int(space * sample / n))
    rated = materialise(rated, "ratings")
    shares = [r or 0.0 for r in rated.agg(*[F.avg((F.col("grade") >= k).cast("double")) for k in range(1, top + 1)]).first()]
    if n == 0 or rated.select("grade").distinct().count() < 2:
        return OrdinalModel(top, None, [], shares)
    texts = docs.select("doc_id", "text").join(rated, "doc_id").withColumn("__k", F.explode(F.sequence(F.lit(1), F.lit(top))))
    rows = materialise(_inputs(texts, F.col("__k")).select("__x", (F.col("grade") >= F.col("__k")).cast("double").alias("__y")), "cut_rows")
    model = LogisticRegression(featuresCol="__x", labelCol="__y", fitIntercept=False, standardization=False, regParam=1e-3, maxIter=60).fit(rows)
    cells = [_hashing().indexOf(f"at least {k}") for k in range(1, top + 1)]
    thetas = [float(model.coefficients[c]) for c in cells]
    return OrdinalModel(top, model, [t - thetas[0] for t in sorted(thetas, reverse=True)], shares)


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """All rows and columns of `docs` with `p_at_least_1..K` and `expected_grade`."""
    names = [f"p_at_least_{k}" for k in range(1, model.top + 1)]
    keep = [c for c in docs.columns if c not in (*names, "expected_grade")]
    if model.weights is None:
        out = docs.select(*keep, *[F.lit(s).alias(n) for n, s in zip(names, model.shares)])
    else:
        x = model.weights.transform(_inputs(docs.select(*keep), F.lit(1))).withColumn("__m", F.element_at(vector_to_array("rawPrediction"), 2))
        out = x.select(*keep, *[(1 / (1 + F.exp(-(F.col("__m") + F.lit(o))))).alias(n) for n, o in zip(names, model.offsets)])
    return out.withColumn("expected_grade", sum((F.col(n) for n in names), F.lit(0.0)))


def graded(labels: DataFrame) -> DataFrame:
    """Grades of the labels table: 0 toxic, 1 of low quality, 2 good."""
    return labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & F.col("quality").isNotNull(), 1 + F.col("quality")).alias("grade"))


@register("op1_ordinal_quality")
def op1_ordinal_quality(spark, sf_dir):
    """Expected grade and tail probabilities of every document; `selected` holds back those that are probably toxic."""
    docs = load(spark, sf_dir, "documents")
    model = fit(docs, graded(load(spark, sf_dir, "labels")), top=2)
    out = score(docs, model)
    return out.select("doc_id", "expected_grade", "p_at_least_1", "p_at_least_2", (F.col("p_at_least_1") >= SELECT).alias("selected"))
