"""Cases that used to be dropped, capped or ranked in one task."""

from pyspark.sql import functions as F

from tarnwatch.models import forest
from tarnwatch.operators import calibration, chunks, order_stats


def test_close_values_are_cut_until_few_are_ranked(spark, monkeypatch):
    monkeypatch.setattr(order_stats, "RANKED", 50)
    times = spark.range(4000).select((F.lit(1.7e15) + F.col("id") * 600e6).alias("x"))
    near = spark.range(4000).select((F.lit(25.0) + F.col("id") / 4e9).alias("x"))
    for df in (times, near, spark.range(500).select(F.lit(3.0).alias("x"))):
        exact = df.selectExpr("percentile(x, array(0.1, 0.5, 0.9)) p").first()["p"]
        found = order_stats.quantiles(df, [], "x", {"a": 0.1, "b": 0.5, "c": 0.9}).first()
        assert [found[c] for c in "abc"] == exact


def test_rows_without_threshold_stay(spark):
    asked = spark.createDataFrame([(1, 0.5), (2, None), (3, 9.0)], "id int, t double")
    residuals = spark.createDataFrame([(0.0,), (1.0,)], "residual double")
    out = {r["id"]: r["p"] for r in calibration.share_above(asked, "t", residuals).collect()}
    assert out == {1: 0.5, 2: None, 3: 0.0}


def test_rows_without_key_keep_a_number(spark):
    df = spark.createDataFrame([("a", 1), (None, 1), (None, 2)], "station_id string, hour long")
    out = sorted((r["station_id"] or "", r["_row"]) for r in chunks.row_index(df, ["station_id"], "hour", 24).collect())
    assert out == [("", 1), ("", 2), ("a", 1)]


def test_forest_samples_do_not_change_shape_with_size(spark):
    for n in (200, 20_000):
        df = spark.range(n).select(F.col("id").alias("k"), F.rand(1).alias("x"))
        sizes = forest.tree_samples(df, ["x"], ["k"], trees=5, size=64, seed=3).groupBy("tree").count().collect()
        assert len(sizes) == 5 and all(r["count"] == 64 for r in sizes)
