"""Chunked windows, carries, scans and order statistics equal their whole-table meaning."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tarnwatch.operators import chunks, joins, order_stats, recursions, robust, runs
from tarnwatch.operators.calibration import share_above

RNG = np.random.default_rng(7)


@pytest.fixture(scope="module")
def grid(spark):
    rows = []
    for s, n in (("hot", 700), ("b", 60)):
        x = RNG.normal(0, 1, n).round(1)
        for i in range(n):
            rows.append((s, 10_000 + i, None if RNG.random() < 0.2 else float(x[i])))
    return spark.createDataFrame(rows, "station_id string, slot bigint, x double").cache()


@pytest.mark.parametrize("width", [5, 37, 100_000])
def test_frames_do_not_depend_on_the_chunk(spark, grid, width):
    def frame(w):
        return {"m": F.avg("x").over(w.rowsBetween(-9, 4)), "p": F.lag("x", 3).over(w), "n": F.lead("x").over(w)}

    whole = Window.partitionBy("station_id").orderBy("slot")
    want = grid.withColumns(frame(whole)).orderBy("station_id", "slot").toPandas()
    got = chunks.framed(grid, ["station_id"], "slot", [frame], before=9, after=4, width=width).orderBy("station_id", "slot").toPandas()
    pd.testing.assert_frame_equal(got[want.columns], want)


@pytest.mark.parametrize("width", [3, 50, 100_000])
def test_carried_values_cross_chunks(spark, grid, width):
    sparse = grid.withColumn("v", F.when(F.col("slot") % 41 == 0, F.col("slot")))
    whole = Window.partitionBy("station_id").orderBy("slot")
    want = sparse.withColumns({
        "last": F.last("v", ignorenulls=True).over(whole.rowsBetween(Window.unboundedPreceding, 0)),
        "next": F.first("v", ignorenulls=True).over(whole.rowsBetween(0, Window.unboundedFollowing)),
        "top": F.max("x").over(whole.rowsBetween(Window.unboundedPreceding, 0)),
    }).orderBy("station_id", "slot").toPandas()
    got = chunks.carry_last(sparse, ["station_id"], "slot", {"last": F.col("v")}, width)
    got = chunks.carry_next(got, ["station_id"], "slot", {"next": F.col("v")}, width)
    got = chunks.carry_last(got, ["station_id"], "slot", {"top": F.col("x")}, width, running_max=True)
    pd.testing.assert_frame_equal(got.orderBy("station_id", "slot").toPandas()[want.columns], want)


def test_row_numbers_across_chunks(spark, grid):
    out = chunks.row_index(grid.filter("slot % 3 <> 0"), ["station_id"], "slot", 10).orderBy("station_id", "slot").toPandas()
    for _, g in out.groupby("station_id"):
        assert list(g["_row"]) == list(range(1, len(g) + 1))


def test_trailing_median_equals_pandas(spark, grid, monkeypatch):
    monkeypatch.setattr(robust, "SLOT_CHUNK", 64)
    got = robust.trailing_medians(grid, ["x"], 50, 10).orderBy("station_id", "slot").toPandas()
    pdf = grid.orderBy("station_id", "slot").toPandas()
    want = pdf.groupby("station_id")["x"].transform(lambda v: v.rolling(50, min_periods=10).median())
    np.testing.assert_allclose(got["x_base"].to_numpy(), want.to_numpy())


def sequential(x, reset, weight, cap):
    level, out = 0.0, []
    for v, r in zip(x, reset):
        if r:
            level = 0.0
        elif not np.isnan(v):
            level = min(max(level + weight * (v - level), -cap), cap)
        out.append(level)
    return out


def test_reference_smoothing_example():
    x = np.full(12, 2.0)
    x[3] = np.nan
    reset = np.zeros(12, bool)
    reset[6] = True
    got = sequential(x, reset, 0.5, 1.8)
    assert got[:3] == pytest.approx([1.0, 1.5, 1.75]) and got[3] == got[2] and got[4] == 1.8 and got[6] == 0.0 and max(got) == 1.8


@pytest.mark.parametrize("width", [7, 64, 100_000])
def test_chunked_scan_equals_the_sequential_one(spark, grid, width):
    rows = grid.withColumn("reset", F.col("slot") % 53 == 0)
    scans = {
        "level": recursions.smoothing(F.col("x"), 0.3, F.col("reset"), F.lit(0.4)),
        "free": recursions.smoothing(F.col("x"), 0.3),
        "rain": recursions.decaying_sum(F.col("x"), 0.9),
    }
    got = recursions.clipped_scan(rows, ["station_id"], "slot", scans, width).orderBy("station_id", "slot").toPandas()
    for _, g in got.groupby("station_id"):
        x = g["x"].to_numpy(dtype=float)
        np.testing.assert_allclose(g["level"], sequential(x, g["reset"], 0.3, 0.4), atol=1e-12)
        np.testing.assert_allclose(g["free"], sequential(x, np.zeros(len(x), bool), 0.3, np.inf), atol=1e-12)
        rain, want = 0.0, []
        for v in np.nan_to_num(x):
            rain = 0.9 * rain + v
            want.append(rain)
        np.testing.assert_allclose(g["rain"], want, atol=1e-9)


def test_sustained_needs_a_full_run(spark):
    flags = [True, True, True, False, True, True]
    rows = [("a", i, f) for i, f in enumerate(flags)] + [("b", i, True) for i in range(2)]
    df = spark.createDataFrame(rows, "station_id string, slot bigint, flag boolean")
    out = runs.sustained(df, "flag", 3, "held").orderBy("station_id", "slot").collect()
    assert [r["held"] for r in out] == [False, False, True, False, False, False, False, False]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=40), st.floats(0, 1))
def test_exact_quantiles_equal_numpy(spark, values, p):
    df = spark.createDataFrame([("k", float(v)) for v in values], "k string, v double")
    got = order_stats.quantiles(df, ["k"], "v", {"q": p}).first()
    assert got["n"] == len(values)
    assert got["q"] == pytest.approx(float(np.quantile(values, p)), rel=1e-9, abs=1e-9)


def test_median_and_mad_by_group(spark, grid):
    got = {r["station_id"]: r for r in order_stats.median_and_mad(grid, ["station_id"], "x").collect()}
    for s, g in grid.toPandas().groupby("station_id"):
        x = g["x"].dropna().to_numpy()
        assert got[s]["median"] == pytest.approx(np.median(x)) and got[s]["mad"] == pytest.approx(np.median(np.abs(x - np.median(x))))


def test_robust_scale_floors(spark):
    df = spark.createDataFrame([("one", 5.0), ("flat", 1.0), ("flat", 1.0), ("wide", 0.0), ("wide", 10.0), ("wide", 4.0)], "k string, v double")
    got = {r["k"]: r["scale"] for r in order_stats.robust_std(df, ["k"], "v", 0.2).collect()}
    assert got["one"] == 0.2 and got["flat"] == 0.2 and got["wide"] == pytest.approx(1.4826 * 4.0)


def test_share_above_equals_counting(spark):
    residuals = RNG.normal(0, 1, 400).round(2)
    asked = np.concatenate([RNG.normal(0, 2, 50).round(2), [-99.0, 99.0]])
    r = spark.createDataFrame([(float(v),) for v in residuals], "residual double")
    q = spark.createDataFrame([(i, float(v)) for i, v in enumerate(asked)], "i int, t double")
    got = {x["i"]: x["p"] for x in share_above(q, "t", r).collect()}
    for i, t in enumerate(asked):
        assert got[i] == pytest.approx(float(np.mean(residuals > t)))


def test_as_of_join_takes_exact_and_near_matches_only(spark):
    lab = spark.createDataFrame([("a", 1, 100), ("a", 2, 250), ("a", 3, 99), ("b", 4, 100)], "k string, id int, at bigint")
    facts = spark.createDataFrame([("a", 100, "x"), ("a", 120, "y"), ("c", 100, "z")], "k string, at bigint, v string")
    got = {r["id"]: r["v"] for r in joins.as_of_row(lab, facts, ["k"], "at", ["v"], tolerance=130, width=16).collect()}
    assert got == {1: "x", 2: "y", 3: None, 4: None}


def test_interval_totals_equal_the_pairs(spark):
    points = spark.createDataFrame([("a" if i % 3 else "b", i * 7, float(i % 11)) for i in range(300)], "k string, at bigint, v double")
    spans = spark.createDataFrame([(1, "a", 10, 900), (2, "a", 500, 505), (3, "b", 0, 2100), (4, "b", 3000, 4000)], "ep int, k string, lo bigint, hi bigint")
    pairs = joins.interval_pairs(points, spans, ["k"], "at", "lo", "hi", 64).groupBy("ep").agg(F.count("v").alias("n"), F.sum("v").alias("s")).collect()
    totals = joins.interval_totals(points, spans, ["k"], "ep", "at", "lo", "hi", "v", 64).collect()
    assert {r["ep"]: (r["n"], r["s"]) for r in pairs} == {r["ep"]: (r["points"], r["total"]) for r in totals}


def test_interval_pairs_keep_their_tasks(spark):
    points = spark.range(6000).select((F.col("id") % 3).alias("k"), F.col("id").alias("at"), F.col("id").alias("src"))
    spans = spark.range(600).select((F.col("id") % 3).alias("k"), F.col("id").alias("ep"), (F.col("id") * 10).alias("lo"), (F.col("id") * 10 + 90).alias("hi"))
    pairs = joins.interval_pairs(points, spans, ["k"], "at", "lo", "hi", 64)
    assert pairs.columns == ["k", "at", "src", "ep", "lo", "hi"]
    got = sorted((r["ep"], r["src"]) for r in pairs.collect())
    assert got == sorted((e, x) for e in range(600) for x in range(e * 10, min(e * 10 + 91, 6000)) if x % 3 == e % 3)
    assert pairs.rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_overlap_by_running_maximum(spark):
    spans = spark.createDataFrame([(1, "a", 100, 110), (2, "a", 500, 510), (3, "b", 100, 110), (4, "a", 131, 140)], "id int, k string, s bigint, e bigint")
    known = spark.createDataFrame([("a", 0, 600 - 200), ("a", 105, 107)], "k string, s bigint, e bigint").filter("e < 300")
    got = {r["id"]: r["overlapped"] for r in joins.overlapped(spans, known, ["k"], "s", "e", 5, 20).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False}
