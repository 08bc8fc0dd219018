"""Published constants and class boundaries."""

import pytest
from pyspark.sql import functions as F

from tarnwatch.functions import airindex, odds, parse, timing, water


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*cols).collect()]


def column(spark, rows, schema, col):
    return [r[0] for r in values(spark, rows, schema, col)]


def test_oxygen_saturation_matches_published_table(spark):
    got = column(spark, [(20.0,), (25.0,)], "t double", water.do_saturation("t"))
    assert got == pytest.approx([9.09, 8.26], abs=0.01)


def test_percent_of_saturation(spark):
    got = column(spark, [(100.0, 20.0)], "p double, t double", water.do_percent_to_mgl("p", "t", 0.93))
    assert got[0] == pytest.approx(9.09 * 0.93, abs=0.01)


def test_numbers_from_lab_text(spark):
    rows = [(" 3.5 ",), ("<1",), ("< 0.4",), ("n/a",), ("NaN",), ("inf",), ("1d",), ("0x10",), (None,), ("<",)]
    assert column(spark, rows, "x string", parse.parse_numeric("x")) == [3.5, 0.5, 0.2, None, None, None, None, None, None, None]


def test_times_and_zones(spark):
    got = column(spark, [("2024-03-10 02:30:00",), ("garbage",)], "x string", parse.parse_time("x").cast("string"))
    assert got == ["2024-03-10 02:30:00", None]
    rows = [("2024-03-01T00:00:00Z",), ("2024-03-01T05:30:00+05:30",), ("2024-02-29 20:00:00-04:00",), ("x",)]
    local = column(spark, rows, "x string", parse.local_time("x", "Asia/Kolkata").cast("string"))
    assert local == ["2024-03-01 05:30:00"] * 3 + [None]


@pytest.mark.parametrize(
    "wqi,label",
    [(0.0, "Excellent"), (25.0, "Excellent"), (25.01, "Good"), (50.0, "Good"), (75.0, "Poor"), (100.0, "Very Poor"),
     (100.01, "Unsuitable"), (450.0, "Unsuitable")],
)
def test_wqi_class_bounds_are_inclusive(spark, wqi, label):
    assert column(spark, [(wqi,)], "x double", water.wqi_class("x")) == [label]


def test_wqi_of_ideal_water_is_zero_and_of_standards_is_100(spark):
    cols = ["ph", "dissolved_oxygen", "turbidity", "bod", "conductivity", "nitrate"]
    schema = ", ".join(f"{c} double" for c in cols)
    rows = [(7.0, 14.6, 0.0, 0.0, 0.0, 0.0), (8.5, 5.0, 5.0, 5.0, 300.0, 45.0), (6.5, 5.0, 5.0, 5.0, 300.0, 45.0)]
    assert column(spark, rows, schema, water.wqi()) == pytest.approx([0.0, 100.0, 100.0])
    assert column(spark, [(None, *rows[0][1:])], schema, water.wqi()) == [None]


def test_lab_columns_take_over_the_label():
    assert water.label_columns(["ph", "lab_ph", "bod"])["ph"] == "lab_ph"
    assert water.label_columns(["ph", "bod"])["ph"] == "ph"


def test_cpcb_classes(spark):
    rows = [
        (7.0, 7.5, 0.9, 0.95, "A"), (5.5, 7.5, 0.2, 0.8, "B"), (4.5, 8.8, 0.1, 0.6, "C"), (4.5, 7.0, 0.1, 0.2, "D"),
        (2.0, 7.0, 0.1, 0.2, "E"), (2.0, 5.0, 0.9, 0.9, "below E"), (None, 7.0, 0.9, 0.9, "unknown"),
    ]
    g = water.cpcb_class("do", "ph", {2.0: "p2", 3.0: "p3"})
    got = values(spark, [r[:4] for r in rows], "do double, ph double, p2 double, p3 double", g["cpcb_class"], g["cpcb_confidence"], g["cpcb_not_assessed"])
    assert [r[0] for r in got] == [r[4] for r in rows]
    assert got[0][1] == 0.9 and got[3][1] == 1.0 and got[5][1] is None
    assert got[0][2] == "total coliforms" and got[4][2] == "conductivity, SAR, boron"


def test_cpcb_with_coliform_multiplies_the_odds(spark):
    g = water.cpcb_class("do", "ph", {2.0: F.lit(0.8), 3.0: F.lit(0.9)}, {50.0: F.lit(0.5), 500.0: F.lit(0.7), 5000.0: F.lit(1.0)})
    got = values(spark, [(7.0, 7.5)], "do double, ph double", g["cpcb_class"], g["cpcb_confidence"], g["cpcb_not_assessed"])
    assert got[0][0] == "B" and got[0][1] == pytest.approx(0.63) and got[0][2] == ""


def test_trophic_bounds_and_odds(spark):
    got = column(spark, [(39.99,), (40.0,), (50.0,), (69.9,), (70.0,)], "t double", water.trophic_class("t"))
    assert got == ["oligotrophic", "mesotrophic", "eutrophic", "eutrophic", "hypereutrophic"]
    assert column(spark, [(2.6,), (7.3,), (56.0,)], "c double", water.carlson_tsi("c")) == pytest.approx([40, 50, 70], abs=0.2)
    chances = water.trophic_odds([F.lit(0.9), F.lit(0.4), F.lit(0.1)])
    row = values(spark, [(1,)], "x int", *chances.values())[0]
    assert row == pytest.approx((0.1, 0.5, 0.3, 0.1)) and sum(row) == pytest.approx(1.0)


def test_coliform_bands(spark):
    got = column(spark, [(10.0,), (50.0,), (51.0,), (500.0,), (5000.0,), (6000.0,)], "x double", water.band_of_count("x"))
    assert got == ["A (<=50)", "A (<=50)", "B (<=500)", "B (<=500)", "C (<=5000)", "above C"]
    rows = [(0.4, 0.2, 0.1), (0.9, 0.5, 0.1), (0.9, 0.8, 0.3), (1.0, 0.9, 0.7)]
    cols = {50.0: "a", 500.0: "b", 5000.0: "c"}
    assert column(spark, rows, "a double, b double, c double", water.band_of_nowcast(cols)) == ["A (<=50)", "B (<=500)", "C (<=5000)", "above C"]


def test_sub_index_is_piecewise_linear_and_capped(spark):
    rows = [(0.0,), (30.0,), (45.0,), (60.0,), (90.0,), (1000.0,), (None,), (-3.0,)]
    got = column(spark, rows, "c double", airindex.sub_index("c", "pm25"))
    assert got == pytest.approx([0, 50, 75, 100, 200, 500, None, 0])


def test_aqi_category_rounds_half_to_even(spark):
    rows = [(50.0,), (50.4,), (50.5,), (51.5,), (200.5,), (201.5,), (500.0,), (None,)]
    got = column(spark, rows, "x double", airindex.aqi_category("x"))
    assert got == ["Good", "Good", "Good", "Satisfactory", "Moderate", "Poor", "Severe", "insufficient data"]


def test_humidity_growth(spark):
    got = column(spark, [(0.0,), (50.0,), (95.0,), (100.0,), (None,)], "rh double", airindex.humidity_growth("rh"))
    assert got[0] == 1.0 and got[1] == pytest.approx(1 + 0.4 / 1.65) and got[2] == pytest.approx(got[3]) and got[4] is None


def test_prob_below_follows_the_quantiles(spark):
    rows = [(1.0, 2.0, 4.0)]
    points = [odds.prob_below(t, "lo", "mid", "hi") for t in (1.0, 2.0, 4.0, 3.0, -10.0, 50.0)]
    assert values(spark, rows, "lo double, mid double, hi double", *points)[0] == pytest.approx((0.1, 0.5, 0.9, 0.7, 0.0, 1.0))


def test_widened_ranges_keep_their_median(spark):
    out = odds.widen("lo", "mid", "hi", "q")
    rows = [(1.0, 2.0, 3.0, 0.5), (1.0, 2.0, 3.0, -5.0), (1.0, 2.0, 3.0, None), (None, 2.0, 3.0, 1.0)]
    got = values(spark, rows, "lo double, mid double, hi double, q double", out["lo"], out["hi"])
    assert got == [(0.5, 3.5), (2.0, 2.0), (1.0, 3.0), (None, 4.0)]


def test_horizon_buckets(spark):
    got = column(spark, [(0,), (1,), (3,), (4,), (48,), (49,)], "h int", timing.horizon_bucket("h", [(1, 3), (4, 48)]))
    assert got == ["", "1-3h", "1-3h", "4-48h", "4-48h", ""]
