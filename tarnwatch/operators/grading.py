"""Grading that joins estimates: CPCB class with the coliform nowcast where there is one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwatch.functions.water import cpcb_class

COLIFORM_LIMITS = {50.0: "p_above_50", 500.0: "p_above_500", 5000.0: "p_above_5000"}
BOD_LIMITS = {2.0: "p_above_2", 3.0: "p_above_3"}
GRADES = ["cpcb_class", "cpcb_confidence", "cpcb_not_assessed"]


def graded(df: DataFrame) -> DataFrame:
    """BOD estimates with their CPCB class from oxygen, pH and P(BOD within each limit)."""
    bod = {lim: F.lit(1.0) - F.col(p) for lim, p in BOD_LIMITS.items()}
    out = df.drop(*GRADES).withColumn("_g", cpcb_class("dissolved_oxygen", "ph", bod))
    return out.select("*", *[F.col(f"_g.{g}") for g in GRADES]).drop("_g")


def graded_with_coliform(bod: DataFrame, coliform: DataFrame) -> DataFrame:
    """The same, with the coliform odds of the same station and time wherever all of them are known."""
    names = {p: f"coliform_{p}" for p in COLIFORM_LIMITS.values()}
    odds = coliform.select("station_id", "timestamp", *[F.col(p).alias(n) for p, n in names.items()])
    both = bod.drop(*GRADES).join(odds, ["station_id", "timestamp"], "left")
    p_bod = {lim: F.lit(1.0) - F.col(p) for lim, p in BOD_LIMITS.items()}
    p_col = {lim: F.lit(1.0) - F.col(names[p]) for lim, p in COLIFORM_LIMITS.items()}
    known = F.lit(True)
    for n in names.values():
        known = known & F.col(n).isNotNull()
    g = F.when(known, cpcb_class("dissolved_oxygen", "ph", p_bod, p_col)).otherwise(cpcb_class("dissolved_oxygen", "ph", p_bod))
    out = both.withColumn("_g", g)
    return out.select("*", *[F.col(f"_g.{c}") for c in GRADES]).drop("_g")
