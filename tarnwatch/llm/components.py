"""Connected components of a table of links by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `links` (a, b): the root is the smallest node of the component.

    Every step is an aggregate by node and a join; a node with very many links is combined before the shuffle.
    Steps repeat until a whole round changes nothing.
    """
    edges = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = _mark(edges)
    for _ in range(rounds):
        if before[0] == 0:
            break
        edges = materialise(_small_star(_large_star(edges)), "links")
        now = _mark(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _mark(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m"))
    near = both.join(least, F.col("a") == F.col("_n")).select("a", "b", F.least("_m", "a").alias("_m"))
    return near.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("_m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are linked to the smallest of them."""
    least = edges.groupBy(F.col("a").alias("_n")).agg(F.min("b").alias("_m"))
    near = edges.join(least, F.col("a") == F.col("_n"))
    moved = near.select(F.col("b").alias("a"), F.col("_m").alias("b")).unionByName(near.select("a", F.col("_m").alias("b")))
    return moved.filter("a <> b").distinct()
