"""Exact medians, quantiles and order statistics without a per-group task: a selection tree.

`percentile` keeps every distinct value of a group in one aggregation buffer, which a fleet-wide group does not fit. Here a
group's values are counted in the bins of a logarithmic scale, each with its least and largest value: a few thousand nodes
per group whatever the data, combined before the shuffle. Only nodes that hold a wanted rank are descended: their range is
cut into equal parts that are counted again, until a node holds one value or at most `RANKED` rows, which are ranked. The
nodes of the parts of a pooled group add up to its own. The answer is exact; nothing is sampled or sketched.

Values are read once per level (twice in all for most data) and no value is written: only nodes are, one row per group. A
plan that is more than a scan with filters and projections is written first, so that no level computes it again.

NULL and NaN are missing; rows with a NULL key belong to no group.
"""

import re

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tarnwatch.constants import MAD_TO_STD

from .lineage import materialise

BINS_PER_E = 256
UNIT = 0.01
RANKED = 20_000  # rows of a node that one task may rank
CUTS = 1_024  # parts into which a larger node is cut
VALUE = "_x"
POOLED = "\x00all"
_WIDE = re.compile(r"\b(\w*Join|Aggregate|Window|Sort|Distinct|Deduplicate|Repartition\w*|Intersect|Except|Map\w+|FlatMap\w+|\w*Python\w*)\b")


def table_of(df: DataFrame) -> DataFrame:
    """The table itself if reading it again costs a scan, else written once."""
    plan = df._jdf.queryExecution().analyzed().toString()
    return materialise(df, "values") if _WIDE.search(plan) else df


def _values(df: DataFrame, keys, value) -> DataFrame:
    value = F.col(value) if isinstance(value, str) else value
    src = df.select(*keys, value.cast("double").alias(VALUE))
    known = F.col(VALUE).isNotNull() & ~F.isnan(VALUE)
    for k in keys:
        known &= F.col(k).isNotNull()
    return table_of(src.filter(known))


def _bin(value: Column) -> Column:
    """Monotone in the value: about 0.4% wide, linear near zero, and bounded for any double."""
    return F.floor(F.signum(value) * F.log1p(F.abs(value) / UNIT) * BINS_PER_E)


def _node():
    return [F.count(F.lit(1)).alias("w"), F.min(VALUE).alias("lo"), F.max(VALUE).alias("hi")]


def _wanted(ranks: dict) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), rank(F.col("n")).cast("bigint").alias("rank")) for name, rank in ranks.items()])


def _holding(nodes: DataFrame, ranks: dict) -> DataFrame:
    """The nodes (with `below`, the rows of the group below them, and `n`) that hold a wanted rank."""
    below, upto = F.col("below"), F.col("below") + F.col("w")
    return nodes.filter(F.exists(_wanted(ranks), lambda r: (r["rank"] >= below) & (r["rank"] < upto)))


def _several(node) -> Column:
    return node["lo"] < node["hi"]


def _large(node) -> Column:
    return _several(node) & (node["w"] > RANKED)


def _per_key(nodes: DataFrame, keys) -> tuple[DataFrame, int]:
    """One written row per group: its count and the nodes to look into, as many as ranks are wanted at most.

    With it the most rows in a node of several values, observed while the rows are written.
    """
    item = F.struct("lo", "hi", "w", "below")
    tree = nodes.groupBy(*keys).agg(F.max("n").alias("n"), F.collect_list(item).alias("nodes"))
    widest = Observation()
    rows = F.transform(F.filter("nodes", _several), lambda t: t["w"])
    tree = materialise(tree.observe(widest, F.max(F.array_max(rows)).alias("rows")), "nodes")
    return tree, widest.get["rows"] or 0


def _rows_of(values: DataFrame, tree: DataFrame, keys, chosen) -> DataFrame:
    """The values that lie in chosen nodes, each beside its node."""
    some = tree.withColumn("nodes", F.filter("nodes", chosen)).filter(F.size("nodes") > 0)
    inside = F.filter("nodes", lambda t: F.col(VALUE).between(t["lo"], t["hi"]))
    return values.join(some, list(keys)).withColumn("node", F.get(inside, 0)).drop("nodes").filter("node is not null")


def _ranked(values: DataFrame, keys, ranks: dict, pooled: str | None = None) -> DataFrame:
    """Per key the total `n` and, per name, the value at the 0-based rank `ranks[name](n)`; `values` has the keys and `VALUE`.

    With `pooled`, a key among `keys`, the groups over all its values come too, under `POOLED`.
    """
    nodes = values.groupBy(*keys, _bin(F.col(VALUE)).alias("bin")).agg(*_node())
    if pooled is not None:
        nodes = with_pooled(nodes, pooled).groupBy(*keys, "bin").agg(F.sum("w").alias("w"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        values = with_pooled(values, pooled)
    group = Window.partitionBy(*keys)
    before = group.orderBy("lo").rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns({"n": F.sum("w").over(group), "below": F.coalesce(F.sum("w").over(before), F.lit(0))})
    tree, widest = _per_key(_holding(nodes, ranks), keys)
    while widest > RANKED:
        near = _rows_of(values, tree, keys, _large)
        # Halves before the difference, so that the extremes of a double do not overflow.
        width = F.col("node.hi") / 2 - F.col("node.lo") / 2
        share = F.try_divide(F.col(VALUE) / 2 - F.col("node.lo") / 2, width)
        part = F.coalesce(F.least(F.floor(share * CUTS), F.lit(CUTS - 1)), F.when(F.col(VALUE) > F.col("node.lo"), CUTS - 1).otherwise(0))
        cut = near.groupBy(*keys, "n", F.col("node.lo").alias("_from"), F.col("node.below").alias("_base"), part.cast("int").alias("part")).agg(*_node())
        before = Window.partitionBy(*keys, "_from").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        cut = cut.withColumn("below", F.col("_base") + F.coalesce(F.sum("w").over(before), F.lit(0)))
        done = tree.select(*keys, "n", F.inline(F.filter("nodes", lambda t: ~_large(t))))
        tree, widest = _per_key(_holding(cut, ranks).select(*keys, "n", "lo", "hi", "w", "below").unionByName(done), keys)

    found = tree.select(*keys, "n", F.inline(F.filter("nodes", lambda t: ~_several(t)))).select(*keys, "n", F.col("lo").alias(VALUE), "w", "below")
    if widest:
        near = _rows_of(values, tree, keys, _several)
        each = near.groupBy(*keys, "n", F.col("node.lo").alias("_from"), F.col("node.below").alias("_base"), VALUE).agg(F.count(F.lit(1)).alias("w"))
        before = Window.partitionBy(*keys, "_from").orderBy(VALUE).rowsBetween(Window.unboundedPreceding, -1)
        each = each.withColumn("below", F.col("_base") + F.coalesce(F.sum("w").over(before), F.lit(0)))
        found = found.unionByName(each.select(*found.columns))
    found = found.withColumn("one", F.explode(_wanted(ranks))).filter("one.rank >= below and one.rank < below + w")
    return found.groupBy(*keys).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("one.name") == name, F.col(VALUE))).alias(name) for name in ranks])


def _grouped(df: DataFrame, keys):
    """A keyless call is one group under a constant key."""
    return (df, list(keys), False) if keys else (df.withColumn("_group", F.lit(0)), ["_group"], True)


def order_stats(df: DataFrame, keys, value, ranks: dict) -> DataFrame:
    """One row per key: `n` non-null values and, per name, the value at the 0-based rank `ranks[name](n)`."""
    df, keys, whole = _grouped(df, keys)
    out = _ranked(_values(df, keys, value), keys, ranks)
    return out.drop("_group") if whole else out


def _quantiles(values: DataFrame, keys, probs: dict, pooled: str | None = None) -> DataFrame:
    ranks = {}
    for name, p in probs.items():
        ranks[f"_lo_{name}"] = lambda n, p=p: F.floor((n - 1) * F.lit(float(p)))
        ranks[f"_hi_{name}"] = lambda n, p=p: F.ceil((n - 1) * F.lit(float(p)))
    found = _ranked(values, keys, ranks, pooled)
    out = [F.col("n")]
    for name, p in probs.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (position - F.floor(position))).alias(name))
    return found.select(*keys, *out)


def quantiles(df: DataFrame, keys, value, probs: dict, pooled: str | None = None) -> DataFrame:
    """One row per key with any value: the count `n` and linearly interpolated quantiles `{name: probability}`.

    `pooled` names a key over all of whose values the groups come too, under `POOLED`.
    """
    df, keys, whole = _grouped(df, keys)
    out = _quantiles(_values(df, keys, value), keys, probs, pooled)
    return out.drop("_group") if whole else out


def median(df: DataFrame, keys, value, name: str = "median") -> DataFrame:
    return quantiles(df, keys, value, {name: 0.5})


def median_and_mad(df: DataFrame, keys, value, pooled: str | None = None) -> DataFrame:
    """Per key: count `n`, `median`, and `mad`, the median absolute deviation from it."""
    df, keys, whole = _grouped(df, keys)
    values = _values(df, keys, value)
    mid = materialise(_quantiles(values, keys, {"median": 0.5}, pooled).select(*keys, "median"), "medians")
    # A pooled deviation is one from the pooled median, so here every row counts under both keys.
    values = values if pooled is None else with_pooled(values, pooled)
    off = values.join(mid, keys).select(*keys, F.abs(F.col(VALUE) - F.col("median")).alias(VALUE))
    out = _quantiles(off, keys, {"mad": 0.5}).join(mid, keys)
    return out.drop("_group") if whole else out


def robust_std(df: DataFrame, keys, value, floor, name: str = "scale", pooled: str | None = None) -> DataFrame:
    """1.4826 x MAD, never below `floor`; one value is too few to judge, so the floor stands.

    Keys without any value are absent; readers fill in the floor.
    """
    floor = floor if isinstance(floor, Column) else F.lit(float(floor))
    scale = F.when(F.col("n") < 2, floor).otherwise(F.greatest(F.lit(MAD_TO_STD) * F.col("mad"), floor))
    return median_and_mad(df, keys, value, pooled).select(*keys, scale.alias(name))


def with_pooled(df: DataFrame, key: str) -> DataFrame:
    """Every row twice: under its own key and under the pooled key, so one grouping answers both levels."""
    return df.withColumn(key, F.explode(F.array(F.col(key), F.lit(POOLED))))
