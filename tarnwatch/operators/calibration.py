"""Forecast ranges that hold their promised coverage: conformal offsets, weekly refreshes, residual ranges."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.odds import uncrossed, widen
from tarnwatch.functions.timing import horizon_bucket

from .lineage import materialise
from .order_stats import order_stats

COVERAGE = K.QUANTILES[-1] - K.QUANTILES[0]


def fit_offsets(forecasts: DataFrame, keys, coverage: float = COVERAGE, min_count: int = K.MIN_CALIBRATION) -> DataFrame:
    """Per group of at least `min_count` verified forecasts, the `offset` by which [lo, hi] must grow to cover.

    The offset is an order statistic of the conformity scores, taken exactly, whatever the group's size.
    """
    known = forecasts.filter(F.col("actual").isNotNull() & F.col("lo").isNotNull() & F.col("hi").isNotNull())
    score = F.greatest(F.col("lo") - F.col("actual"), F.col("actual") - F.col("hi"))

    def rank(n: Column) -> Column:
        level = F.least(F.lit(1.0), F.ceil((n + 1) * F.lit(float(coverage))) / n)
        return F.ceil(level * (n - 1))

    found = order_stats(known, keys, score, {"offset": rank})
    return found.filter(F.col("n") >= min_count).select(*keys, "offset")


def refreshed(previous: DataFrame, found: DataFrame, keys) -> DataFrame:
    """New offsets where a group had enough forecasts, the old ones elsewhere."""
    old = previous.withColumnRenamed("offset", "_old")
    out = found.join(old, list(keys), "outer")
    return out.select(*keys, F.coalesce("offset", "_old").alias("offset"))


def apply_offsets(forecasts: DataFrame, offsets: DataFrame, keys) -> DataFrame:
    """Forecasts with `lo` and `hi` moved by their group's offset (none: unchanged), the median kept inside."""
    out = forecasts.join(offsets, list(keys), "left")
    return out.withColumns(widen("lo", "mid", "hi", "offset")).drop("offset")


def bucketed(forecasts: DataFrame, buckets=K.LAKE_BUCKETS) -> DataFrame:
    return forecasts.withColumn("bucket", horizon_bucket("horizon", buckets))


def weekly_offsets(forecasts: DataFrame, keys, origin: str, start: int, end: int, verified_after: int = K.MAX_HORIZON,
                   every: int = K.RECALIBRATE_EVERY * 24, window: int = K.RECALIBRATE_DAYS * 24) -> DataFrame:
    """Offsets for each test week from `start`, from the forecasts of the window before it that were verified by then.

    A forecast serves only the few weeks whose window holds it (window / every, rounded up), so it is listed for
    those and all weeks are fitted in one grouping. A group short of forecasts keeps its latest earlier offset.
    """
    first_week = F.floor((F.col(origin) + verified_after - start) / every) + 1
    last_week = F.floor((F.col(origin) + window - start) / every)
    final = (end - start - 1) // every
    weeks = F.sequence(F.greatest(first_week, F.lit(0)), F.least(last_week, F.lit(final)))
    serves = F.greatest(first_week, F.lit(0)) <= F.least(last_week, F.lit(final))
    listed = forecasts.filter(serves).withColumn("week", F.explode(weeks))
    found = fit_offsets(listed, ["week", *keys])
    all_weeks = found.select(*keys).distinct().withColumn("week", F.explode(F.sequence(F.lit(0), F.lit(final)).cast("array<bigint>")))
    # One row per week and group.
    so_far = Window.partitionBy(*keys).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    full = all_weeks.join(found, ["week", *keys], "left")
    return full.withColumn("offset", F.last("offset", ignorenulls=True).over(so_far)).filter("offset is not null")


def in_week(forecasts: DataFrame, origin: str, start: int, every: int = K.RECALIBRATE_EVERY * 24) -> DataFrame:
    """Test forecasts with the week that made them."""
    return forecasts.filter(F.col(origin) >= start).withColumn("week", F.floor((F.col(origin) - start) / every))


def needs_refresh(history: DataFrame, clock: str, trained_until: int, days: int = K.RECALIBRATE_DAYS) -> DataFrame:
    """One row: whether the last month of history starts after training ended."""
    return history.agg((F.max(clock) + 1 - days * 24 > trained_until).alias("refresh"))


def averaged_quantiles(forecasts: DataFrame, keys) -> DataFrame:
    """Several forecasters' quantiles averaged level by level."""
    return forecasts.groupBy(*keys).agg(*[F.avg(q).alias(q) for q in ("lo", "mid", "hi")])


def sorted_quantiles(df: DataFrame) -> DataFrame:
    """`lo`, `mid`, `hi` put in rising order, so they never cross."""
    out = df.withColumn("_q", uncrossed("lo", "mid", "hi"))
    return out.withColumns({n: F.get("_q", i) for i, n in enumerate(("lo", "mid", "hi"))}).drop("_q")


def residual_range(residuals: DataFrame, column: str = "residual", coverage: float = COVERAGE) -> DataFrame:
    """One row: the residuals' median and the two order statistics that bound the central share."""
    alpha = 1 - coverage
    found = order_stats(
        residuals,
        [],
        column,
        {
            "r_lo": lambda n: F.greatest(F.floor((n + 1) * F.lit(alpha) / 2) - 1, F.lit(0)),
            "r_hi": lambda n: F.least(F.ceil((n + 1) * F.lit(1 - alpha / 2)) - 1, n - 1),
            "_m0": lambda n: F.floor((n - 1) / 2),
            "_m1": lambda n: F.ceil((n - 1) / 2),
        },
    )
    return found.select("n", "r_lo", ((F.col("_m0") + F.col("_m1")) / 2).alias("r_mid"), "r_hi")


def share_above(queries: DataFrame, threshold: str, residuals: DataFrame, column: str = "residual", name: str = "p") -> DataFrame:
    """Adds the share of residuals strictly above each row's threshold; NULL for a row without a threshold.

    Rows and residuals are stacked and cut into stretches of about equal size along the value: splitters come from both
    sides, and rows of one value are spread by a number of their own, so a threshold that a third of the rows share is no
    single task. A residual comes before a row of its value; a row's rank is the count of residuals in the stretches before
    its own and before it inside.
    """
    row = F.struct(*[F.col(c) for c in queries.columns])
    unasked = queries.filter(F.col(threshold).isNull()).withColumn(name, F.lit(None).cast("double"))
    asked = queries.filter(F.col(threshold).isNotNull()).select(F.col(threshold).cast("double").alias("_x"), F.lit(1).alias("_side"), row.alias("_q"))
    given = residuals.filter(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("_x"), F.lit(0).alias("_side"), F.lit(None).cast(asked.schema["_q"].dataType).alias("_q")
    )
    stacked = given.unionByName(asked).withColumn("_deal", F.monotonically_increasing_id())
    cut = stacked.repartitionByRange("_x", "_side", "_deal").withColumn("_part", F.spark_partition_id())
    cut = materialise(cut, "stretches")  # written, so that the splitters are drawn once
    parts = cut.groupBy("_part").agg(F.sum(1 - F.col("_side")).alias("_n"))
    # One row per stretch.
    before = Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_below"))
    total = cut.select(F.sum(1 - F.col("_side"))).scalar()
    inside = Window.partitionBy("_part").orderBy("_x", "_side", "_deal").rowsBetween(Window.unboundedPreceding, 0)
    ranked = cut.withColumn("_in", F.sum(1 - F.col("_side")).over(inside)).filter("_side = 1").join(parts, "_part")
    return ranked.select("_q.*", (F.lit(1.0) - (F.col("_below") + F.col("_in")) / total).alias(name)).unionByName(unasked)
