"""Forecast and soft-sensor scores as one-pass aggregates."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.airindex import aqi_category
from tarnwatch.functions.timing import horizon_bucket, lead_group
from tarnwatch.functions.water import class_rank

from .lineage import materialise
from .order_stats import quantiles


def mae(predicted, actual="actual") -> Column:
    p = F.col(predicted) if isinstance(predicted, str) else predicted
    return F.avg(F.abs(p - F.col(actual)))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; an unknown comparison counts as not."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def skill(model: Column, *rules: Column) -> Column:
    best = F.least(*rules) if len(rules) > 1 else rules[0]
    return F.lit(1.0) - F.try_divide(model, best)


def hourly_report(forecasts: DataFrame, buckets=K.LAKE_BUCKETS) -> DataFrame:
    """Per sensor and horizon bucket: accuracy of the median against two simple rules, range coverage and width."""
    known = forecasts.filter(F.col("actual").isNotNull()).withColumn("bucket", horizon_bucket("horizon", buckets))
    same = F.coalesce(F.col("same_hour_last_day"), F.col("persistence"))
    scored = known.groupBy("sensor", "bucket").agg(
        mae("mid").alias("_m"), mae("persistence").alias("_p"), mae(same).alias("_s"),
        share(F.col("actual").between(F.col("lo"), F.col("hi"))).alias("_c"),
        F.avg(F.col("hi") - F.col("lo")).alias("_w"),
    )
    return scored.select(
        "sensor", "bucket",
        F.round("_m", 4).alias("mae"), F.round("_p", 4).alias("mae_persistence"),
        F.round("_s", 4).alias("mae_same_hour_yesterday"),
        F.round(skill(F.col("_m"), F.col("_p"), F.col("_s")), 3).alias("skill"),
        F.round("_c", 3).alias("coverage_80"), F.round("_w", 4).alias("mean_width"),
    )


def relative_error(forecasts: DataFrame, by=()) -> DataFrame:
    """Mean over sensors of the model's error relative to persistence: what candidates are chosen by, lowest first."""
    known = forecasts.filter(F.col("actual").isNotNull())
    ratios = known.groupBy(*by, "sensor").agg(F.try_divide(mae("mid"), mae("persistence")).alias("_r"))
    return ratios.groupBy(*by).agg(F.avg("_r").alias("relative_error"))


def alert_scores(df: DataFrame, keys, probability: str, alert: Column, event: Column) -> DataFrame:
    """Hits, misses, false alarms and probability scores per key; a rate over nothing is NULL."""
    p, e = F.col(probability), event.cast("double")
    total = df.groupBy(*keys).agg(
        F.count_if(event).alias("events"),
        F.count_if(alert & event).alias("hits"),
        F.count_if(~F.coalesce(alert, F.lit(False)) & event).alias("misses"),
        F.count_if(alert & ~event).alias("false_alarms"),
        F.avg((p - e) * (p - e)).alias("_brier"),
        F.avg(e).alias("_base"),
    )
    hits, misses, false = F.col("hits"), F.col("misses"), F.col("false_alarms")
    reference = F.col("_base") * (F.lit(1.0) - F.col("_base"))

    def rate(a, b):
        return F.round(F.try_divide(a.cast("double"), b.cast("double")), 3)

    return total.select(
        *keys, "events", "hits", "misses", "false_alarms",
        rate(hits, hits + misses).alias("probability_of_detection"),
        rate(false, hits + false).alias("false_alarm_ratio"),
        rate(hits, hits + misses + false).alias("critical_success_index"),
        F.round("_brier", 4).alias("brier_score"),
        F.round(F.when(reference > 0, F.lit(1.0) - F.try_divide(F.col("_brier"), reference)), 3).alias("brier_skill"),
    )


def nightly_report(forecasts: DataFrame) -> DataFrame:
    """Per night ahead: accuracy against last night and the weekly mean, and range coverage."""
    known = forecasts.filter(F.col("actual").isNotNull())
    week = F.coalesce(F.col("week_mean"), F.col("last_night"))
    scored = known.groupBy("days_ahead").agg(
        mae("mid").alias("_m"), mae("last_night").alias("_l"), mae(week).alias("_w"),
        share(F.col("actual").between(F.col("lo"), F.col("hi"))).alias("_c"),
    )
    return scored.select(
        "days_ahead", F.round("_m", 3).alias("mae"), F.round("_l", 3).alias("mae_last_night"),
        F.round("_w", 3).alias("mae_week_mean"), F.round(skill(F.col("_m"), F.col("_l"), F.col("_w")), 3).alias("skill"),
        F.round("_c", 3).alias("coverage_80"),
    )


def nightly_alert_scores(forecasts: DataFrame, threshold: float = K.DO_ALERT, alert_at: float = K.ALERT_PROBABILITY) -> DataFrame:
    """Alert scores over all nights ('all') and per lead group, both levels from one grouping."""
    known = forecasts.filter(F.col("actual").isNotNull())
    levels = F.array(F.lit("all"), lead_group("days_ahead", K.LEAD_GROUPS))
    both = known.withColumn("lead_group", F.explode(F.array_compact(levels)))
    return alert_scores(both, ["lead_group"], "p_below_alert", F.col("p_below_alert") >= alert_at, F.col("actual") < threshold)


def air_hourly_scores(forecasts: DataFrame, buckets=K.AIR_BUCKETS) -> DataFrame:
    known = forecasts.filter(F.col("actual").isNotNull()).withColumn("bucket", horizon_bucket("horizon", buckets))
    scored = known.groupBy("pollutant", "bucket").agg(
        F.round(mae("mid"), 2).alias("mae"), F.round(mae("persistence"), 2).alias("mae_persistence"),
        F.round(share(F.col("actual").between(F.col("lo"), F.col("hi"))), 3).alias("coverage_80"),
    )
    return scored.withColumn("skill", F.round(skill(F.col("mae"), F.col("mae_persistence")), 3))


def air_daily_scores(forecasts: DataFrame, targets=("pm25", "pm10"), poor: float = K.POOR_INDEX, alert_at: float = K.ALERT_PROBABILITY):
    """Per day ahead: accuracy per pollutant, category agreement, and how Poor days were called."""
    known = materialise(forecasts.filter(F.col("actual_pm_index").isNotNull()), "verified_days")
    per_day = known.groupBy("days_ahead").agg(
        *[
            c
            for t in targets
            for c in (
                F.round(mae(t, f"{t}_actual"), 2).alias(f"{t}_mae"),
                F.round(mae(f"{t}_last24h", f"{t}_actual"), 2).alias(f"{t}_mae_persistence"),
                F.round(share(F.col(f"{t}_actual").between(F.col(f"{t}_lo"), F.col(f"{t}_hi"))), 3).alias(f"{t}_coverage_80"),
            )
        ],
        F.round(share(F.col("pm_category") == aqi_category("actual_pm_index")), 3).alias("category_agreement"),
    )
    alerts = alert_scores(
        known, ["days_ahead"], "p_poor_or_worse", F.col("p_poor_or_worse") >= alert_at, F.col("actual_pm_index") > poor
    )
    return per_day.join(alerts, "days_ahead")


def accuracy(df: DataFrame, keys, actual: str = "actual", estimate: str = "estimate") -> DataFrame:
    """Per key: MAE, RMSE, median percentage error, log RMSE, log R2 and median ratio of a positive estimate."""
    rows = df.filter(F.col(actual).isNotNull() & F.col(estimate).isNotNull())
    rows = materialise(rows.select(*keys, actual, estimate), "scored")
    a, e = F.col(actual), F.col(estimate)
    log_error, log_actual = F.ln(e) - F.ln(a), F.ln(a)
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("samples"),
        F.round(F.avg(F.abs(e - a)), 3).alias("mae"),
        F.round(F.sqrt(F.avg((e - a) * (e - a))), 3).alias("rmse"),
        F.avg(log_error * log_error).alias("_le"),
        F.var_pop(log_actual).alias("_lv"),
    )
    sums = sums.withColumns(
        {"rmse_log": F.round(F.sqrt("_le"), 3), "r2_log": F.round(F.lit(1.0) - F.try_divide(F.col("_le"), F.col("_lv")), 3)}
    ).drop("_le", "_lv")
    marked = rows.withColumn("_ratio", e / a).withColumn("_off", F.abs(F.col("_ratio") - 1))
    middle = _medians(marked, keys, {"median_ratio": "_ratio", "_pct": "_off"})
    out = sums.join(middle, list(keys))
    return out.withColumns(
        {"median_ratio": F.round("median_ratio", 3), "median_abs_pct_error": F.round(F.col("_pct") * 100, 1)}
    ).drop("_pct")


def _medians(df: DataFrame, keys, columns: dict) -> DataFrame:
    """Exact medians of several columns per key, from one grouping over (key, column)."""
    long = df.select(*keys, *[F.col(c).alias(n) for n, c in columns.items()]).unpivot(list(keys), list(columns), "_name", "_value")
    mid = quantiles(long, [*keys, "_name"], "_value", {"_mid": 0.5})
    return mid.groupBy(*keys).agg(*[F.max(F.when(F.col("_name") == n, F.col("_mid"))).alias(n) for n in columns])


def range_quality(df: DataFrame, keys, actual: str = "actual") -> DataFrame:
    cover = df.groupBy(*keys).agg(F.round(share(F.col(actual).between(F.col("lo"), F.col("hi"))), 3).alias("coverage"))
    factor = _medians(df.withColumn("_f", F.try_divide(F.col("hi"), F.col("lo"))), keys, {"median_width_factor": "_f"})
    return cover.join(factor.withColumn("median_width_factor", F.round("median_width_factor", 2)), list(keys))


def agreement(df: DataFrame, keys, a: str, b: str, name: str = "agreement") -> DataFrame:
    """Share of rows on which two gradings agree."""
    return df.groupBy(*keys).agg(F.round(share(F.col(a) == F.col(b)), 3).alias(name))


def confusion(df: DataFrame, actual: str, predicted: str, labels) -> DataFrame:
    """Counts per (actual, predicted), zeros included, for a fixed list of labels."""
    counts = df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count(F.lit(1)).alias("n"))
    spark = df.sparkSession
    frame = spark.createDataFrame([(x, y) for x in labels for y in labels], "actual string, predicted string")
    return frame.join(counts, ["actual", "predicted"], "left").fillna(0, ["n"])


def macro_f1(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: the mean of the classes' F1 scores (0 where a class has no hit)."""
    each = df.select(F.explode(F.array(F.struct(F.col(actual).alias("c"), F.lit(1).alias("is_actual"), F.lit(0).alias("is_predicted"), (F.col(actual) == F.col(predicted)).cast("int").alias("hit")),
                                       F.struct(F.col(predicted).alias("c"), F.lit(0).alias("is_actual"), F.lit(1).alias("is_predicted"), F.lit(0).alias("hit")))).alias("x")).select("x.*")
    per_class = each.groupBy("c").agg(F.sum("hit").alias("tp"), (F.sum("is_actual") + F.sum("is_predicted")).alias("size"))
    return per_class.agg(F.avg(F.col("tp") * 2.0 / F.col("size")).alias("macro_f1"), F.count(F.lit(1)).alias("classes"))


def cleaner_than_actual(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """One row: share of rows predicted cleaner than they were, and how many by two classes or more."""
    steps = class_rank(actual) - class_rank(predicted)
    return df.agg(
        F.round(share(steps > 0), 4).alias("rate_predicted_cleaner"), F.count_if(steps >= 2).alias("count_2plus_cleaner")
    )


def station_medians(train: DataFrame, target: str) -> DataFrame:
    """Median of earlier results per station, plus the overall median under the key NULL."""
    from .order_stats import POOLED, with_pooled

    out = quantiles(with_pooled(train, "station_id"), ["station_id"], target, {"usual": 0.5}).select("station_id", "usual")
    return out.withColumn("station_id", F.when(F.col("station_id") != POOLED, F.col("station_id")))


def with_usual(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Adds `usual`: the station's median, or the overall one for a station never seen."""
    own = medians.filter(F.col("station_id").isNotNull()).withColumnRenamed("usual", "_own")
    overall = medians.filter(F.col("station_id").isNull()).select("usual").scalar()
    return df.join(own, "station_id", "left").withColumn("usual", F.coalesce(F.col("_own"), overall)).drop("_own")
