"""Labelled faults and pollution events applied to a clean grid, to test a detector."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import SLOT_US, micros
from tarnwatch.functions.working import at_least, from_working, to_working

from .joins import interval_pairs

DAY_SLOTS = 144


def _size_of(kind: Column, sensor: str) -> Column:
    chain = F.when(F.lit(False), F.lit(0.0))
    for k, sizes in K.FAULT_SIZE.items():
        chain = chain.when(kind == k, sizes[sensor])
    return chain


def apply_episodes(grid: DataFrame, episodes: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """The grid with each episode's effect on its own slots, plus `kind` ('' outside episodes).

    `episodes` has `ep`, `station_id`, `kind`, `sensor`, `start`, `end` and a signed `size`. A slot belongs to the
    latest episode that began at or before it and has not ended (of equal starts the smallest `ep`), so overlapping
    entries never stack and an enclosing episode goes on after a nested one.
    """
    spans = episodes.select(
        "station_id",
        F.ceil(micros(F.col("start")) / SLOT_US).alias("first"),
        F.floor(micros(F.col("end")) / SLOT_US).alias("last"),
        "ep", "kind", "sensor", F.col("size").cast("double").alias("size"),
    ).filter("last >= first")
    spans = spans.withColumn("e", F.struct("first", "last", "ep", "kind", "sensor", "size")).select("station_id", "first", "last", "ep", "e")
    pairs = interval_pairs(grid.select("station_id", "slot"), spans, ["station_id"], "slot", "first", "last", DAY_SLOTS)
    acting = pairs.groupBy("station_id", "slot").agg(F.max_by("e", F.struct("first", -F.col("ep"))).alias("e"))
    out = grid.join(acting, ["station_id", "slot"], "left")

    # A flat line holds the episode's first present value: one aggregate row per episode, looked up again.
    flat = out.filter(F.col("e.kind") == "flatline").select("station_id", F.col("e.ep").alias("_ep"), "slot", "e", *sensors)
    value = F.coalesce(*[F.when(F.col("e.sensor") == s, F.col(s)) for s in sensors])
    held = flat.groupBy("station_id", "_ep").agg(
        F.min_by(value, F.when(value.isNotNull(), F.col("slot"))).alias("_held")
    )
    out = out.withColumn("_ep", F.col("e.ep")).join(held, ["station_id", "_ep"], "left")

    kind, position, span = F.col("e.kind"), F.col("slot") - F.col("e.first"), F.col("e.last") - F.col("e.first")
    along = F.when(span > 0, position / span).otherwise(0.0)
    pulse = F.least(F.greatest(F.least(along / 0.2, (F.lit(1.0) - along) / 0.4), F.lit(0.0)), F.lit(1.0))
    shape = (
        F.when(kind.isin("spike", "offset"), 1.0)
        .when(kind == "drift", along)
        .when(kind == "oscillation", F.when(position % 2 == 0, 1.0).otherwise(-1.0))
    )
    changed = {}
    for s in sensors:
        mine = F.col("e.sensor") == s
        shift = F.when(mine, F.col("e.size") * _size_of(kind, s) * shape)
        if s in K.EVENT_EFFECT:
            shift = F.when(kind == "event", F.abs(F.col("e.size")) * K.EVENT_EFFECT[s] * pulse).otherwise(shift)
        moved = from_working(to_working(s, s) + shift, s)
        if s in ("turbidity", "dissolved_oxygen"):
            moved = at_least(moved, 0.0)
        changed[s] = (
            F.when(kind == "dropout", None)
            .when((kind == "flatline") & mine, F.coalesce(F.col("_held"), F.col(s)))
            .when(shift.isNotNull(), moved)
            .otherwise(F.col(s))
        )
    return out.withColumns(changed).withColumn("kind", F.coalesce(kind, F.lit(""))).drop("e", "_ep", "_held")
