"""Time-chunked windows: every per-station window runs per (station, stretch of clock), never per station.

A station that holds a third of a fleet's rows would be one task under `partitionBy("station_id")`. Three exact
shapes cover every window in this library instead:

* bounded frames: each row is copied into the neighbouring chunks whose frames can reach it (`with_halo`), the
  window runs inside the chunk, and the copies are dropped (`core_only`);
* "latest value so far": inside the chunk first, then a carried-in value from one summary row per chunk
  (`carry_last`). Summary rows are bounded by the calendar, not by the data;
* recursions: composed per chunk and replayed (see `recursions.py`).
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Four weeks. A week-long frame then copies a quarter of the rows; an hour-long one next to none.
SLOT_CHUNK = 28 * 144
HOUR_CHUNK = 28 * 24
CHUNK, CORE = "_chunk", "_core"


def with_halo(df: DataFrame, clock: str, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Adds `_chunk`, repeating a row in each chunk whose frames of `before`/`after` clock steps can reach it."""
    first = F.floor((F.col(clock) - after) / width)
    last = F.floor((F.col(clock) + before) / width)
    return df.withColumn(CHUNK, F.explode(F.sequence(first, last))).withColumn(
        CORE, F.col(CHUNK) == F.floor(F.col(clock) / width)
    )


def core_only(df: DataFrame) -> DataFrame:
    return df.filter(CORE).drop(CHUNK, CORE)


def chunk_window(keys, clock: str):
    return Window.partitionBy(*keys, CHUNK).orderBy(clock)


def framed(df: DataFrame, keys, clock: str, exprs, before: int = 0, after: int = 0, width: int = HOUR_CHUNK) -> DataFrame:
    """Adds columns computed over bounded frames.

    `exprs` is a list of steps; each step is a function from the chunk's window to `{name: Column}`. Steps share one
    shuffle and one sort. `before` and `after` are the total reach of all steps in clock units, and `clock` must step
    by one per row (a gap-free grid) where a frame counts rows.
    """
    out = with_halo(df, clock, width, before, after)
    w = chunk_window(keys, clock)
    for step in exprs:
        out = out.withColumns(step(w))
    return core_only(out)


def carry_last(
    df: DataFrame,
    keys,
    clock: str,
    values: dict[str, Column],
    width: int,
    inclusive: bool = True,
    order=None,
    running_max: bool = False,
) -> DataFrame:
    """Adds, per name, the latest non-null `values[name]` at or before (or strictly before) each row.

    With `running_max` it is the largest value so far instead of the latest. Rows may be irregular; `clock` only
    assigns chunks and `order` (default `clock`) sorts inside them. The window over chunk summaries sees one row per
    key and chunk of clock, however many rows the chunk holds.
    """
    order = list(order) if order is not None else [clock]
    tmp = {name: f"_v_{name}" for name in values}
    chunked = df.withColumns({CHUNK: F.floor(F.col(clock) / width), **{tmp[n]: c for n, c in values.items()}})
    stamp = F.struct(*[F.col(o) for o in order])

    def end_of(t):
        return F.max(t) if running_max else F.max_by(F.col(t), F.when(F.col(t).isNotNull(), stamp))

    def so_far(name, window):
        return F.max(name).over(window) if running_max else F.last(name, ignorenulls=True).over(window)

    ends = chunked.groupBy(*keys, CHUNK).agg(*[end_of(t).alias(f"_e_{n}") for n, t in tmp.items()])
    over_chunks = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(*keys, CHUNK, *[so_far(f"_e_{n}", over_chunks).alias(f"_c_{n}") for n in values])
    inside = (
        Window.partitionBy(*keys, CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    )
    out = chunked.withColumns({n: so_far(t, inside) for n, t in tmp.items()})
    out = out.join(ends, [*keys, CHUNK], "left")
    both = F.greatest if running_max else F.coalesce
    return out.withColumns({n: both(F.col(n), F.col(f"_c_{n}")) for n in values}).drop(
        CHUNK, *tmp.values(), *[f"_c_{n}" for n in values]
    )


def carry_next(df: DataFrame, keys, clock: str, values: dict[str, Column], width: int, order=None) -> DataFrame:
    """The mirror image of `carry_last`: the earliest non-null value at or after each row.

    `order` may name columns that break ties after the (reversed) clock.
    """
    back = df.withColumn("_back", -F.col(clock))
    return carry_last(back, keys, "_back", values, width, order=["_back", *(order or [])]).drop("_back")


def row_index(df: DataFrame, keys, clock: str, width: int, name: str = "_row") -> DataFrame:
    """Adds each row's position within its key by `clock`, for frames that count rows of an irregular table.

    Positions inside a chunk plus the counts of the chunks before it: no window ever spans a whole key. Rows with a
    NULL key or clock are numbered among themselves.
    """
    chunked = df.withColumn(CHUNK, F.floor(F.col(clock) / width))
    sizes = chunked.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, CHUNK, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy(*keys, CHUNK).orderBy(clock))
    sizes = sizes.withColumnsRenamed({k: f"_k_{k}" for k in [*keys, CHUNK]})
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in [*keys, CHUNK]])
    out = chunked.withColumn(name, inside).join(sizes, same, "left")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop(CHUNK, "_before", *[f"_k_{k}" for k in [*keys, CHUNK]])
