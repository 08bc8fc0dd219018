"""Order-dependent recursions of the form level = clip(a * level + b, -cap, cap), run in parallel chunks.

Such steps (a >= 0) compose into one map of the same form, and composing is associative. So a chunk reduces to four
numbers per column by halving, the chunks' maps in order give every chunk its starting level, and inside a chunk the
maps up to each row come from doubling passes over whole columns: twelve passes for four weeks of slots, no loop over
rows. A station's history of any length spreads over tasks, and the result is the sequential one.
"""

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chunks import CHUNK
from .lineage import materialise


def _after(later, earlier):
    """One map for two: `earlier`, then `later`. A map is four arrays (a, b, low, high): clip(a x + b, low, high)."""
    a2, b2, low2, high2 = later
    a1, b1, low1, high1 = earlier
    constant = a2 == 0  # 0 times an open bound is no number; a constant map gives b2 whatever came before
    scale = np.where(constant, 1.0, a2)
    low, high = (np.where(constant, b2, scale * x + b2) for x in (low1, high1))
    return a2 * a1, a2 * b1 + b2, np.clip(low, low2, high2), np.clip(high, low2, high2)


def composed(maps):
    """All rows' maps as one row, by halving: neighbours are joined until one is left."""
    while len(maps[0]) > 1:
        even = len(maps[0]) // 2 * 2
        pairs = _after([m[1:even:2] for m in maps], [m[0:even:2] for m in maps])
        maps = [np.concatenate((p, m[even:])) for p, m in zip(pairs, maps)]
    return maps


def prefixes(maps):
    """For each row the map of all rows up to it, by doubling: each pass joins stretches twice as long."""
    maps, reach = [np.array(m, dtype=float) for m in maps], 1
    while reach < len(maps[0]):
        longer = _after([m[reach:] for m in maps], [m[:-reach] for m in maps])
        for m, x in zip(maps, longer):
            m[reach:] = x
        reach *= 2
    return maps


def applied(maps, level):
    a, b, low, high = maps
    return np.clip(a * level + b, low, high)


def _maps(pdf, a_cols, b_cols, k_cols):
    a, b, cap = (pdf[c].to_numpy(dtype=float) for c in (a_cols, b_cols, k_cols))
    return a, b, -cap, cap


def clipped_scan(df: DataFrame, keys, clock: str, recursions: dict, width: int) -> DataFrame:
    """Adds one column per recursion; `recursions[name]` is `(a, b)` or `(a, b, cap)` as Columns. Levels start at 0."""
    names = list(recursions)
    inputs = {}
    for i, name in enumerate(names):
        a, b, *cap = recursions[name]
        inputs[f"_a{i}"] = a.cast("double")
        inputs[f"_b{i}"] = b.cast("double")
        inputs[f"_k{i}"] = (cap[0] if cap else F.lit(float("inf"))).cast("double")
    rows = materialise(df.withColumns({CHUNK: F.floor(F.col(clock) / width), **inputs}), "scan_input")
    a_cols, b_cols, k_cols = ([f"_{p}{i}" for i in range(len(names))] for p in "abk")
    map_cols = [f"_{p}{i}" for p in "ABLH" for i in range(len(names))]
    key_fields = [rows.schema[k] for k in keys]
    doubles = [T.StructField(c, T.DoubleType()) for c in map_cols]
    chunk_field = rows.schema[CHUNK]

    def fold(pdf):
        pdf = pdf.sort_values(clock)
        whole = np.concatenate(composed(_maps(pdf, a_cols, b_cols, k_cols)), axis=1)
        where = pdf[[*keys, CHUNK]].iloc[:1].reset_index(drop=True)
        return pd.concat([where, pd.DataFrame(whole, columns=map_cols)], axis=1)

    # NaN never reaches here: a NULL input is expressed by the caller as a hold (a = 1, b = 0).
    maps = rows.select(*keys, CHUNK, clock, *inputs).groupBy(*keys, CHUNK).applyInPandas(
        fold, T.StructType([*key_fields, chunk_field, *doubles])
    )
    starts = [f"_s{i}" for i in range(len(names))]

    def chain(pdf):
        pdf = pdf.sort_values(CHUNK)
        upto = prefixes([pdf[[f"_{p}{i}" for i in range(len(names))]].to_numpy() for p in "ABLH"])
        # A chunk starts from the level at the end of the one before it.
        out = np.concatenate((np.zeros((1, len(names))), applied(upto, np.zeros(len(names)))[:-1]))
        where = pdf[[*keys, CHUNK]].reset_index(drop=True)
        return pd.concat([where, pd.DataFrame(out, columns=starts)], axis=1)

    # One row per chunk of clock: bounded by the calendar, whatever the station's row count.
    begin = maps.groupBy(*keys).applyInPandas(
        chain, T.StructType([*key_fields, chunk_field, *[T.StructField(s, T.DoubleType()) for s in starts]])
    )
    joined = rows.join(begin, [*keys, CHUNK])
    helpers = {CHUNK, *inputs, *starts}
    kept = [f for f in joined.schema.fields if f.name not in helpers]

    def replay(pdf):
        pdf = pdf.sort_values(clock)
        out = applied(prefixes(_maps(pdf, a_cols, b_cols, k_cols)), pdf[starts].iloc[0].to_numpy(dtype=float))
        kept_columns = pdf.drop(columns=list(helpers)).reset_index(drop=True)
        return pd.concat([kept_columns, pd.DataFrame(out, columns=names)], axis=1)

    schema = T.StructType([*kept, *[T.StructField(n, T.DoubleType()) for n in names]])
    return joined.groupBy(*keys, CHUNK).applyInPandas(replay, schema)


def smoothing(value: Column, weight: float, reset: Column | None = None, cap: Column | None = None):
    """Recursion of an exponentially weighted mean: missing values carry it, `reset` zeroes it, `cap` bounds it."""
    a = F.when(value.isNull(), 1.0).otherwise(1.0 - weight)
    b = F.when(value.isNull(), 0.0).otherwise(value * weight)
    if reset is not None:
        a, b = F.when(reset, 0.0).otherwise(a), F.when(reset, 0.0).otherwise(b)
    return (a, b) if cap is None else (a, b, cap)


def decaying_sum(value: Column, decay: float):
    """Recursion of a sum that fades by `decay` each step; missing values add nothing."""
    return F.lit(decay), F.coalesce(value.cast("double"), F.lit(0.0))
