"""The reset-and-cap exponential mean as per-station state, for drift levels that update as readings arrive."""

import pandas as pd
from pyspark.sql import DataFrame

OUTPUT = "station_id string, slot bigint, level double"
STATE = "slot bigint, level double"


def smoothed(stream: DataFrame, weight: float, cap: float = float("inf")) -> DataFrame:
    """Levels from a stream of (station_id, slot, x, reset). A row not newer than the state is late and left out.

    State is two numbers per station; a micro-batch's rows of a station are bounded by the trigger interval.
    """

    def update(key, batches, state):
        last, level = state.get if state.exists else (None, 0.0)
        rows = pd.concat(list(batches)).sort_values("slot")
        if last is not None:
            rows = rows[rows["slot"] > last]
        out = []
        for slot, x, reset in zip(rows["slot"], rows["x"], rows["reset"]):
            if reset:
                level = 0.0
            elif not pd.isna(x):
                level = min(max(level + weight * (x - level), -cap), cap)
            out.append((key[0], int(slot), level))
            last = int(slot)
        if last is not None:
            state.update((last, level))
        yield pd.DataFrame(out, columns=["station_id", "slot", "level"])

    return stream.groupBy("station_id").applyInPandasWithState(update, OUTPUT, STATE, "append", "NoTimeout")
