"""The reset-and-cap exponential mean of a stream whose rows come out of order, as a stateful processor with timers.

Rows wait per station in chunks of event time. A timer closes a chunk once the watermark has passed its end; its rows are then
sorted and scanned like a chunk of the batch operator (`operators.recursions`), so levels are those of the batch operator over
the rows that were not too late. State is one number per station and the chunks the watermark has not passed.

Defined results: rows behind the watermark are left out by Spark before they get here, and only such rows can belong to a closed
chunk; a missing `x` carries the level, a missing `reset` is none; rows of one slot count in the order they came; chunks
the watermark does not reach stay in the state.

Needs the RocksDB state store (`spark.sql.streaming.stateStore.providerClass`).
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tarnwatch.operators.recursions import applied, prefixes

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "station_id string, slot bigint, level double"


class OrderedSmoothing(StatefulProcessor):
    """Rows wait in chunks of event time; a timer closes a chunk once the watermark has passed it."""

    def __init__(self, weight: float, cap: float, step: int, chunk: int):
        self.weight, self.cap, self.step, self.chunk = weight, cap, step, chunk

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.level = handle.getValueState("level", "level double")
        self.waiting = handle.getMapState("waiting", "chunk bigint", "slots array<bigint>, xs array<double>, resets array<boolean>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for chunk, part in batch.groupby(batch["slot"] // self.chunk):
                k = (int(chunk),)
                slots, xs, resets = (list(v) for v in self.waiting.getValue(k)) if self.waiting.containsKey(k) else ([], [], [])
                x = [None if pd.isna(v) else float(v) for v in part["x"]]
                self.waiting.updateValue(k, (slots + part["slot"].astype(int).tolist(), xs + x, resets + part["reset"].astype(bool).tolist()))
                self.handle.registerTimer((int(chunk) + 1) * self.chunk * self.step * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        k = (expiredTimerInfo.getExpiryTimeInMs() // (1000 * self.step * self.chunk) - 1,)
        if not self.waiting.containsKey(k):
            return iter(())
        slots, xs, resets = self.waiting.getValue(k)
        self.waiting.removeKey(k)
        slots, x, reset = np.array(slots), np.array([np.nan if v is None else v for v in xs], float), np.array(resets, bool)
        order = np.argsort(slots, kind="stable")
        slots, x, reset = slots[order], x[order], reset[order]
        hold = np.isnan(x)
        a = np.where(reset, 0.0, np.where(hold, 1.0, 1.0 - self.weight))
        b = np.where(reset | hold, 0.0, np.nan_to_num(x) * self.weight)
        cap = np.full(len(x), self.cap)
        start = self.level.get()[0] if self.level.exists() else 0.0
        levels = applied(prefixes((a, b, -cap, cap)), start)
        self.level.update((float(levels[-1]),))
        return iter([pd.DataFrame({"station_id": [key[0]] * len(slots), "slot": slots, "level": levels})])

    def close(self) -> None:
        pass


def smoothed_in_order(stream: DataFrame, weight: float, cap: float = float("inf"), step: int = 600, chunk: int = 144) -> DataFrame:
    """Levels from a stream of (station_id, slot, x, reset, ts) with a watermark on `ts`; `slot` counts `step` seconds."""
    return stream.groupBy("station_id").transformWithStateInPandas(OrderedSmoothing(weight, cap, step, chunk), OUTPUT, "append", "eventTime")
