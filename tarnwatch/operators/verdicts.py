"""Which sensor is to blame, which fault it has, and what each reading's verdict is."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.working import count_true

from .lake_qc import any_of


def isolate(own: dict[str, Column], others: dict[str, list[Column]], sensors=K.LAKE_SENSORS) -> Column:
    """The sensor whose reconstruction brings every other sensor back within limits (1 = limit), else ''.

    The one that leaves the least disagreement wins; the first in sensor order wins a tie.
    """
    remaining = {s: F.coalesce(F.greatest(*others[s]), F.lit(0.0)) for s in sensors}
    explains = {s: F.coalesce((own[s] > 1) & (remaining[s] <= 1), F.lit(False)) for s in sensors}
    left = F.array(*[F.when(explains[s], remaining[s]) for s in sensors])
    best = F.array_min(left)
    chain = F.when(best.isNull(), "")
    for s in sensors:
        chain = chain.when(explains[s] & (remaining[s] == best), s)
    return chain.otherwise("")


def fault_labels(df: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Adds `<s>_fault` from `<s>_reason`, `instant`, `drift`, `candidate` and `event`.

    A shape fault outranks drift, drift outranks inconsistency, and a lone step comes last; inferred faults are held
    back during an event, and a lone step while one may be starting.
    """
    lone = count_true([F.col(f"{s}_reason") == "rate_of_change" for s in sensors]) == 1
    calm = ~F.col("event")
    labels = {}
    for s in sensors:
        reason = F.col(f"{s}_reason")
        labels[f"{s}_fault"] = (
            F.when(reason.isin(K.SHAPE_FAULTS), reason)
            .when((F.col("drift") == s) & calm, "drift")
            .when((F.col("instant") == s) & calm, "inconsistent")
            .when((reason == "rate_of_change") & lone & ~F.col("candidate"), "rate_of_change")
            .otherwise("")
        )
    return df.withColumns(labels)


def verdict(sensors=K.LAKE_SENSORS) -> Column:
    """missing, possible_event, sensor_fault, needs_review or normal, in that order of precedence."""
    gone = F.coalesce(*[F.col(s) for s in sensors]).isNull()
    return (
        F.when(gone, "missing")
        .when(F.col("event"), "possible_event")
        .when(any_fault(sensors), "sensor_fault")
        .when(F.col("review"), "needs_review")
        .otherwise("normal")
    )


def any_fault(sensors=K.LAKE_SENSORS) -> Column:
    return any_of([F.col(f"{s}_fault") != "" for s in sensors])
