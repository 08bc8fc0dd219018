"""Alarms grouped into incidents, and incidents and readings scored against known episodes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwatch import constants as K
from tarnwatch.functions.clock import SLOT_US, from_slot, micros

from .chunks import SLOT_CHUNK, carry_last, framed
from .joins import HOUR_US, as_of, overlapped
from .lineage import materialise
from .order_stats import median

GAP_SLOTS = K.INCIDENT_GAP_MINUTES // K.SLOT_MINUTES


def alarm_incidents(flagged: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Alarm rows of a station at most 70 minutes apart form one incident.

    A row opens an incident when the 70 minutes before it hold no alarm. That is a bounded frame; the opening slot
    then travels along the rows (across chunks as one carried number), and the incident is a plain aggregate.
    """
    alarms = flagged.filter(F.col("verdict").isin(K.ALARM_VERDICTS)).select(
        "station_id", "slot", "verdict", *[f"{s}_fault" for s in sensors]
    )

    def opening(w):
        recent = F.max("slot").over(w.rangeBetween(-GAP_SLOTS, -1))
        return {"_open": F.when(recent.isNull(), F.col("slot"))}

    opened = framed(alarms, ["station_id"], "slot", [opening], before=GAP_SLOTS, width=SLOT_CHUNK)
    # Only alarm rows are left; the carry reads them twice.
    opened = materialise(opened, "alarms")
    opened = carry_last(opened, ["station_id"], "slot", {"_incident": F.col("_open")}, SLOT_CHUNK)
    grouped = opened.groupBy("station_id", "_incident").agg(
        F.min("slot").alias("start_slot"),
        F.max("slot").alias("end_slot"),
        # At most three verdicts and four sensors exist, so these sets cannot grow.
        F.array_join(F.array_sort(F.collect_set("verdict")), ",").alias("verdicts"),
        *[F.bool_or(F.col(f"{s}_fault") != "").alias(f"_{s}") for s in sensors],
    )
    named = F.array_join(F.array_compact(F.array(*[F.when(F.col(f"_{s}"), s) for s in sensors])), ",")
    return grouped.select(
        "station_id",
        from_slot(F.col("start_slot")).alias("start"),
        from_slot(F.col("end_slot")).alias("end"),
        "verdicts",
        named.alias("sensors"),
    )


def explained_incidents(incidents: DataFrame, episodes: DataFrame) -> DataFrame:
    """Incidents with `explained`: an episode of the station overlaps them, with grace before and after."""
    spans = materialise(incidents, "incidents").withColumns({"_s": micros(F.col("start")), "_e": micros(F.col("end"))})
    known = episodes.select("station_id", micros(F.col("start")).alias("_s"), micros(F.col("end")).alias("_e"))
    out = overlapped(spans, known, ["station_id"], "_s", "_e", K.GRACE_HOURS * HOUR_US, K.AFTERMATH_HOURS * HOUR_US)
    return out.withColumnRenamed("overlapped", "explained").drop("_s", "_e")


def episode_scores(flagged: DataFrame, episodes: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Each episode with `detected`, `delay_hours` and `blamed_on_sensor`.

    Only flags on the episode's own readings count. The first flag at or after an episode's start is a forward as-of
    lookup, so readings and episodes never pair up.
    """
    faults = {s: F.col(f"{s}_fault") != "" for s in sensors}
    hits: dict[str, Column] = {
        "event": F.col("event"),
        "dropout": F.col("verdict") == "missing",
        "any": _any(faults.values()),
        **{f"sensor_{s}": c for s, c in faults.items()},
    }
    facts = flagged.select("station_id", "slot", *[F.when(c, F.col("slot")).alias(n) for n, c in hits.items()])
    facts = materialise(facts.filter(F.coalesce(*[F.col(n) for n in hits]).isNotNull()), "hits")
    first = F.ceil(micros(F.col("start")) / SLOT_US)
    asked = episodes.withColumns({"slot": first, "_last": F.floor(micros(F.col("end")) / SLOT_US)})
    out = as_of(asked, facts, ["station_id"], "slot", {n: F.col(n) for n in hits}, SLOT_CHUNK, forward=True)
    own = F.coalesce(*[F.when(F.col("sensor") == s, F.col(f"sensor_{s}")) for s in sensors])
    hit = F.when(F.col("kind") == "event", F.col("event")).when(F.col("kind") == "dropout", F.col("dropout")).otherwise(own)
    hit = F.when(hit <= F.col("_last"), hit)
    delay = (hit * SLOT_US - micros(F.col("start"))) / HOUR_US
    detected = hit.isNotNull()
    blamed = (F.col("kind") == "event") & ~detected & F.coalesce(F.col("any") <= F.col("_last"), F.lit(False))
    return out.select(
        *episodes.columns, detected.alias("detected"), F.round(delay, 2).alias("delay_hours"), blamed.alias("blamed_on_sensor")
    )


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def kind_scores(scored: DataFrame) -> DataFrame:
    """Per kind: episodes, how many were detected, recall, and the median delay of those."""
    totals = scored.groupBy("kind").agg(
        F.count(F.lit(1)).alias("episodes"),
        F.count_if("detected").alias("detected"),
        F.round(F.avg(F.col("detected").cast("double")), 3).alias("recall"),
    )
    delays = median(scored, ["kind"], "delay_hours", "median_delay_hours").select("kind", "median_delay_hours")
    return totals.join(delays, "kind", "left")


def station_weeks(flagged: DataFrame) -> DataFrame:
    spans = flagged.groupBy("station_id").agg((F.max("slot") - F.min("slot")).alias("_slots"))
    return spans.agg((F.sum("_slots") / (7 * K.SLOTS_PER_DAY)).alias("station_weeks"))


def incident_scores(explained: DataFrame, flagged: DataFrame) -> DataFrame:
    """One row: incidents, false ones, false alarms per station-week, and the share explained."""
    counts = explained.select(
        F.count(F.lit(1)).alias("incidents"),
        F.count_if(~F.col("explained")).alias("false_incidents"),
    )
    weeks = station_weeks(flagged).scalar()
    return counts.withColumns(
        {
            "false_alarms_per_station_week": F.round(F.try_divide(F.col("false_incidents"), weeks), 3),
            "incident_precision": F.round(
                F.try_divide(F.col("incidents") - F.col("false_incidents"), F.col("incidents")), 3
            ),
        }
    )


def consistency_coverage(flagged: DataFrame, sensors=K.LAKE_SENSORS) -> DataFrame:
    """Per sensor, the share of its readings on which the cross-sensor check ran."""
    return flagged.agg(
        *[F.round(F.count(f"{s}_z") / F.greatest(F.count(s), F.lit(1)), 3).alias(s) for s in sensors]
    )
