"""Whole-number clocks for zone-free timestamps.

Gridded operators key on plain integers (10-minute slot, hour or day since 1970-01-01). Integers hash, sort and
join cheaply, they are independent of the session time zone, and frame bounds become exact clock distances.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

SLOT_US = 600_000_000


def _epoch() -> Column:
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")


def day_no(ts) -> Column:
    return F.unix_date(F.to_date(ts)).cast("bigint")


def hour_no(ts) -> Column:
    """Hours since the epoch of the hour that contains `ts`."""
    return day_no(ts) * 24 + F.hour(ts)


def slot_no(ts) -> Column:
    """10-minute slots since the epoch of the slot that contains `ts`."""
    return hour_no(ts) * 6 + F.floor(F.minute(ts) / 10)


def micros(ts) -> Column:
    """Microseconds since the epoch, as a bigint."""
    second_us = (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("bigint")
    return (hour_no(ts) * 60 + F.minute(ts)) * 60_000_000 + second_us


def nearest_slot(ts) -> Column:
    """Nearest 10-minute slot; a reading exactly half-way goes to the even slot."""
    us = micros(ts)
    below = F.floor(us / SLOT_US)
    rest = us - below * SLOT_US
    up = (rest * 2 > SLOT_US) | ((rest * 2 == SLOT_US) & (below % 2 != 0))
    return F.when(up, below + 1).otherwise(below)


def from_slot(slot) -> Column:
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(0), (F.lit(10) * slot).cast("int"))


def from_hour(hour) -> Column:
    return _epoch() + F.make_dt_interval(F.lit(0), F.lit(hour) if isinstance(hour, int) else hour.cast("int"))


def from_day(day) -> Column:
    return _epoch() + F.make_dt_interval(day.cast("int"))


def hour_of_day(hour) -> Column:
    return F.pmod(hour, F.lit(24))


def day_of_hour(hour) -> Column:
    return F.floor(hour / 24)
