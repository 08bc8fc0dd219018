"""Text to numbers and times at the boundary: bad input becomes NULL, never an error."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .working import as_col, finite


def parse_numeric(x) -> Column:
    """Number from text; "<1" (below a detection limit of 1) reads as half the limit, junk as NULL."""
    text = F.trim(as_col(x).cast("string"))
    # The JVM also reads "1d", "2f" and hexadecimal as numbers; a lab sheet never means those.
    plain = F.when(~text.rlike("[dDfFxX]"), F.ltrim(text, F.lit("<")))
    number = finite(plain.try_cast("double"))
    return F.when(text.startswith("<"), number / 2).otherwise(number)


def parse_time(x) -> Column:
    """Zone-free timestamp from text, NULL when it cannot be read."""
    return as_col(x).try_cast("timestamp_ntz")


def local_time(x, zone: str) -> Column:
    """Zone-free local clock time of an instant written with a UTC offset (or `Z`).

    The text is split into its wall-clock part and its offset, so the result does not depend on the session zone.
    """
    text = F.trim(as_col(x).cast("string"))
    offset = F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1)
    wall = F.regexp_replace(text, r"\s*(Z|[+-]\d{2}:?\d{2})$", "").try_cast("timestamp_ntz")
    sign = F.when(offset.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(offset, r"[^0-9]", "")
    minutes = F.when(
        F.length(digits) == 4,
        sign * (F.substring(digits, 1, 2).try_cast("int") * 60 + F.substring(digits, 3, 2).try_cast("int")),
    ).otherwise(0)
    utc = wall - F.make_dt_interval(F.lit(0), F.lit(0), minutes)
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), utc)
