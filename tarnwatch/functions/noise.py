"""Random numbers that depend on a seed and a row's own keys: the same for any order, partitioning or retry."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DIGITS = 13  # hexadecimal digits of the digest that make one number: 52 bits


def _number(digest: Column, first: int) -> Column:
    return F.conv(F.substring(digest, first, DIGITS), 16, 10).cast("double")


def _digest(seed: int, name: str, keys) -> Column:
    return F.md5(F.concat_ws("|", F.lit(f"{seed}|{name}"), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]))


def uniform(seed: int, name: str, keys) -> Column:
    """A number in [0, 1) for each value of `keys`."""
    return _number(_digest(seed, name, keys), 1) / float(1 << 52)


def normal(seed: int, name: str, keys) -> Column:
    """A standard normal number for each value of `keys` (Box-Muller on the two halves of one digest)."""
    digest = _digest(seed, name, keys)
    radius = F.sqrt(-2 * F.ln((_number(digest, 1) + 1) / float(1 << 52)))
    return radius * F.cos(2 * F.pi() * _number(digest, 1 + DIGITS) / float(1 << 52))
