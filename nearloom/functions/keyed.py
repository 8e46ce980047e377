"""Keyed hashes: every random choice is a function of ids and a seed, never of partitions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key(parts) -> Column:
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in columns])


def hash60(*parts) -> Column:
    """A non-negative 60-bit integer from the md5 of the parts joined by ``:``."""
    return F.conv(F.substring(F.md5(_key(parts)), 1, 15), 16, 10).cast("bigint")


def uniform(*parts) -> Column:
    """A double in (0, 1)."""
    return (hash60(*parts).cast("double") + F.lit(0.5)) / F.lit(float(1 << 60))


def gaussian(*parts) -> Column:
    """A standard normal value by the Box-Muller rule."""
    radius = F.sqrt(F.lit(-2.0) * F.log(uniform(*parts, "r")))
    return radius * F.cos(F.lit(2.0 * math.pi) * uniform(*parts, "t"))


def sign(*parts) -> Column:
    """+1 if the first hex digit of the md5 of ``seed:rotation:layer:i`` is below 8, else -1."""
    return F.when(F.substring(F.md5(_key(parts)), 1, 1) < "8", F.lit(1)).otherwise(F.lit(-1))
