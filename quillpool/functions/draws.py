"""Random order from a hash of seed and id: the same on any partitioning, and in any SQL engine with MD5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed, *ids: Column) -> Column:
    """Sort key; break ties by the id itself."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[c.cast("string") for c in ids]))


def draw_int(n: int | Column, seed, *ids: Column) -> Column:
    """A whole number from 0 below n."""
    number = F.conv(F.substring(draw(seed, *ids), 1, 8), 16, 10).cast("long")
    return (number % (F.lit(n) if isinstance(n, int) else n)).cast("int")


def draw_unit(seed, *ids: Column) -> Column:
    """A number from 0 below 1."""
    return F.conv(F.substring(draw(seed, *ids), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
