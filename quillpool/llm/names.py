"""A table's own columns, whatever they are called, and names for helper columns that clash with none of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def free_names(df: DataFrame, count: int) -> list[str]:
    """`count` names that no column of df has, in any case."""
    taken = {c.lower() for c in df.columns}
    free = (f"_h{i}" for i in range(len(taken) + count) if f"_h{i}" not in taken)
    return [next(free) for _ in range(count)]


def own(df: DataFrame) -> list[Column]:
    """df's columns; a dot in a name is part of it."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
