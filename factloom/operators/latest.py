"""The newest row of each key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per combination of ``keys``: the one with the greatest ``order`` (NULLs are smallest; ties by all other columns).

    ``max`` of a struct combines on the map side, so a key that holds a third of the rows is sent as one row per task.
    NULL is a key of its own."""
    rest = [c for c in df.columns if c not in keys]
    ordering = [F.col(c) if isinstance(c, str) else c for c in order]
    tie = [F.col(c) for c in rest if not df.schema[c].dataType.simpleString().startswith("map")]
    ranked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*ordering, *tie)).alias("__row"))
    return ranked.select(*(F.col(k) if k in keys else F.col("__row")[k].alias(k) for k in df.columns))
