"""Percentiles of very large columns from counts in signed logarithmic buckets, which add up across partitions and days.

Bucket ``i`` of width ``gamma = (1 + error) / (1 - error)`` holds values in ``(gamma**(i-1), gamma**i]``.  The value given for
it is off by at most ``error`` of any value in it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gamma(error: float) -> float:
    if not 0 < error < 1:
        raise ValueError("error must lie between 0 and 1")
    return (1 + error) / (1 - error)


def bucket_counts(df: DataFrame, groups: list[str], value: Column, error: float) -> DataFrame:
    """The sketch: ``groups``, ``sign`` (-1, 0, 1), ``bucket`` and ``n``.  NULL, NaN and infinite values are not counted.

    Counts are combined on the map side; the sketch of a group has at most about 1,420 / log(gamma) rows, however many values."""
    v = F.col("__v")
    rows = df.select(*groups, value.cast("double").alias("__v")).filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    # Zero and values nearer to it than the least normal number share the zero bucket.
    sign = F.when(F.abs(v) < 2.2250738585072014e-308, 0).otherwise(F.signum(v)).cast("int")
    bucket = F.when(sign != 0, F.ceil(F.ln(F.abs(v)) / F.lit(math.log(gamma(error))))).otherwise(0).cast("long")
    return rows.groupBy(*groups, sign.alias("sign"), bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merge_counts(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of partitions, days or finer groups added up to ``groups``."""
    return sketches.groupBy(*groups, "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketches: DataFrame, groups: list[str], at: dict[str, float], error: float) -> DataFrame:
    """``groups``, ``n`` and a column for each of ``at`` (name: fraction): within ``error`` of the value of rank
    ``floor(fraction * (n - 1))`` (from 0) of the group.  Groups without counted values give no row."""
    g = gamma(error)
    order = Window.partitionBy(*groups).orderBy("sign", F.col("sign") * F.col("bucket"))
    all_of = Window.partitionBy(*groups)
    ranked = sketches.withColumn("__upto", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__n", F.sum("n").over(all_of))
    middle = F.when(F.col("sign") == 0, 0.0).otherwise(F.col("sign") * 2 * F.pow(F.lit(g), F.col("bucket").cast("double")) / (g + 1))
    first = {name: F.min(F.when(F.col("__upto") > F.floor(F.lit(q) * (F.col("__n") - 1)), F.struct("__upto", middle.alias("v")))) for name, q in at.items()}
    out = ranked.groupBy(*groups).agg(F.max("__n").alias("n"), *(c.alias(name) for name, c in first.items()))
    return out.select(*groups, "n", *(F.col(name)["v"].alias(name) for name in at))
