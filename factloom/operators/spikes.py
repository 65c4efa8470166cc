"""Impossible, stuck and spiking values of series, relative to what each series delivers otherwise.

A series has at most one date per calendar day, but it may have any number of rows.  Series of many rows are found by a count first:
their rows are collapsed to dates on the map side and get the verdicts on their dates back by a join.  The rows of all other
series come together once, in one exchange, and are judged where they are.  Levels come from the dates around; the usual spread of
a series comes from a quantile sketch (Greenwald-Khanna) of its relative distances from its level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.materialize import materialize

#: Dates that stand for a missing one (fixed values).
FILLER_DATES = ("0001-01-01", "1900-01-01", "2099-12-31", "9999-12-31")

#: A series of more rows than this, and than a millionth of all rows, is a long one; so there are at most a million long ones.
LONG_SERIES = 50_000


def _same(a: Column, b: Column) -> Column:
    """Equal but for the rounding of a change of units."""
    return F.abs(a - b) <= 1e-9 * F.greatest(F.abs(a), F.abs(b))


def _median(values: Column) -> Column:
    """Median of an array without NULLs; NULL if it is empty."""
    s, n = F.sort_array(values), F.size(values)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def implausible_values(
    df: DataFrame,
    row_id: str,
    series: list[str],
    at: str,
    value: str,
    newest: list[str],
    *,
    may_be_negative: Column,
    upper_bound: Column,
    may_be_stuck: Column,
    reach: int = 5,
    least_rows: int = 12,
    least_jump: float = 0.3,
    spreads: float = 6.0,
    longest_spike: int = 2,
    least_stuck: int = 6,
    accuracy: int = 200,
    long_series: int = LONG_SERIES,
) -> DataFrame:
    """``row_id`` and ``reason`` (impossible, stuck or spike; the first that holds) of every row that cannot be right.

    * impossible: below zero unless ``may_be_negative``, or above ``upper_bound`` (NULL: none);
    * stuck: on at least ``least_stuck`` consecutive dates the series has exactly one value, where ``may_be_stuck``;
    * spike: in series of at least ``least_rows`` rows, the value lies beyond the levels before and after (medians of up to
      ``reach`` dates) by ``least_jump`` of the level and by ``spreads`` usual spreads, on at most ``longest_spike`` dates in a
      row.  The fence is the interquartile range of the relative distances, expanded to ``spreads`` standard deviations.
      A value with no level before or after it can't be seen to return and is no spike.

    ``series`` holds the source and the context in which its values compare.  If a date has several values, the one greatest
    by ``newest`` stands for the level; each row is then judged by its own value.  Rows without a date, with a filler date or
    with a NULL or NaN value can only be impossible, and NULL or NaN never is.  A NULL in ``series`` is a value of its own.  Repeated
    rows are judged alike.  ``row_id`` should be unique; a repeated one is returned as often as it is flagged.
    """
    rows = df.select(
        F.col(row_id).alias("__id"),
        F.coalesce(F.col(series[0]).cast("string"), F.lit("\0")).alias("__s0") if not df.schema[series[0]].dataType.simpleString() in ("bigint", "int") else F.col(series[0]).alias("__s0"),
        # A long in place of the other texts: it only has to tell apart series of one and the same first column.
        F.xxhash64(*series[1:]).alias("__s1"),
        F.col(at).alias("__at"),
        F.when(~F.isnan(value), F.col(value)).alias("__v"),
        F.struct(*newest).alias("__newest"),
        F.coalesce((F.col(value) < 0) & ~may_be_negative | (F.col(value) > upper_bound) & ~F.isnan(value), (F.col(value) < 0) & ~may_be_negative, F.lit(False)).alias("__impossible"),
        F.coalesce(may_be_stuck, F.lit(False)).alias("__may_stick"),
    )
    # Units are parsed once; cheap scans of this table follow.
    rows = materialize(rows, "readings")
    keys = ["__s0", "__s1"]
    usable = rows.filter(F.col("__v").isNotNull() & F.col("__at").isNotNull() & ~F.col("__at").cast("string").isin(*FILLER_DATES))
    counts = usable.groupBy(*keys).agg(F.count("*").alias("n"))
    # Proven size: at most a million keys of two columns.
    long = materialize(counts.filter(F.col("n") > max(long_series, rows.count() // 1_000_000)).select(*(F.col(k).alias(f"__l{k}") for k in keys)), "long-series")
    is_long = usable["__s0"].eqNullSafe(long["__l__s0"]) & (usable["__s1"] == long["__l__s1"])
    of_long = usable.join(F.broadcast(long), is_long, "left_semi")
    summary = [F.max_by("__v", "__newest").alias("v"), F.min("__v").alias("low"), F.max("__v").alias("high"), F.count("*").alias("n"), F.min("__may_stick").alias("may_stick")]
    # One exchange by series; dates, windows and verdicts stay in its partitions.
    short = usable.join(F.broadcast(long), is_long, "left_anti").repartition(*keys)
    held = F.collect_list(F.when(~F.col("__impossible"), F.struct("__id", "__v"))).alias("held")
    judge = lambda dates: _fenced(dates, keys, reach, least_rows, least_jump, spreads, longest_spike, least_stuck, accuracy)
    inside = judge(short.groupBy(*keys, "__at").agg(*summary, held)).select("stuck", "upper", "lower", F.inline("held").alias("__id", "__v"))
    flagged = judge(of_long.groupBy(*keys, "__at").agg(*summary)).select(F.col("__s0").alias("__f0"), F.col("__s1").alias("__f1"), F.col("__at").alias("__fat"), "stuck", "upper", "lower")
    possible = of_long.filter(~F.col("__impossible")).select("__id", *keys, "__at", "__v")
    same = possible["__s0"].eqNullSafe(flagged["__f0"]) & (possible["__s1"] == flagged["__f1"]) & (possible["__at"] == flagged["__fat"])
    verdict = F.when(F.col("stuck"), "stuck").when(_outside("__v"), "spike").alias("reason")
    judged = inside.select("__id", verdict).unionByName(possible.join(flagged, same).select("__id", verdict)).filter(F.col("reason").isNotNull())
    impossible = rows.filter("__impossible").select("__id", F.lit("impossible").alias("reason"))
    return impossible.unionByName(judged).withColumnRenamed("__id", row_id)


def _outside(x: str) -> Column:
    return F.coalesce((F.col(x) >= F.col("upper")) & (F.col(x) > F.col("lower")) | (F.col(x) <= F.col("lower")) & (F.col(x) < F.col("upper")), F.lit(False))


def _fenced(dates: DataFrame, keys: list[str], reach: int, least_rows: int, least_jump: float, spreads: float, longest_spike: int, least_stuck: int, accuracy: int) -> DataFrame:
    """The dates with a stuck value or values outside the fence: ``stuck``, ``upper``, ``lower``, and their other columns."""
    order = Window.partitionBy(*keys).orderBy("__at")
    steps = range(1, max(reach, least_stuck - 1) + 1)
    seen = F.struct("v", F.when(_same(F.col("low"), F.col("high")), F.col("v")).alias("one"))
    dates = dates.select("*", *(F.lag(seen, k).over(order).alias(f"b{k}") for k in steps), *(F.lead(seen, k).over(order).alias(f"a{k}") for k in steps), F.sum("n").over(Window.partitionBy(*keys)).alias("rows"))

    def run(side: str) -> Column:
        """How many of the next dates on a side have the date's one value."""
        total, still = F.lit(0), F.lit(True)
        for k in range(1, least_stuck):
            still = still & F.coalesce(_same(F.col(f"{side}{k}.one"), F.col("v")), F.lit(False))
            total = total + still.cast("int")
        return total

    near = lambda side: [F.col(f"{side}{k}.v") for k in range(1, reach + 1)]
    more = [c for c in dates.columns if c == "held"]
    dates = dates.select(
        *keys, "__at", "v", "low", "high", "rows", *more,
        (F.col("may_stick") & _same(F.col("low"), F.col("high")) & (run("b") + run("a") + 1 >= least_stuck)).alias("stuck"),
        _median(F.array_compact(F.array(*near("b")))).alias("before"),
        _median(F.array_compact(F.array(*near("a")))).alias("after"),
        _median(F.array_compact(F.array(*near("b"), *near("a")))).alias("level"),
    )
    distance = F.col("v") - F.col("level")
    relative = F.when(distance == 0, 0.0).otherwise(F.coalesce(F.try_divide(distance, F.abs("level")), F.lit(1e9)))
    # The sketch of a series covers all its dates; it is built where they already are, in one task each.
    usual = F.percentile_approx(F.when(F.col("level").isNotNull(), relative), F.array(F.lit(0.25), F.lit(0.75)), F.lit(accuracy)).over(Window.partitionBy(*keys))
    dates = dates.withColumn("q", F.when(F.col("rows") >= least_rows, usual))
    spread = (F.col("q")[1] - F.col("q")[0]) / 1.349
    top, bottom = F.greatest("before", "after"), F.least("before", "after")
    margin = F.greatest(F.lit(least_jump), spreads * spread)
    both = F.col("before").isNotNull() & F.col("after").isNotNull()
    fenced = dates.select(
        *keys, "__at", "v", "low", "high", "stuck", *more,
        F.when(both & F.col("q").isNotNull(), top + margin * F.abs(top)).alias("upper"),
        F.when(both & F.col("q").isNotNull(), bottom - margin * F.abs(bottom)).alias("lower"),
    )
    fenced = fenced.withColumn("out", _outside("v"))
    # A stretch of flagged dates longer than a spike is a change of level.
    around = [F.coalesce((F.lag if k < 0 else F.lead)("out", abs(k)).over(order), F.lit(False)) for k in range(-longest_spike, longest_spike + 1) if k]
    whole = F.lit(False)
    for first in range(longest_spike + 1):
        part = F.lit(True)
        for flag in around[first : first + longest_spike]:
            part = part & flag
        whole = whole | part
    fenced = fenced.withColumn("long", F.col("out") & whole)
    flagged = fenced.filter(F.col("stuck") | ~F.col("long") & (_outside("low") | _outside("high")))
    return flagged.select(*keys, "__at", "stuck", F.when(~F.col("long"), F.col("upper")).alias("upper"), F.when(~F.col("long"), F.col("lower")).alias("lower"), *more)
