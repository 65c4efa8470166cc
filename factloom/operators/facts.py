"""Facts: one row per natural key, newest rows, series by year, streaks and windows of a year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days a row may be old: flows and balances, and rows of a fiscal year.
MAX_AGE, MAX_AGE_FY = 400, 480
#: Days between the ends of quarters and of half years (fixed values).
QUARTER_GAP, HALF_GAP = (70, 110), (150, 220)
#: Order of periods with the same end and filing date (fixed value).
PERIOD_ORDER = ("FY", "Q4", "Q3", "Q2", "Q1", "TTM", "INSTANT")


def period_rank(c: str = "fiscal_period") -> Column:
    return F.coalesce(F.array_position(F.array(*(F.lit(p) for p in PERIOD_ORDER)), F.col(c)), F.lit(99)).cast("int")


def newest_first(window_keys: list[str], *extra: Column) -> Window:
    return Window.partitionBy(*window_keys).orderBy(F.desc("end_date"), F.desc_nulls_last("filed"), period_rank(), *extra)


def one_per_natural_key(facts: DataFrame, keys: tuple[str, ...] = ("listing_id", "concept", "fiscal_period", "end_date")) -> DataFrame:
    """The latest filing of each natural key (ties: latest update, then greatest id), by a map-side combined ``max_by``."""
    rest = [c for c in facts.columns if c not in keys]
    order = F.struct(F.coalesce(F.col("filed"), F.lit("0001-01-01").cast("date")), F.col("updated_at"), F.col("fact_id"))
    out = facts.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("r"))
    return out.select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in facts.columns))


def latest_facts(facts: DataFrame, reference: Column | None = None, max_age: int = MAX_AGE) -> DataFrame:
    """The newest row of each listing and concept; with a reference date, only if it isn't older than ``max_age`` days."""
    out = facts.withColumn("rn", F.row_number().over(newest_first(["listing_id", "concept"]))).filter("rn = 1").drop("rn")
    return out if reference is None else out.filter(F.col("end_date") >= F.date_sub(reference, max_age))


def first_n_facts(facts: DataFrame, n: int, periods: list[str] | None = None) -> DataFrame:
    """The ``n`` newest rows of each listing and concept, of the given periods."""
    rows = facts.filter(F.col("fiscal_period").isin(*periods)) if periods else facts
    return rows.withColumn("rn", F.row_number().over(newest_first(["listing_id", "concept"]))).filter(F.col("rn") <= n)


def by_year(facts: DataFrame, newest: bool = True) -> DataFrame:
    """Fiscal-year rows, one per calendar year of the end date: the newest (or the oldest) of the year."""
    order = F.desc("end_date") if newest else F.asc("end_date")
    w = Window.partitionBy("listing_id", "concept", "year").orderBy(order, F.desc_nulls_last("filed"))
    rows = facts.filter("fiscal_period = 'FY'").withColumn("year", F.year("end_date").cast("long"))
    return rows.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def strict_years(series: DataFrame, n: int) -> DataFrame:
    """Series with a row in each of the ``n`` years that end with their newest; those rows."""
    w = Window.partitionBy("listing_id", "concept")
    rows = series.withColumn("last_year", F.max("year").over(w)).filter(F.col("year") > F.col("last_year") - n)
    return rows.withColumn("n_years", F.count("*").over(w)).filter(F.col("n_years") == n)


def consecutive_years(series: DataFrame, most: int, least: int) -> DataFrame:
    """The unbroken chain of years that ends with the newest, at most ``most`` long; chains under ``least`` are left out."""
    w = Window.partitionBy("listing_id", "concept")
    down = w.orderBy(F.desc("year"))
    rows = series.withColumn("island", F.col("year") + F.row_number().over(down)).withColumn("top", F.max("year").over(w) + 1)
    rows = rows.filter((F.col("island") == F.col("top")) & (F.col("year") >= F.col("top") - most))
    return rows.withColumn("n_years", F.count("*").over(w)).filter(F.col("n_years") >= least).drop("island", "top")


def streak(facts: DataFrame, holds: Column) -> DataFrame:
    """How many of the newest fiscal-year rows in a row satisfy a condition; by listing and concept."""
    w = newest_first(["listing_id", "concept"]).rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.filter("fiscal_period = 'FY'").withColumn("still", F.min(holds.cast("int")).over(w))
    return rows.groupBy("listing_id", "concept").agg(F.sum("still").cast("long").alias("streak"), F.max("end_date").alias("as_of"))


def ttm_windows(facts: DataFrame, reference: Column, max_age: int = MAX_AGE, annual_max_age: int | None = None) -> DataFrame:
    """The newest window of about twelve months of each listing and concept, or why there is none.

    Quarterly rows, one per end date (the newest filing), newest first.  Four rows with quarterly gaps make a window; else two
    rows with a half-yearly gap, confirmed by a third row if there is one; with ``annual_max_age`` a fresh row of a fiscal year
    stands in.  ``cadence`` is quarterly, semi_annual, annual or NULL; ``failure`` is too_few, too_old, no_cadence or NULL.
    """
    q = facts.filter(F.col("fiscal_period").isin("Q1", "Q2", "Q3", "Q4"))
    dedupe = Window.partitionBy("listing_id", "concept", "end_date").orderBy(F.desc_nulls_last("filed"), period_rank())
    q = q.withColumn("k", F.row_number().over(dedupe)).filter("k = 1")
    w = Window.partitionBy("listing_id", "concept").orderBy(F.desc("end_date"))
    q = q.withColumn("rn", F.row_number().over(w)).withColumn("gap", F.datediff("end_date", F.lead("end_date").over(w)))
    at = lambda c, n: F.max(F.when(F.col("rn") == n, F.col(c)))
    total = lambda n: F.sum(F.when(F.col("rn") <= n, F.col("value")))
    agg = q.groupBy("listing_id", "concept").agg(F.max("rn").alias("n"), F.max("end_date").alias("newest"), *(at("gap", i).alias(f"g{i}") for i in (1, 2, 3)), total(4).alias("s4"), total(2).alias("s2"))
    fy = facts.filter("fiscal_period = 'FY'").groupBy("listing_id", "concept").agg(F.max("end_date").alias("fy_end"), F.max_by("value", "end_date").alias("fy_value"))
    agg = agg.join(fy, ["listing_id", "concept"], "full")
    quarterly = lambda g: F.coalesce(F.col(g).between(*QUARTER_GAP), F.lit(False))
    half = lambda g: F.coalesce(F.col(g).between(*HALF_GAP), F.lit(False))
    failure = F.when(F.coalesce(F.col("n"), F.lit(0)) < 2, "too_few").when(F.col("newest") < F.date_sub(reference, max_age), "too_old")
    cadence = F.when((F.col("n") >= 4) & quarterly("g1") & quarterly("g2") & quarterly("g3"), "quarterly").when(half("g1") & ((F.col("n") == 2) | half("g2")), "semi_annual")
    agg = agg.withColumn("early", failure).withColumn("cadence", F.when(F.col("early").isNull(), cadence))
    agg = agg.withColumn("failure", F.coalesce("early", F.when(F.col("cadence").isNull(), F.when(quarterly("g1") & (F.col("n") < 4), "too_few").otherwise("no_cadence"))))
    annual = F.lit(False) if annual_max_age is None else F.coalesce(F.col("cadence").isNull() & (F.col("fy_end") >= F.date_sub(reference, annual_max_age)), F.lit(False))
    out = agg.select(
        "listing_id", "concept",
        F.when(annual, "annual").otherwise(F.col("cadence")).alias("cadence"),
        F.when(annual, F.col("fy_value")).when(F.col("cadence") == "quarterly", F.col("s4")).when(F.col("cadence") == "semi_annual", F.col("s2")).alias("value"),
        F.when(annual, F.col("fy_end")).when(F.col("cadence").isNotNull(), F.col("newest")).alias("as_of"),
        F.when(~annual, F.col("failure")).alias("failure"),
    )
    return out if annual_max_age is not None else out.join(q.select("listing_id", "concept").distinct(), ["listing_id", "concept"], "left_semi")
