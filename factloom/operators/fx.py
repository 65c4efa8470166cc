"""Exchange rates: backward as-of, direct, inverse or through a pivot currency."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.materialize import materialize

#: Currencies a rate may pass through, the first preferred (fixed value).
PIVOTS = ("USD", "EUR", "GBP")
#: Units of the former currencies for one euro and the day they ended (fixed values).
STATUTORY_EURO = {
    "ATS": (13.7603, "1999-01-01"), "BEF": (40.3399, "1999-01-01"), "DEM": (1.95583, "1999-01-01"), "ESP": (166.386, "1999-01-01"),
    "FIM": (5.94573, "1999-01-01"), "FRF": (6.55957, "1999-01-01"), "IEP": (0.787564, "1999-01-01"), "ITL": (1936.27, "1999-01-01"),
    "LUF": (40.3399, "1999-01-01"), "NLG": (2.20371, "1999-01-01"), "PTE": (200.482, "1999-01-01"), "GRD": (340.750, "2001-01-01"),
    "SIT": (239.640, "2007-01-01"), "CYP": (0.585274, "2008-01-01"), "MTL": (0.429300, "2008-01-01"), "SKK": (30.1260, "2009-01-01"),
    "EEK": (15.6466, "2011-01-01"), "LVL": (0.702804, "2014-01-01"), "LTL": (3.45280, "2015-01-01"), "HRK": (7.53450, "2023-01-01"),
}


def legs(rates: DataFrame) -> DataFrame:
    """Every pair in both directions: ``base``, ``quote``, ``rate_date``, ``rate``, ``kind`` (3 direct, 2 inverse).  Rates of 0 have no inverse."""
    rows = rates.filter(F.col("rate").isNotNull() & F.col("rate_date").isNotNull())
    direct = rows.select(F.col("base_currency").alias("base"), F.col("quote_currency").alias("quote"), "rate_date", "rate", "updated_at", F.lit(3).alias("kind"))
    inverse = rows.filter("rate <> 0").select(F.col("quote_currency").alias("base"), F.col("base_currency").alias("quote"), "rate_date", (1.0 / F.col("rate")).alias("rate"), "updated_at", F.lit(2).alias("kind"))
    both = direct.unionByName(inverse)
    return both.groupBy("base", "quote", "rate_date", "kind").agg(F.max_by("rate", F.struct("updated_at", "rate")).alias("rate"))


def as_of(keys: DataFrame, series: DataFrame, by: list[str], at: str, series_at: str, take: list[str], rank: str | None = None) -> DataFrame:
    """Each key with the newest row of the series at or before its date (inclusive): one sort of the union, no range join.

    Of several rows of a date the one with the greatest ``rank`` counts.
    ``keys`` should be distinct; keys without such a row keep NULLs."""
    mark = F.struct(F.col(series_at), *take)
    left = keys.select(*by, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast("long").alias("__rank"), F.lit(None).cast(series.select(mark.alias("m")).schema["m"].dataType).alias("__m"))
    right = series.select(*by, F.col(series_at).alias("__t"), F.lit(0).alias("__side"), (F.col(rank) if rank else F.lit(None)).cast("long").alias("__rank"), mark.alias("__m"))
    w = Window.partitionBy(*by).orderBy("__t", "__side", "__rank").rowsBetween(Window.unboundedPreceding, 0)
    out = left.unionByName(right).withColumn("__m", F.last("__m", ignorenulls=True).over(w)).filter("__side = 1")
    return out.select(*by, F.col("__t").alias(at), F.col(f"__m.{series_at}").alias(series_at), *(F.col(f"__m.{t}").alias(t) for t in take))


def rates_for(keys: DataFrame, rates: DataFrame, stale_days: int = 7) -> DataFrame:
    """The rate of each distinct (``base``, ``quote``, ``on_date``): same currency 1, else the best of all candidates.

    Candidates are direct and inverse rates as of the date, and products of two legs through a pivot, dated by their older leg.
    The best has the newest date, then is statutory before direct before inverse before triangulated, then has the first pivot.
    Legs are the few rates there are; keys are distinct combinations, so that billions of facts share their lookups.
    """
    spark = keys.sparkSession
    # Distinct keys and legs are small against the facts they stand for; both are written once, as several lookups read them.
    keys = materialize(keys.select("base", "quote", "on_date").dropna().distinct(), "rate-keys")
    all_legs = materialize(legs(rates), "legs")
    fixed = spark.createDataFrame([(code, "EUR", rate, start) for code, (rate, start) in STATUTORY_EURO.items()], "base string, quote string, per_euro double, start string")
    fixed = fixed.select("base", "quote", (1.0 / F.col("per_euro")).alias("rate"), F.to_date("start").alias("start"))
    fixed = fixed.unionByName(fixed.select(F.col("quote").alias("base"), F.col("base").alias("quote"), (1.0 / F.col("rate")).alias("rate"), "start"))

    def leg(wanted: DataFrame) -> DataFrame:
        """Best leg of distinct (base, quote, on_date): rate, rate_date, kind."""
        same = wanted.filter("base = quote").select("base", "quote", "on_date", F.lit(1.0).alias("rate"), F.col("on_date").alias("rate_date"), F.lit(5).alias("kind"))
        found = as_of(wanted.filter("base <> quote"), all_legs, ["base", "quote"], "on_date", "rate_date", ["rate", "kind"], "kind").filter("rate IS NOT NULL")
        legal = wanted.join(F.broadcast(fixed), ["base", "quote"]).filter("on_date >= start").select("base", "quote", "on_date", "rate", F.col("on_date").alias("rate_date"), F.lit(4).alias("kind"))
        everything = same.unionByName(found.select(*same.columns)).unionByName(legal)
        best = everything.groupBy("base", "quote", "on_date").agg(F.max_by(F.struct("rate", "rate_date", "kind"), F.struct("rate_date", "kind")).alias("b"))
        return best.select("base", "quote", "on_date", "b.*")

    direct = leg(keys).select("base", "quote", "on_date", "rate", "rate_date", "kind", F.lit(0).alias("pivot_rank"))
    pivots = F.explode(F.array(*(F.struct(F.lit(p).alias("pivot"), F.lit(len(PIVOTS) - i).alias("pivot_rank")) for i, p in enumerate(PIVOTS)))).alias("p")
    through = keys.filter("base <> quote").select("*", pivots).select("base", "quote", "on_date", "p.*").filter("pivot <> base AND pivot <> quote")
    halves = leg(through.select("base", F.col("pivot").alias("quote"), "on_date").unionByName(through.select(F.col("pivot").alias("base"), "quote", "on_date")).distinct())
    first = halves.select("base", F.col("quote").alias("pivot"), "on_date", F.col("rate").alias("r1"), F.col("rate_date").alias("d1"))
    second = halves.select(F.col("base").alias("pivot"), "quote", "on_date", F.col("rate").alias("r2"), F.col("rate_date").alias("d2"))
    tri = through.join(first, ["base", "pivot", "on_date"]).join(second, ["pivot", "quote", "on_date"])
    tri = tri.select("base", "quote", "on_date", (F.col("r1") * F.col("r2")).alias("rate"), F.least("d1", "d2").alias("rate_date"), F.lit(1).alias("kind"), "pivot_rank")
    best = direct.unionByName(tri).groupBy("base", "quote", "on_date").agg(F.max_by(F.struct("rate", "rate_date", "kind"), F.struct("rate_date", "kind", "pivot_rank")).alias("b"))
    return best.select("base", "quote", "on_date", "b.rate", "b.rate_date", "b.kind", (F.datediff("on_date", "b.rate_date") > stale_days).alias("is_stale"))


def convert(df: DataFrame, amount: str, currency: str, on_date: str, target: str, rates: DataFrame) -> DataFrame:
    """``df`` with ``converted`` in the currency of column ``target``; NULL where no rate is known.  Lookups are made once per combination."""
    keys = df.select(F.col(currency).alias("base"), F.col(target).alias("quote"), F.col(on_date).alias("on_date"))
    found = rates_for(keys, rates).select(F.col("base").alias("__b"), F.col("quote").alias("__q"), F.col("on_date").alias("__d"), F.col("rate").alias("fx_rate"))
    out = df.join(found, (F.col(currency) == F.col("__b")) & (F.col(target) == F.col("__q")) & (F.col(on_date) == F.col("__d")), "left").drop("__b", "__q", "__d")
    return out.withColumn("converted", F.when(F.col(currency) == F.col(target), F.col(amount)).otherwise(F.col(amount) * F.col("fx_rate")))
