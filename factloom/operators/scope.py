"""Scopes of listings, neighbourhoods of identifiers, nearest rows, guards and slices: relational operators around the facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import exchange_part, symbol_part
from factloom.operators.materialize import discard, materialize


def in_scope(listings: DataFrame, symbols: list[str] | None = None, exchanges: list[str] | None = None) -> DataFrame:
    """Listings of some symbols (``TICKER.EXCHANGE``), of some exchanges, or all; both at once is an error.

    ``listings`` has symbol, exchange and status; secondary ones are never in scope (unknown ones are)."""
    if symbols and exchanges:
        raise ValueError("a scope is given by symbols or by exchanges")
    rows = listings.filter(F.coalesce(F.col("status"), F.lit("unknown")) != "secondary")
    if symbols:
        wanted = [(s.upper().rpartition(".")[0], s.upper().rpartition(".")[2]) for s in symbols]
        return rows.filter(F.struct("symbol", "exchange").isin(*(F.struct(F.lit(a), F.lit(b)) for a, b in wanted)))
    return rows.filter(F.col("exchange").isin(*(e.upper() for e in exchanges))) if exchanges else rows


def missing_symbols(listings: DataFrame, symbols: DataFrame, symbol: str) -> DataFrame:
    """The requested symbols that no listing in scope has."""
    asked = symbols.select(F.upper(F.trim(symbol)).alias(symbol)).distinct()
    known = in_scope(listings).select(F.col("symbol").alias("__s"), F.col("exchange").alias("__e"))
    return asked.join(known, (symbol_part(symbol) == F.col("__s")) & (exchange_part(symbol) == F.col("__e")), "left_anti")


def nearest_row(left: DataFrame, right: DataFrame, by: list[str], left_date: str, right_date: str, days: int, take: list[str]) -> DataFrame:
    """Each left row with the right row of its key nearest in time, at most ``days`` away; ties go to the one on or before.

    Both sides go through one sort of their union by key: the newest right row on or before and the oldest after are carried to
    every left row, so no range join multiplies rows.  Right rows should be unique by key and date.  Left rows without one in
    reach are left out; names in ``take`` and ``right_date`` must not occur on the left."""
    mark = F.struct(F.col(right_date), *(F.col(t) for t in take))
    kind = right.select(mark.alias("m")).schema["m"].dataType
    lefts = left.select(F.struct(*left.columns).alias("__row"), *by, F.col(left_date).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__m"))
    rights = right.select(F.lit(None).cast(left.select(F.struct(*left.columns).alias("r")).schema["r"].dataType).alias("__row"), *by, F.col(right_date).alias("__t"), F.lit(0).alias("__side"), mark.alias("__m"))
    w = Window.partitionBy(*by).orderBy("__t", "__side")
    both = lefts.unionByName(rights)
    both = both.withColumn("__b", F.last("__m", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__a", F.first("__m", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    back, ahead = F.datediff("__t", F.col("__b")[right_date]), F.datediff(F.col("__a")[right_date], "__t")
    chosen = F.when((back <= days) & (ahead.isNull() | (back <= ahead)), F.col("__b")).when(ahead <= days, F.col("__a"))
    found = both.filter("__side = 1").withColumn("__c", chosen).filter(F.col("__c").isNotNull())
    return found.select("__row.*", F.col("__c")[right_date].alias(right_date), *(F.col("__c")[t].alias(t) for t in take))


def neighbourhood(start: DataFrame, node: str, held: DataFrame, rounds: int = 8) -> DataFrame:
    """The nodes reached from ``start`` over shared values in at most ``rounds`` steps: semi-joins of a growing frontier.

    ``held`` has ``node``, kind and value.  Ends early when a round adds nothing."""
    held = materialize(held.select(node, "kind", "value").dropna().distinct(), "held")
    reached = materialize(start.select(node).distinct(), "reached")
    count = reached.count()
    for _ in range(rounds):
        values = held.join(reached, node, "left_semi").select("kind", "value").distinct()
        more = materialize(reached.union(held.join(values, ["kind", "value"], "left_semi").select(node)).distinct(), "reached")
        grown = more.count()
        discard(reached)
        reached = more
        if grown == count:
            break
        count = grown
    return reached


def without_quarantined(facts: DataFrame, quarantined: DataFrame, keys: list[str]) -> DataFrame:
    """Facts without those of quarantined keys and dates."""
    return facts.join(quarantined.select(*keys).distinct(), keys, "left_anti")


def violations_of_kind(facts: DataFrame) -> DataFrame:
    """Facts whose kind and currency contradict each other: money without a code, or another kind with one."""
    money = F.col("unit_kind").isin("monetary", "per_share")
    return facts.filter((money & F.col("currency").isNull()) | (~money & F.col("currency").isNotNull()))


def single_currency_sum(df: DataFrame, by: list[str], amount: str, currency: str) -> DataFrame:
    """``total`` and ``currency`` of each group; both NULL where currencies differ or an amount has none."""
    one = (F.min(currency) == F.max(currency)) & (F.count(currency) == F.count(amount))
    return df.filter(F.col(amount).isNotNull()).groupBy(*by).agg(F.when(one, F.sum(amount)).alias("total"), F.when(one, F.min(currency)).alias("currency"))


def share_of_removals(old: DataFrame, new: DataFrame, keys: list[str], slice_by: list[str], least: int = 20, share: float = 0.5) -> DataFrame:
    """By slice: rows before, rows that are gone, and whether that is a mass removal (``least`` or more, and over ``share``)."""
    marked = old.select(*slice_by, *keys).distinct().withColumn("__old", F.lit(1)).join(new.select(*slice_by, *keys).distinct().withColumn("__new", F.lit(1)), [*slice_by, *keys], "left")
    out = marked.groupBy(*slice_by).agg(F.count("*").alias("before"), F.count_if(F.col("__new").isNull()).alias("removed"))
    return out.withColumn("refused", (F.col("removed") >= least) & (F.col("removed") > share * F.col("before")))


def replaced_slice(old: DataFrame, new: DataFrame, slice_by: list[str]) -> DataFrame:
    """``old`` with every slice that ``new`` has replaced as a whole."""
    return old.join(new.select(*slice_by).distinct(), slice_by, "left_anti").unionByName(new)


def table_profile(df: DataFrame) -> DataFrame:
    """A row per column: its type, how many values it has, how many are NULL, and how many differ (within five percent)."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    stats = df.agg(*(F.struct(F.count("*").alias("n"), F.count(c).alias("v")).alias(c) for c in df.columns))
    cells = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.col(c)["n"].alias("rows"), (F.col(c)["n"] - F.col(c)["v"]).alias("nulls")) for c in df.columns))
    return stats.select(F.inline(cells))


def quotes_from_json(df: DataFrame, text: str) -> DataFrame:
    """Quotes of a JSON list in a text column: ``code``, ``day``, ``price`` (the first of several keys that is a number above 0).

    Entries without code, day or price are skipped; texts that are no JSON lists give nothing."""
    entries = df.select(F.explode(F.from_json(text, "array<map<string,string>>")).alias("e"))
    low = entries.select(F.map_from_entries(F.array_distinct(F.transform(F.map_entries("e"), lambda x: F.struct(F.lower(x["key"]).alias("key"), x["value"].alias("value"))))).alias("e"))
    number = lambda k: F.col("e")[k].try_cast("double")
    price = F.coalesce(*(F.when(number(k) > 0, number(k)) for k in ("close", "adjusted_close", "previousclose", "price")))
    return low.select(F.coalesce(F.col("e")["code"], F.col("e")["symbol"]).alias("code"), F.try_to_date(F.substring(F.coalesce(F.col("e")["date"], F.col("e")["timestamp"]), 1, 10), "yyyy-MM-dd").alias("day"), price.alias("price")).dropna()


def write_csv(df: DataFrame, path: str, columns: list[str], header: bool = True) -> None:
    """A report as CSV in a fixed order of columns, one file."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", header).csv(path)


def outer_ranges(wanted: DataFrame, stored: DataFrame, by: list[str]) -> DataFrame:
    """What is still to fetch: of each wanted range (``first``, ``last``) the part before and the part after what is stored.

    Gaps inside stored ranges are not refetched.  A key with nothing stored gives its whole range."""
    have = stored.select(*by, F.col("first").alias("__f"), F.col("last").alias("__l"))
    rows = wanted.join(have, by, "left")
    whole = F.when(F.col("__f").isNull(), F.struct("first", "last"))
    before = F.when(F.col("first") < F.col("__f"), F.struct(F.col("first"), F.least(F.col("last"), F.date_sub("__f", 1)).alias("last")))
    after = F.when(F.col("last") > F.col("__l"), F.struct(F.greatest(F.col("first"), F.date_add("__l", 1)).alias("first"), F.col("last")))
    return rows.select(*by, F.explode(F.array_compact(F.array(whole, before, after))).alias("r")).select(*by, "r.first", "r.last")


def first_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of a report in its order."""
    return df.orderBy(*order).limit(n)
