"""Building blocks of metrics: values with dates, windows of a year and series by year, over arrays of a listing's facts.

An array of facts is ordered newest first and holds structs (d date, v double); a series holds (y year, d, v), one per year.
A value is a struct (v, d) or NULL.  All are JVM expressions; a listing's facts never leave its row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.operators.facts import HALF_GAP, MAX_AGE, MAX_AGE_FY, QUARTER_GAP


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x bound once: however often f names it, the plan holds it one time."""
    return F.get(F.transform(F.array(x), lambda bound: f(bound)), F.lit(0))


def val(v: Column, d: Column, where: Column | None = None) -> Column:
    """A value; NULL if its number is NULL or the condition doesn't hold."""
    pair = F.struct(v.cast("double").alias("v"), d.alias("d"))
    if where is not None:
        pair = F.when(where, pair)
    return let(pair, lambda p: F.when(p["v"].isNotNull(), p))


def both(a: Column, b: Column, f: Callable[[Column, Column], Column], where: Callable[[Column, Column], Column] | None = None) -> Column:
    """A value from two, dated by the later; NULL unless both are there."""

    def pair(p: Column) -> Column:
        x, y = p["a"], p["b"]
        ok = x["v"].isNotNull() & y["v"].isNotNull()
        return F.when(ok & (where(x["v"], y["v"]) if where else F.lit(True)), F.struct(f(x["v"], y["v"]).alias("v"), F.greatest(x["d"], y["d"]).alias("d")))

    return let(let(F.struct(a.alias("a"), b.alias("b")), pair), lambda p: F.when(p["v"].isNotNull(), p))


def ratio(a: Column, b: Column, where: Callable[[Column, Column], Column] | None = None) -> Column:
    ok = (lambda x, y: (y != 0) & where(x, y)) if where else (lambda _, y: y != 0)
    return both(a, b, F.try_divide, ok)


def fresh(x: Column, ref: Column, days: int = MAX_AGE) -> Column:
    return let(x, lambda p: F.when(p["d"] >= F.date_sub(ref, days), p))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x["v"])


def at(a: Column, date: Column) -> Column:
    """The number of an array at a date."""
    return F.get(F.filter(a, lambda x: x["d"] == date), F.lit(0))["v"]


def window(q: Column, y: Column, ref: Column, annual: bool, max_age: int = MAX_AGE) -> Column:
    """The newest window of twelve months: struct (v, d, cadence, rows), or NULL.  ``q`` and ``y`` are columns."""
    gap = lambda i: F.datediff(F.get(q, F.lit(i))["d"], F.get(q, F.lit(i + 1))["d"])
    quarter = lambda i: F.coalesce(gap(i).between(*QUARTER_GAP), F.lit(False))
    half = lambda i: F.coalesce(gap(i).between(*HALF_GAP), F.lit(False))
    n, newest = F.size(q), F.get(q, F.lit(0))["d"]
    usable = (n >= 2) & (newest >= F.date_sub(ref, max_age))
    year_ok = (F.get(y, F.lit(0))["d"] >= F.date_sub(ref, MAX_AGE_FY)) if annual else F.lit(False)
    choice = (
        F.when(usable & (n >= 4) & quarter(0) & quarter(1) & quarter(2), F.struct(F.lit("quarterly").alias("cadence"), F.slice(q, 1, 4).alias("rows")))
        .when(usable & half(0) & ((n == 2) | half(1)), F.struct(F.lit("semi_annual").alias("cadence"), F.slice(q, 1, 2).alias("rows")))
        .when(year_ok, F.struct(F.lit("annual").alias("cadence"), F.slice(y, 1, 1).alias("rows")))
    )
    return let(choice, lambda c: F.when(c.isNotNull(), F.struct(total(c["rows"]).alias("v"), F.get(c["rows"], F.lit(0))["d"].alias("d"), c["cadence"].alias("cadence"), c["rows"].alias("rows"))))


def over_window(w: Column, q: Column, y: Column) -> Column:
    """The sum of another concept over the dates of a window; NULL if one is missing."""
    source = F.when(w["cadence"] == "annual", y).otherwise(q)
    values = F.transform(w["rows"], lambda r: at(source, r["d"]))
    return sum_if_whole(values)


def sum_if_whole(values: Column) -> Column:
    """The sum of an array of numbers; NULL if one is missing."""
    return let(values, lambda vs: F.when(F.forall(vs, lambda v: v.isNotNull()), F.aggregate(vs, F.lit(0.0), lambda s, v: s + v)))


def yearly(y: Column, newest: bool = True) -> Column:
    """Facts of fiscal years as a series: the newest (or oldest) of each calendar year."""
    step = -1 if newest else 1
    edge = lambda x, i: F.coalesce(F.year(F.when(i + step >= 0, F.get(y, i + step))["d"]) != F.year(x["d"]), F.lit(True))
    return F.transform(F.filter(y, edge), lambda x: F.struct(F.year(x["d"]).alias("y"), x["d"].alias("d"), x["v"].alias("v")))


def in_year(s: Column, year: Column) -> Column:
    return F.get(F.filter(s, lambda x: x["y"] == year), F.lit(0))["v"]


def combined(s: Column, *others: Column, f: Callable[..., Column]) -> Column:
    """A series from several: f of the numbers of a year, where it isn't NULL; missing numbers are NULL."""

    def rows(p: Column) -> Column:
        made = F.transform(p["s"], lambda x: F.struct(x["y"].alias("y"), x["d"].alias("d"), f(x["v"], *(in_year(p[f"o{i}"], x["y"]) for i in range(len(others)))).alias("v")))
        return F.filter(made, lambda x: x["v"].isNotNull())

    return let(F.struct(s.alias("s"), *(o.alias(f"o{i}") for i, o in enumerate(others))), rows)


def either(a: Column, b: Column, key: str) -> Column:
    """The rows of ``a``, and of ``b`` those of a year (key y) or date (key d) that ``a`` has not; newest first."""
    both = F.struct(a.alias("a"), b.alias("b"))
    return let(both, lambda p: F.sort_array(F.concat(p["a"], F.filter(p["b"], lambda x: ~F.exists(p["a"], lambda z: z[key] == x[key]))), False))


def shifted(s: Column, f: Callable[[Column, Column], Column], years: int = 1) -> Column:
    """A series of f of a year's number and that of some years before."""
    return let(s, lambda p: combined(p, F.transform(p, lambda x: F.struct((x["y"] + years).alias("y"), x["d"].alias("d"), x["v"].alias("v"))), f=f))


def strict(s: Column, n: int, ref: Column) -> Column:
    """The newest ``n`` years, if none is missing and the newest is fresh; else NULL."""
    whole = lambda p: (F.get(p, F.lit(n - 1))["y"] == F.get(p, F.lit(0))["y"] - (n - 1)) & (F.get(p, F.lit(0))["d"] >= F.date_sub(ref, MAX_AGE_FY))
    return let(s, lambda p: F.when(whole(p), F.slice(p, 1, n)))


def chain(s: Column, most: int, least: int, ref: Column) -> Column:
    """The unbroken years from the newest on, at most ``most``; NULL under ``least`` or if not fresh."""
    rows = let(s, lambda p: F.filter(F.slice(p, 1, most), lambda x, i: x["y"] == F.get(p, F.lit(0))["y"] - i))
    return let(rows, lambda p: F.when((F.size(p) >= least) & (F.get(p, F.lit(0))["d"] >= F.date_sub(ref, MAX_AGE_FY)), p))


def newest_n(s: Column, n: int, ref: Column, exact: bool = True) -> Column:
    """The ``n`` newest rows, fresh; all of them must be there unless not ``exact``."""
    return let(s, lambda p: F.when((F.size(p) >= (n if exact else 1)) & (F.get(p, F.lit(0))["d"] >= F.date_sub(ref, MAX_AGE_FY)), F.slice(p, 1, n)))


def summary(s: Column, f: Callable[[Column], Column]) -> Column:
    """A value: f of the rows of a series, dated by the newest."""
    return let(s, lambda p: val(f(p), F.get(p, F.lit(0))["d"]))


def numbers(s: Column) -> Column:
    return F.transform(s, lambda x: x["v"])


def mean_of(s: Column) -> Column:
    return let(s, lambda p: F.when(F.size(p) > 0, total(p) / F.size(p)))


def median_of(s: Column) -> Column:
    middle = lambda v: (F.get(v, F.floor((F.size(v) - 1) / 2).cast("int")) + F.get(v, F.floor(F.size(v) / 2).cast("int"))) / 2
    return let(F.sort_array(numbers(s)), lambda v: F.when(F.size(v) > 0, middle(v)))


def least_of(s: Column) -> Column:
    return F.array_min(numbers(s))


def spread_of(s: Column) -> Column:
    """Population standard deviation."""
    squares = lambda v, m: F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(v)
    return let(numbers(s), lambda v: let(F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / F.size(v), lambda m: F.when(F.size(v) > 0, F.sqrt(squares(v, m)))))


def count_of(s: Column, holds: Callable[[Column], Column]) -> Column:
    return F.when(s.isNotNull(), F.size(F.filter(s, lambda x: holds(x["v"]))))


def year_pair(q: Column, y: Column, ref: Column, f: Callable[[Column, Column], Column], years: int = 1) -> Column:
    """f of the newest quarter and the same quarter some calendar years earlier, else of the newest fiscal year and that one."""
    def pair(a: Column, days: int, same_period: bool) -> Column:
        def of(p: Column) -> Column:
            first = F.get(p, F.lit(0))
            match = lambda x: (F.year(x["d"]) == F.year(first["d"]) - years) & ((x["p"] == first["p"]) if same_period else F.lit(True))
            return let(F.get(F.filter(p, match), F.lit(0)), lambda e: val(f(first["v"], e["v"]), first["d"], e.isNotNull() & (first["d"] >= F.date_sub(ref, days))))

        return let(a, of)

    return F.coalesce(pair(q, MAX_AGE, True), pair(y, MAX_AGE_FY, False))
