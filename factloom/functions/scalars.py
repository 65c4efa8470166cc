"""Scalar functions as Column expressions; none of them raises, bad input gives NULL."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.functions.units import SUBUNIT_CODES

_OUTER = r"(?U)^\s+|\s+$"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trimmed(c: Column | str) -> Column:
    """Without outer white space of any kind; a blank text is NULL."""
    out = F.regexp_replace(_c(c).cast("string"), _OUTER, "")
    return F.when(out != "", out)


def to_number(c: Column | str) -> Column:
    """A number, also from text with grouping commas."""
    return F.regexp_replace(trimmed(c), ",", "").try_cast("double")


def currency_code(c: Column | str) -> Column:
    """Trimmed, in upper case, hundredths as their major currency."""
    code = F.upper(trimmed(c))
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SUBUNIT_CODES.items() for x in pair))[code], code)


def is_subunit(c: Column | str) -> Column:
    return F.coalesce(F.upper(trimmed(c)).isin(*SUBUNIT_CODES) | (trimmed(c) == "GBp"), F.lit(False))


def shaped_currency(c: Column | str) -> Column:
    """The code if it has three capitals."""
    code = currency_code(c)
    return F.when(code.rlike("^[A-Z]{3}$"), code)


def major_amount(amount: Column | str, code: Column | str) -> Column:
    """An amount recorded in hundredths, divided once."""
    return F.when(is_subunit(code), _c(amount) / 100.0).otherwise(_c(amount))


def is_monetary(kind: Column | str) -> Column:
    return _c(kind).isin("monetary", "per_share")


def merged_currency(*codes: Column | str) -> Column:
    """The one currency all given codes agree on; NULL if they differ or none is given."""
    found = F.array_distinct(F.array_compact(F.array(*(currency_code(c) for c in codes))))
    return F.when(F.size(found) == 1, F.get(found, 0))


def resolved_currency(*codes: Column | str) -> Column:
    """The first code that has the right shape."""
    return F.coalesce(*(shaped_currency(c) for c in codes))


def shaped_isin(c: Column | str) -> Column:
    code = F.upper(trimmed(c))
    return F.when(code.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$"), code)


def shaped_lei(c: Column | str) -> Column:
    code = F.upper(trimmed(c))
    return F.when(code.rlike("^[A-Z0-9]{20}$"), code)


def symbol_part(symbol: Column | str) -> Column:
    """Before the last dot."""
    return F.when(F.upper(trimmed(symbol)).rlike(r"\."), F.regexp_extract(F.upper(trimmed(symbol)), r"^(.*)\.([^.]+)$", 1)).otherwise(F.upper(trimmed(symbol)))


def exchange_part(symbol: Column | str) -> Column:
    """After the last dot; NULL without one."""
    out = F.regexp_extract(F.upper(trimmed(symbol)), r"^(.*)\.([^.]+)$", 2)
    return F.when(out != "", out)


def iso_date(c: Column | str) -> Column:
    """A date from the first 10 characters."""
    return F.try_to_date(F.substring(_c(c).cast("string"), 1, 10), "yyyy-MM-dd")


def quarter_label(period: Column | str, end: Column | str) -> Column:
    """An explicit Q1-Q4, else by the month of the end date."""
    given = F.upper(trimmed(period))
    return F.when(given.rlike("^Q[1-4]$"), given).otherwise(F.concat(F.lit("Q"), F.quarter(_c(end)).cast("string")))


def clamp(c: Column | str, low: float, high: float) -> Column:
    """Between two bounds; NULL stays NULL (least and greatest would skip it)."""
    return F.when(_c(c).isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), _c(c))))


def backoff_seconds(attempts: Column | str, first: float = 3600.0, most: float = 86400.0) -> Column:
    return F.when(_c(attempts) >= 1, F.least(F.lit(first) * F.pow(F.lit(2.0), _c(attempts) - 1), F.lit(most)))


def content_hash(c: Column | str) -> Column:
    return F.sha2(_c(c), 256)


def canonical_json(c: Column | str) -> Column:
    """JSON with sorted keys, no blanks and plain characters, so that equal records have equal texts; NULL where it isn't valid.

    An Arrow-batched UDF: key order can't be changed by built-in expressions without a schema."""

    @F.pandas_udf("string")
    def dump(texts: pd.Series) -> pd.Series:
        def one(text: str | None) -> str | None:
            try:
                return None if text is None else json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=True)
            except ValueError:
                return None

        return texts.map(one)

    return dump(_c(c))


def display_number(c: Column | str, digits: int = 2) -> Column:
    """A number for a report: grouped, with some digits; text "N/A" where there is none."""
    return F.when(_c(c).isNotNull() & ~F.isnan(_c(c).cast("double")), F.format_number(_c(c).cast("double"), digits)).otherwise("N/A")


def shortened(c: Column | str, most: int) -> Column:
    """A text of at most ``most`` characters, the last three of them dots where it was longer."""
    return F.when(F.length(_c(c)) > most, F.concat(F.substring(_c(c), 1, most - 3), F.lit("..."))).otherwise(_c(c))


def money(amount: Column | str, currency: Column | str) -> Column:
    """An amount with its currency, in whole units of the major one."""
    return F.struct(major_amount(amount, currency).alias("amount"), currency_code(currency).alias("currency"))


def money_math(a: Column, b: Column, operation: str) -> Column:
    """Two amounts of ``money``: "+" and "-" give money, "/" a number, "<", "<=", ">", ">=" and "==" a boolean.

    NULL where the currencies differ, an amount is missing, or the divisor is 0."""
    same = a["currency"] == b["currency"]
    x, y = a["amount"], b["amount"]
    if operation in ("+", "-"):
        out = F.struct((x + y if operation == "+" else x - y).alias("amount"), a["currency"].alias("currency"))
        return F.when(same & x.isNotNull() & y.isNotNull(), out)
    out = {"/": lambda: F.try_divide(x, y), "<": lambda: x < y, "<=": lambda: x <= y, ">": lambda: x > y, ">=": lambda: x >= y, "==": lambda: x == y}[operation]()
    return F.when(same, out)


def reason_template(c: Column | str) -> Column:
    """A message without what differs from case to case: symbols, dates, numbers."""
    out = F.regexp_replace(_c(c), r"\b[A-Z0-9][A-Z0-9-]*\.[A-Z]{2,5}\b", "<symbol>")
    out = F.regexp_replace(out, r"\d{4}-\d{2}-\d{2}", "<date>")
    return F.regexp_replace(out, r"-?\d+(\.\d+)?", "<n>")


def fx_pair_kind(symbol: Column | str) -> Column:
    """pair (six letters), usd_alias (three) or none of a rate catalogue's symbol."""
    code = F.upper(trimmed(symbol))
    return F.when(code.rlike("^[A-Z]{6}$"), "pair").when(code.rlike("^[A-Z]{3}$"), "usd_alias").otherwise("none")


def redacted(c: Column | str) -> Column:
    """A URL without the value of its token."""
    return F.regexp_replace(_c(c), r"(?i)(api_?token|token|key)=[^&\s]+", "$1=***")
