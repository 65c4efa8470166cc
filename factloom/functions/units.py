"""Unit expressions: a grammar, dimension exponent vectors, and scale and offset to canonical units.

    expression = { factor }
    factor     = ( "/" | "per" ) operand | "*" operand | operand
    operand    = { scale | number } atom [ "^" exponent ] | "(" expression ")"

``/`` and ``per`` bind the next operand only, so "USD per share (thousands)" is a thousand dollars a share and "USD per thousand
shares" a thousandth.  Each atom carries an exponent vector over ``BASES``, a power of ten, a remaining factor and an offset;
exponents add up.  Two names of one dimension side by side ("GBX pence") are one.  An offset counts only where its unit stands
alone.  ``parse_unit`` never raises: words it does not know are listed in ``Unit.unknown`` and change nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The base dimensions of an exponent vector.
BASES = ("money", "share", "one", "kelvin", "metre", "gram", "second")

#: Powers of ten of scale words (fixed values).
SCALES = {
    "hundred": 2, "hundreds": 2,
    "k": 3, "tsd": 3, "thousand": 3, "thousands": 3, "000": 3, "000s": 3, "ths": 3,
    "lakh": 5, "lakhs": 5, "lac": 5, "lacs": 5,
    "m": 6, "mm": 6, "mn": 6, "mln": 6, "mio": 6, "mil": 6, "million": 6, "millions": 6,
    "cr": 7, "crore": 7, "crores": 7,
    "b": 9, "bn": 9, "bln": 9, "mrd": 9, "md": 9, "billion": 9, "billions": 9, "milliard": 9, "milliards": 9,
    "tn": 12, "trn": 12, "trillion": 12, "trillions": 12,
}

#: Currency codes that a unit text may glue to a scale letter (fixed values).
ISO_CODES = frozenset(
    "AED ARS AUD BGN BRL CAD CHF CLP CNY COP CZK DKK EGP EUR GBP HKD HUF IDR ILS INR ISK JPY KRW KWD MXN MYR NOK NZD "
    "PEN PHP PKR PLN QAR RON RUB SAR SEK SGD THB TRY TWD UAH USD VND ZAR".split()
)
#: Quotation codes of a hundredth of a currency (fixed values).
SUBUNIT_CODES = {"GBX": "GBP", "GBP0.01": "GBP", "ZAC": "ZAR", "ILA": "ILS"}

_SYMBOLS = {"us$": "USD", "c$": "CAD", "a$": "AUD", "hk$": "HKD", "€": "EUR", "£": "GBP", "¥": "JPY", "₹": "INR", "₪": "ILS", "$": "USD"}
_NAMES = {
    "euro": "EUR", "euros": "EUR", "yen": "JPY", "rand": "ZAR", "rands": "ZAR", "rupee": "INR", "rupees": "INR", "rs": "INR",
    "sterling": "GBP", "pound": "GBP", "pounds": "GBP", "shekel": "ILS", "shekels": "ILS", "krona": "SEK", "kronor": "SEK",
    "franc": "CHF", "francs": "CHF", "dollar": "USD", "dollars": "USD",
}
#: An adjective before the name of a currency decides which one is meant.
_ADJECTIVES = {
    ("us", "USD"): "USD", ("canadian", "USD"): "CAD", ("australian", "USD"): "AUD", ("singapore", "USD"): "SGD",
    ("swiss", "CHF"): "CHF", ("swedish", "SEK"): "SEK", ("norwegian", "SEK"): "NOK", ("danish", "SEK"): "DKK",
}
_SUBUNITS = {"gbx": "GBP", "pence": "GBP", "penny": "GBP", "p": "GBP", "zac": "ZAR", "ila": "ILS", "agora": "ILS", "agorot": "ILS", "usc": "USD", "cent": None, "cents": None}
_CENT_OWNERS = {"us": "USD", "za": "ZAR", "euro": "EUR", "canadian": "CAD"}
_SHARES = {"share", "shares", "shs", "sh", "stock", "stocks", "unit", "units"}
_RATIOS = {"percent": -2, "pct": -2, "%": -2, "‰": -3, "permille": -3, "bp": -4, "bps": -4, "fraction": 0, "decimal": 0, "ratio": 0, "times": 0, "x": 0}
#: Physical units: base, power of ten, remaining factor, offset.
_PHYSICAL = {
    "kelvin": ("kelvin", 0, 1.0, 0.0), "celsius": ("kelvin", 0, 1.0, 273.15), "fahrenheit": ("kelvin", 0, 5 / 9, 459.67 * 5 / 9),
    "metre": ("metre", 0, 1.0, 0.0), "metres": ("metre", 0, 1.0, 0.0), "km": ("metre", 3, 1.0, 0.0), "cm": ("metre", -2, 1.0, 0.0),
    "gram": ("gram", 0, 1.0, 0.0), "grams": ("gram", 0, 1.0, 0.0), "kg": ("gram", 3, 1.0, 0.0), "tonne": ("gram", 6, 1.0, 0.0), "tonnes": ("gram", 6, 1.0, 0.0),
    "metres/": ("metre", 0, 1.0, 0.0), "s": ("second", 0, 1.0, 0.0), "hours": ("second", 0, 3600.0, 0.0), "days": ("second", 0, 86400.0, 0.0), "minutes": ("second", 0, 60.0, 0.0),
    "second": ("second", 0, 1.0, 0.0), "seconds": ("second", 0, 1.0, 0.0), "minute": ("second", 0, 60.0, 0.0), "hour": ("second", 0, 3600.0, 0.0), "day": ("second", 0, 86400.0, 0.0),
}
_NOISE = frozenset(
    "a all amount amounts and are as board currency except expressed figures full given in major minor new nearest noted number of "
    "one otherwise quoted reported rounded stated the to unless value values where whole".split()
)

#: Words for numbers.
_NUMBERS = {"half": 0.5, "dozen": 12.0, "dozens": 12.0}
_TOKEN = re.compile(r"us\$|c\$|a\$|hk\$|[€£¥₹₪$%‰/()*·]|\^-?\d+|'?000s?\b|\d+(?:\.\d+)?|[a-zà-ÿ]+", re.IGNORECASE)


@dataclass
class Unit:
    """What a unit text says: value in the canonical unit = (value * factor * 10**power) + offset."""

    dims: dict[str, int] = field(default_factory=dict)
    power: int = 0
    factor: float = 1.0
    offset: float = 0.0
    currency: str | None = None
    subunit: bool = False
    times: bool = False
    unknown: tuple[str, ...] = ()

    def vector(self) -> tuple[int, ...]:
        return tuple(self.dims.get(b, 0) for b in BASES)


def _split(word: str) -> list[str]:
    """A word glued of a currency and a scale, or of shares and a scale, in its parts."""
    upper = word.upper()
    if len(word) == 4 and word[0] in "tTkK" and upper[1:] in ISO_CODES:
        return ["k", word[1:]]
    if len(word) > 3 and upper[:3] in ISO_CODES and word[3:].lower() in SCALES:
        return [word[:3], word[3:]]
    if m := re.fullmatch(r"(shares|shs|units)(\w+)", word, re.IGNORECASE):
        if m[2].lower() in SCALES:
            return [m[1], m[2]]
    return [word]


class _Reader:
    """Recursive descent over the words of a unit text."""

    def __init__(self, words: list[str]) -> None:
        self.words, self.at, self.unit, self.unknown = words, 0, Unit(), []
        self.affine, self.atoms = 0.0, 0

    def peek(self, k: int = 0) -> str:
        return self.words[self.at + k].lstrip("'") if self.at + k < len(self.words) else ""

    def expression(self, sign: int) -> None:
        while self.at < len(self.words) and self.peek() != ")":
            w = self.peek()
            if w in ("/", "per") and not (w == "per" and self.peek(1) == "cent"):
                self.at += 1
                self.operand(-sign)
            elif w in ("*", "·"):
                self.at += 1
                self.operand(sign, product=True)
            elif w == "(":
                self.operand(sign)
            elif not self.scale(sign):
                self.atom(sign)

    def operand(self, sign: int, product: bool = False) -> None:
        """One atom with the scales and numbers before it, or what stands in brackets."""
        while self.at < len(self.words) and self.peek() not in (")", "/", "*", "·"):
            if self.peek() == "(":
                self.at += 1
                self.expression(sign)
                self.at += 1
                return
            if not self.scale(sign) and self.atom(sign, product):
                return

    def scale(self, sign: int) -> bool:
        w, unit = self.peek(), self.unit
        if w == "m" and self.peek(1) in ("/", "per", "*", "·") and self.peek(2) in _PHYSICAL or w[:1] == "m" and self.peek(1)[:1] == "^":
            return False
        if w in SCALES:
            unit.power += sign * SCALES[w]
        elif w == "t" and self.peek(1).upper() in ISO_CODES:
            unit.power += sign * 3
        elif re.fullmatch(r"10+", w):
            unit.power += sign * (len(w) - 1)
        elif w in _NUMBERS or re.fullmatch(r"\d+(\.\d+)?", w):
            number = _NUMBERS.get(w) or float(w)
            unit.factor *= number**sign if number else 1.0
        else:
            return False
        self.at += 1
        return True

    def add(self, base: str, sign: int, product: bool = False) -> None:
        power = int(self.peek()[1:]) if self.peek()[:1] == "^" else 1
        self.at += power != 1 or self.peek()[:1] == "^"
        # Names of one dimension side by side are one name.
        if product or power != 1 or sign < 0 or base not in ("money", "share", "one") or self.unit.dims.get(base, 0) != 1:
            self.unit.dims[base] = self.unit.dims.get(base, 0) + sign * power
        self.atoms += 1

    def atom(self, sign: int, product: bool = False) -> bool:
        """Reads a word; True if it is a unit."""
        unit, w, before, after = self.unit, self.peek(), self.words[self.at - 1] if self.at else "", self.peek(1)
        self.at += 1
        if w == "per":  # per cent
            self.at += 1
            unit.power += sign * -2
            self.add("one", sign, product)
        elif w == "basis" and after in ("point", "points"):
            self.at += 1
            unit.power += sign * -4
            self.add("one", sign, product)
        elif w == "share" and after == "of":  # "share of one"
            return False
        elif w in ("lot", "lots"):
            unit.power += sign * 2
            while self.peek() in ("of", "(", "100", ")", *_SHARES) and self.at < len(self.words):
                self.at += 1
            self.add("share", sign, product)
        elif w in _SYMBOLS or w.upper() in ISO_CODES:
            unit.currency = _SYMBOLS.get(w) or w.upper()
            self.add("money", sign, product)
        elif w in _SUBUNITS:
            unit.currency = _SUBUNITS[w] or _CENT_OWNERS.get(before, unit.currency)
            if not unit.subunit:
                unit.power += sign * -2
            unit.subunit = True
            self.add("money", sign, product)
        elif w in _SHARES:
            self.add("share", sign, product)
        elif w in _RATIOS:
            unit.power += sign * _RATIOS[w]
            unit.times |= w in ("x", "times")
            self.add("one", sign, product)
        elif w in _CENT_OWNERS and after in ("cent", "cents"):
            return False
        elif w in _NAMES:
            unit.currency = _ADJECTIVES.get((before, _NAMES[w]), _NAMES[w])
            self.add("money", sign, product)
        elif w in _PHYSICAL or w == "m":
            base, power, factor, offset = _PHYSICAL["metre" if w == "m" else w]
            times = int(self.peek()[1:]) if self.peek()[:1] == "^" else 1
            unit.power += sign * times * power
            unit.factor *= factor ** (sign * times)
            self.affine = offset if sign * times == 1 else 0.0
            self.add(base, sign, product)
        else:
            if w not in _NOISE and w != ")" and not any(w == a for a, _ in _ADJECTIVES):
                self.unknown.append(w)
            return False
        return True


@lru_cache(maxsize=65536)
def parse_unit(text: str | None) -> Unit:
    """Reads a unit text; NULL and blank texts give the empty unit (power 0, no dimension)."""
    if text is None or not text.strip():
        return Unit()
    raw = re.sub(r"(?i)GBP\s*0\.01", "GBX", text)
    words: list[str] = []
    for token in _TOKEN.findall(raw):
        words += ["gbx"] if token == "GBp" else [w.lower() for w in _split(token)]
    reader = _Reader(words)
    while reader.at < len(words):
        reader.expression(1)
        reader.at += 1  # a bracket that closes nothing
    reader.unit.unknown = tuple(reader.unknown)
    reader.unit.offset = reader.affine if reader.atoms == 1 else 0.0
    return reader.unit


@lru_cache(maxsize=65536)
def parse_currency(code: str | None) -> tuple[str | None, bool]:
    """The major code of a recorded currency, and whether the record is in its hundredth.

    ``GBp`` (written so) is pence; every other code is read trimmed and in upper case.  Blank gives (None, False)."""
    code = (code or "").strip()
    if not code:
        return None, False
    if code == "GBp":
        return "GBP", True
    code = code.upper()
    return SUBUNIT_CODES.get(code, code), code in SUBUNIT_CODES


@dataclass(frozen=True)
class Common:
    """How a record becomes common: value * 10**power * factor + offset, in ``unit`` (None: unknown)."""

    unit: str | None
    power: int = 0
    factor: float = 1.0
    offset: float = 0.0


@lru_cache(maxsize=262144)
def common_unit(kind: str | None, unit: str | None, currency: str | None) -> Common:
    """The common unit of a record and how its value gets there.

    The exponent vector of the unit text decides what is measured; ``kind`` decides where the text names no dimension, and between
    fractions and times.  A currency named by the unit text decides about the subunit, else the currency column does; a hundredth
    counts once.  A record that names no dimension and no kind is taken as money if it has a currency, else its unit is None.
    """
    u = parse_unit(unit)
    major, sub = parse_currency(currency)
    dims = {b: n for b, n in u.dims.items() if n}
    if not dims and not u.dims:
        dims = {"monetary": {"money": 1}, "per_share": {"money": 1, "share": -1}, "count": {"share": 1}, "ratio": {"one": 1}, "percent": {"one": 1}, "multiple": {"one": 1}}.get(kind or "", {"money": 1} if major else {})
    if not dims:
        # All dimensions cancel, as in USD/USD, or none is known.
        name = ("times" if kind == "multiple" else "fraction") if u.dims else None
        return Common(name, u.power, u.factor, u.offset)
    if dims == {"share": -1} and kind == "per_share":  # "per share (thousands)": the money is only in the other columns
        dims = {"money": 1, "share": -1}
    if dims.get("money") == 1 and set(dims) <= {"money", "share"} and dims.get("share", -1) in (-1, 1):
        # A multiple of money and shares is no known measure but for the recorded kind.
        power = u.power - 2 if sub and not u.subunit and u.currency is None else u.power
        return Common(major or u.currency, power, u.factor, u.offset)
    if dims == {"share": 1}:
        return Common("shares", u.power, u.factor, u.offset)
    if set(dims) == {"one"}:
        times = kind == "multiple" or (kind not in ("ratio", "percent") and u.times)
        return Common("times" if times else "fraction", u.power, u.factor, u.offset)
    return Common(" ".join(f"{b}^{n}" if n != 1 else b for b, n in ((b, dims.get(b, 0)) for b in BASES) if n), u.power, u.factor, u.offset)


_NUMBER = re.compile(r"^\s*(\()?\s*([-+−]?)\s*(\d{1,3}(?:[ ,.' ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?)(?:[eE]([-+]?\d+))?\s*(\))?(.*)$", re.DOTALL)


@lru_cache(maxsize=65536)
def parse_quantity(text: str | None) -> tuple[float | None, str | None]:
    """A number and the rest of the text, which is its unit: ``"(1,234.5) mn EUR"`` gives (-1234.5, "mn EUR").

    The last of two different separators is the decimal one; a single comma before exactly three digits groups."""
    m = _NUMBER.match(text or "")
    if not m:
        return None, (text or "").strip() or None
    digits = re.sub(r"[ ' ]", "", m[3])
    comma, dot = digits.rfind(","), digits.rfind(".")
    if comma >= 0 and dot >= 0:
        digits = digits.replace("," if dot > comma else ".", "").replace(",", ".")
    elif comma >= 0:
        digits = digits.replace(",", "") if re.fullmatch(r"\d{1,3}(,\d{3})+", digits) else digits.replace(",", ".")
    elif digits.count(".") > 1:
        digits = digits.replace(".", "")
    value = float(digits + (f"e{m[4]}" if m[4] else ""))
    negative = (m[2] in ("-", "−")) != bool(m[1] and m[5])
    return -value if negative else value, m[6].strip() or None


_RESULT = T.StructType([T.StructField("common_unit", T.StringType()), T.StructField("power_of_ten", T.LongType()), T.StructField("factor", T.DoubleType()), T.StructField("offset", T.DoubleType())])


def _frame(read: list[Common]) -> pd.DataFrame:
    return pd.DataFrame(
        {"common_unit": pd.Series([r.unit for r in read], dtype=object), "power_of_ten": pd.Series([r.power for r in read], dtype="int64"), "factor": pd.Series([r.factor for r in read], dtype="float64"), "offset": pd.Series([r.offset for r in read], dtype="float64")}
    )


def resolve_unit(kind: Column | str, unit: Column | str, currency: Column | str) -> Column:
    """Struct(common_unit, power_of_ten, factor, offset) of each row.

    An Arrow-batched UDF that parses each different combination of a batch once; rows stay where they are (no shuffle)."""

    @F.pandas_udf(_RESULT)
    def parse(kinds: pd.Series, units: pd.Series, currencies: pd.Series) -> pd.DataFrame:
        keys = pd.MultiIndex.from_arrays([kinds, units, currencies])
        codes, uniques = pd.factorize(keys)
        blank = lambda x: None if pd.isna(x) else x
        return _frame([common_unit(*map(blank, k)) for k in uniques]).take(codes).reset_index(drop=True)

    return parse(*(F.col(c) if isinstance(c, str) else c for c in (kind, unit, currency)))


def to_common(value: Column, u: Column) -> Column:
    """A recorded value in its common unit, by the result of ``resolve_unit``; as exact as the powers of ten allow."""
    power = u["power_of_ten"]
    # Dividing by 10**n is exact where multiplying by 10**-n is not.
    scaled = F.when(power < 0, value / F.pow(F.lit(10.0), -power)).otherwise(value * F.pow(F.lit(10.0), power))
    return F.when((u["factor"] == 1.0) & (u["offset"] == 0.0), scaled).otherwise(scaled * u["factor"] + u["offset"])


_QUANTITY = T.StructType([T.StructField("value", T.DoubleType()), *_RESULT.fields])


def resolve_quantity(text: Column | str, kind: Column | None = None, currency: Column | None = None) -> Column:
    """Struct(value, common_unit, power_of_ten, factor, offset) of texts that hold a number and its unit ("(1,234.5) mn EUR").

    ``value`` is the number as recorded, ``to_common`` of it and of the struct the value in the common unit.  A text without a
    number has a NULL value; a NULL text is NULL throughout but for the power (0) and factor (1)."""

    @F.pandas_udf(_QUANTITY)
    def parse(texts: pd.Series, kinds: pd.Series, currencies: pd.Series) -> pd.DataFrame:
        blank = lambda x: None if pd.isna(x) else x
        values, read = [], []
        for t, k, c in zip(texts, kinds, currencies, strict=True):
            value, unit = parse_quantity(blank(t))
            values.append(value)
            read.append(common_unit(blank(k), unit, blank(c)))
        out = _frame(read)
        out.insert(0, "value", pd.Series(values, dtype="float64"))
        return out

    none = F.lit(None).cast("string")
    return parse(F.col(text) if isinstance(text, str) else text, kind if kind is not None else none, currency if currency is not None else none)
