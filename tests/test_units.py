import pytest
from pyspark.sql import functions as F

from factloom.functions.units import common_unit, parse_currency, parse_quantity, parse_unit, resolve_quantity, resolve_unit, to_common


@pytest.mark.parametrize(
    ("kind", "unit", "currency", "want"),
    [
        ("monetary", None, "EUR", ("EUR", 0)),
        ("monetary", "mn", "GBX", ("GBP", 4)),
        ("monetary", "GBX m", "GBX", ("GBP", 4)),
        ("monetary", "millions of pence", "GBX", ("GBP", 4)),
        ("monetary", "figures in billions of euro", None, ("EUR", 9)),
        ("monetary", "Rs. Cr.", None, ("INR", 7)),
        ("monetary", "TUSD", "usd ", ("USD", 3)),
        ("monetary", "C$000s", "CAD", ("CAD", 3)),
        ("per_share", None, "GBP0.01", ("GBP", -2)),
        ("per_share", "GBp", "GBp", ("GBP", -2)),
        ("per_share", "cents per share", "USD", ("USD", -2)),
        ("per_share", "ZA cents", None, ("ZAR", -2)),
        ("count", "board lots (100 shares)", None, ("shares", 2)),
        ("count", "sharesMln", None, ("shares", 6)),
        ("percent", "basis points", None, ("fraction", -4)),
        ("ratio", "share of one", None, ("fraction", 0)),
        ("multiple", "x", None, ("times", 0)),
        ("per_share", "USD per share (thousands)", None, ("USD", 3)),
        ("per_share", "USD per share, in millions", None, ("USD", 6)),
        ("per_share", "EUR/share in thousands", None, ("EUR", 3)),
        ("per_share", "USD per thousand shares", None, ("USD", -3)),
        ("per_share", "GBX pence per share", "GBX", ("GBP", -2)),
        ("monetary", "(thousands of) USD", None, ("USD", 3)),
        (None, "USD/USD", None, ("fraction", 0)),
        ("count", "USD mn", None, ("USD", 6)),
        (None, "percent", None, ("fraction", -2)),
        (None, "m/s", None, ("metre second^-1", 0)),
        (None, "kg * m^2", None, ("metre^2 gram", 3)),
        ("monetary", ") mn (", "EUR", ("EUR", 6)),
        ("monetary", "", "", (None, 0)),
        (None, None, None, (None, 0)),
    ],
)
def test_common_unit(kind, unit, currency, want):
    got = common_unit(kind, unit, currency)
    assert (got.unit, got.power) == want and (got.factor, got.offset) == (1.0, 0.0)


def test_dimensions_and_offsets():
    assert parse_unit("USD per thousand shares").vector()[:2] == (1, -1)
    assert parse_unit("USD per thousand shares").power == -3
    celsius = parse_unit("celsius")
    assert celsius.offset == 273.15 and celsius.vector()[3] == 1
    assert parse_unit("km / hour").power == 3 and parse_unit("km / hour").factor == pytest.approx(1 / 3600)
    assert parse_unit("blorp").unknown == ("blorp",)
    assert parse_unit("celsius per hour").offset == 0 and parse_unit("thousand shares per celsius").offset == 0
    assert parse_unit("USD/USD").vector() == (0,) * 7 and parse_unit("USD / share / share").vector()[:2] == (1, -2)
    assert (common_unit(None, "half a million USD", None).power, common_unit(None, "half a million USD", None).factor) == (6, 0.5)
    assert common_unit("count", "lots of 50", None).unit == "shares"
    f = common_unit(None, "fahrenheit", None)
    assert f.unit == "kelvin" and 50 * f.factor + f.offset == pytest.approx(283.15)


def test_quantities():
    assert parse_quantity("(1,234.5) mn EUR") == (-1234.5, "mn EUR")
    assert parse_quantity("1.234,5 Tsd. EUR") == (1234.5, "Tsd. EUR")
    assert parse_quantity("1,5") == (1.5, None)
    assert parse_quantity(None) == (None, None)
    assert parse_quantity("n/a")[0] is None


def test_currency_codes():
    assert parse_currency(" gbx ") == ("GBP", True)
    assert parse_currency("gbp") == ("GBP", False)
    assert parse_currency("GBp") == ("GBP", True)
    assert parse_currency("  ") == (None, False)


def test_column(spark):
    rows = [("monetary", "mn", "EUR"), ("monetary", "mn", "EUR"), (None, None, None), ("count", "x" * 100_000, None)]
    df = spark.createDataFrame(rows, "k string, u string, c string")
    out = [tuple(r.r) for r in df.select(resolve_unit("k", "u", "c").alias("r")).collect()]
    assert out == [("EUR", 6, 1.0, 0.0), ("EUR", 6, 1.0, 0.0), (None, 0, 1.0, 0.0), ("shares", 0, 1.0, 0.0)]
    assert df.limit(0).select(resolve_unit("k", "u", "c").alias("r")).count() == 0


def test_quantities_in_texts(spark):
    df = spark.createDataFrame([("(1,234.5) mn EUR",), ("20 celsius",), ("12 pence per share",), ("7",), ("n/a",), (None,)], "t string").select(resolve_quantity("t").alias("q"))
    out = [(r[0], None if r[1] is None else round(r[1], 6)) for r in df.select("q.common_unit", to_common(F.col("q.value"), F.col("q"))).collect()]
    assert out == [("EUR", -1234.5e6), ("kelvin", 293.15), ("GBP", 0.12), (None, 7.0), (None, None), (None, None)]
