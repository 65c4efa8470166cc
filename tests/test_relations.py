import random
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import scope as R
from factloom.operators.materialize import broadcast_if_small, discard, materialize
from factloom.operators.universe import claim_representatives, classify, group_issuers, newest_identities, rescue_sole_listings
from factloom.plans.screen import align, aligned_input, load_screen, parse_screen, rank_inputs, run_screen, screen_details
from factloom.settings import Settings, load_settings

D = date


def test_scope(spark):
    df = spark.createDataFrame([(1, "A", "US", "primary"), (2, "B", "US", "secondary"), (3, "C.D", "LSE", None)], "listing_id long, symbol string, exchange string, status string")
    ids = lambda x: sorted(r.listing_id for r in x.collect())
    assert ids(R.in_scope(df)) == [1, 3] and ids(R.in_scope(df, symbols=["c.d.lse", "b.us"])) == [3] and ids(R.in_scope(df, exchanges=["us"])) == [1]
    with pytest.raises(ValueError):
        R.in_scope(df, ["A.US"], ["US"])
    asked = spark.createDataFrame([("a.us",), ("B.US",), ("nodot",), (None,)], "s string")
    assert {r.s for r in R.missing_symbols(df, asked, "s").collect()} == {"B.US", "NODOT", None}


def test_nearest_row(spark):
    rng = random.Random(1)
    left = [(i, rng.choice(["a", "b", None]), D.fromordinal(730_000 + rng.randrange(60))) for i in range(80)] + [(99, "a", None)]
    right = sorted({(k, D.fromordinal(730_000 + rng.randrange(60))) for k in "ab" for _ in range(8)})
    a, b = spark.createDataFrame(left, "id long, k string, d date"), spark.createDataFrame([(*r, str(r)) for r in right], "k string, at date, v string")
    got = {r.id: r["at"] for r in R.nearest_row(a, b, ["k"], "d", "at", 4, ["v"]).collect()}
    want = {}
    for i, k, d in left:
        near = [(abs((d - at).days), at > d, at) for kk, at in right if d and kk == k and abs((d - at).days) <= 4]
        if near:
            want[i] = min(near)[2]
    assert got == want
    assert R.nearest_row(a, b.limit(0), ["k"], "d", "at", 4, ["v"]).count() == 0


def test_neighbourhood_and_slices(spark):
    held = spark.createDataFrame([(i, "k", str(i // 2)) for i in range(12)] + [(i, "m", str((i + 1) // 2)) for i in range(12)] + [(50, None, "x")], "n long, kind string, value string")
    start = spark.createDataFrame([(0,)], "n long")
    assert R.neighbourhood(start, "n", held, 3).count() == 4 and R.neighbourhood(start, "n", held, 50).count() == 12
    old = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "e string, i long")
    new = spark.createDataFrame([("x", 9)], "e string, i long")
    assert sorted((r.e, r.i) for r in R.replaced_slice(old, new, ["e"]).collect()) == [("x", 9), ("y", 3)]
    big = spark.createDataFrame([("x", i) for i in range(50)], "e string, i long")
    row = R.share_of_removals(big, new, ["i"], ["e"]).first()
    assert (row.before, row.removed, row.refused) == (50, 49, True)


def test_totals_profile_ranges(spark):
    df = spark.createDataFrame([("a", 1.0, "EUR"), ("a", 2.0, "EUR"), ("b", 1.0, "EUR"), ("b", 1.0, "USD"), ("c", 1.0, None), ("d", None, None)], "k string, v double, c string")
    assert {r.k: (r.total, r.currency) for r in R.single_currency_sum(df, ["k"], "v", "c").collect()} == {"a": (3.0, "EUR"), "b": (None, None), "c": (None, None)}
    assert {r.column: (r.rows, r.nulls) for r in R.table_profile(df).collect()} == {"k": (6, 0), "v": (6, 1), "c": (6, 2)}
    want = spark.createDataFrame([("p", D(2020, 1, 1), D(2020, 12, 31)), ("q", D(2020, 1, 1), D(2020, 1, 5)), ("r", D(2020, 3, 1), D(2020, 4, 1))], "k string, first date, last date")
    have = spark.createDataFrame([("p", D(2020, 2, 1), D(2020, 11, 30)), ("r", D(2020, 1, 1), D(2020, 12, 1))], "k string, first date, last date")
    assert sorted((r.k, r.first, r.last) for r in R.outer_ranges(want, have, ["k"]).collect()) == [("p", D(2020, 1, 1), D(2020, 1, 31)), ("p", D(2020, 12, 1), D(2020, 12, 31)), ("q", D(2020, 1, 1), D(2020, 1, 5))]


def test_quotes_and_csv(spark, tmp_path):
    rows = [('[{"Code": "A.US", "date": "2026-01-02", "Close": "1.5"}, {"code": "B", "date": "2026-01-02", "close": 0, "adjusted_close": "2"}, {"code": "C", "date": "x", "close": "3"}]',), ("no list",), (None,)]
    got = R.quotes_from_json(spark.createDataFrame(rows, "t string"), "t")
    assert sorted((r.code, r.price) for r in got.collect()) == [("A.US", 1.5), ("B", 2.0)]
    R.write_csv(got, str(tmp_path / "o"), ["price", "code"])
    assert next((tmp_path / "o").glob("part*")).read_text().splitlines()[0] == "price,code"


def test_sizes(spark):
    small = materialize(spark.range(10).withColumn("t", F.lit("x")), "small")
    assert "ResolvedHint" in broadcast_if_small(small)._jdf.queryExecution().analyzed().toString() and "ResolvedHint" not in broadcast_if_small(small, 100)._jdf.queryExecution().analyzed().toString()
    with pytest.raises(ValueError):
        broadcast_if_small(spark.range(3))
    discard(small)


EVIDENCE = [
    (1, "A.US", "A.US", None, "US0000000001", "L" * 19 + "1", None), (2, "A.LSE", None, "domestic", "US0000000001", None, None), (3, "X.US", "Y.US", "adr primary", "GB0000000002", "L" * 19 + "2", "NYSE"),
    (4, "Z.US", None, "ADR", "GB0000000003", "L" * 19 + "1", "NYSE"), (5, "P.US", None, "BDR", "GB0000000004", None, "PINK"), (6, "Q.F", None, None, "GB0000000005", None, None), (7, "A.US", None, None, "US0000000001", None, None), (8, None, None, None, None, None, None),
]


def test_classification(spark):
    df = spark.createDataFrame(EVIDENCE, "listing_id long, provider_symbol string, primary_ticker string, home_category string, isin string, lei string, venue_tier string")
    got = {r.listing_id: (r.status, r.rule) for r in classify(df).collect()}
    assert got == {1: ("primary", "R2"), 2: ("secondary", "R3"), 3: ("secondary", "R1"), 4: ("secondary", "R1"), 5: ("secondary", "R1"), 6: ("unknown", "R4"), 7: ("primary", "R3"), 8: ("unknown", "R4")}
    rescued = {r.listing_id: (r.status, r.rule) for r in rescue_sole_listings(classify(df), df).collect()}
    # 4 shares its LEI with a listing that survives, 5 trades on a quote tier.
    assert rescued == got | {3: ("unknown", "rescue")}
    assert classify(df.limit(0)).count() == 0


def test_issuers(spark):
    t = lambda n: datetime(2026, 1, n)
    l1, l2 = "L" * 20, "M" * 20
    rows = [(1, "US0000000001", None, t(1)), (1, "US0000000009", None, t(2)), (2, "US0000000009", l1, t(1)), (3, "US0000000009", None, t(1)), (4, "GB0000000001", l2, t(1)), (5, "GB0000000001", l1, t(1)), (6, "GB0000000001", None, t(1)), (7, "--", "short", t(1))]
    df = spark.createDataFrame(rows, "listing_id long, isin string, lei string, at timestamp")
    got = {r.listing_id: r.issuer_group for r in group_issuers(newest_identities(df, "at")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 1, 4: 4, 6: 6, 7: 7}


def test_representatives(spark):
    rng = random.Random(2)
    for n in (6, 14):
        pairs = [(g, rng.randrange(n)) for g in range(n) for _ in range(rng.randrange(1, 4))]
        claimed, want = set(), {}
        for g in range(n):
            want[g] = next((i for i in sorted({i for gg, i in pairs if gg == g}) if i not in claimed), None)
            claimed.add(want[g])
        df = spark.createDataFrame(pairs, "issuer_group long, issuer_id long")
        assert {r.issuer_group: r.representative for r in claim_representatives(df).collect()} == want


YAML = """
criteria:
  - {name: money, left: {metric: cap}, operator: ">=", right: {metric: debt, multiplier: 2}}
  - {name: fixed, left: {value: 100, currency: USD}, operator: "<", right: {metric: cap}}
  - {name: odd, left: {metric: cap}, operator: ">", right: {metric: margin}}
  - {name: share, left: {metric: margin}, operator: ">", right: {metric: growth}}
ranking: {metrics: [{metric: cap}, {metric: margin}]}
"""


def test_screen_of_currencies(spark, tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yml").write_text(YAML)
    screen = load_screen(str(tmp_path / "s.yml"))
    d = D(2026, 1, 10)
    m = [(1, "cap", 100.0, d, "monetary", "EUR"), (1, "debt", 60.0, d, "monetary", "USD"), (2, "cap", 100.0, d, "monetary", None), (2, "debt", 60.0, d, "monetary", "USD"), (3, "cap", 300.0, d, "monetary", "JPY"), (3, "debt", 1.0, d, "monetary", "USD"), (1, "margin", 0.2, d, "ratio", None), (1, "growth", 0.1, d, "percent", None)]
    metrics = spark.createDataFrame(m, "listing_id long, metric_id string, value double, as_of date, unit_kind string, currency string")
    rates = spark.createDataFrame([("EUR", "USD", D(2026, 1, 1), 2.0, datetime(2026, 1, 1)), ("EUR", "USD", D(2026, 1, 11), 9.0, datetime(2026, 1, 1))], "base_currency string, quote_currency string, rate_date date, rate double, updated_at timestamp")
    wide, aligned = align(aligned_input(metrics, screen.metric_ids()), screen, rates)
    got = {(r.listing_id, r.criterion): r.verdict for r in screen_details(wide, aligned).collect()}
    # 60 dollars are 30 euros, twice that is less than 100; 100 dollars are 50 euros.
    assert [got[1, c] for c in ("money", "fixed", "odd", "share")] == ["passed", "passed", "na_blocked", "passed"]
    assert got[2, "money"] == got[3, "money"] == "na_blocked"
    issues = {r.listing_id: [r[f"__c{i}_issue"] for i in range(4)] for r in wide.collect()}
    assert issues == {1: [None, None, "unit_mismatch", None], 2: ["currency_missing", "currency_missing", None, None], 3: ["fx_missing", "fx_missing", None, None]}
    assert run_screen(wide, aligned).count() == 0
    inputs = aligned_input(metrics, ["cap", "margin"])
    assert [r.cap for r in rank_inputs(inputs, screen.ranking, rates).orderBy("listing_id").collect()] == [None] * 3
    assert [r.cap for r in rank_inputs(inputs, screen.ranking, rates, "USD").orderBy("listing_id").collect()] == [200.0, None, None]
    with pytest.raises(ValueError):
        parse_screen({"criteria": [{"name": "x", "left": {"metric": "a", "value": 1}, "operator": "<", "right": {"value": 1}}]})


def test_money_and_texts(spark):
    df = spark.createDataFrame([(150.0, "GBX", 1.0, "gbp "), (1.0, "USD", 0.0, "USD"), (1.0, "USD", 1.0, None), (None, "USD", 1.0, "USD")], "a double, b string, c double, d string")
    x, y = S.money("a", "b"), S.money("c", "d")
    got = df.select(S.money_math(x, y, "-")["amount"].alias("m"), S.money_math(x, y, "/").alias("q"), S.money_math(x, y, ">").alias("g")).collect()
    assert [tuple(r) for r in got] == [(0.5, 1.5, True), (1.0, None, True), (None, None, None), (None, None, None)]
    js = spark.createDataFrame([('{"b": [1, {"d": 1, "c": 2}], "a": "é"}',), ("{",), (None,)], "j string")
    assert [r[0] for r in js.select(S.canonical_json("j")).collect()] == ['{"a":"\\u00e9","b":[1,{"c":2,"d":1}]}', None, None]
    t = spark.createDataFrame([("abcdefghij", 1234.5), ("abc", None), (None, float("nan"))], "s string, v double")
    assert [tuple(r) for r in t.select(S.shortened("s", 8), S.display_number("v", 1)).collect()] == [("abcde...", "1,234.5"), ("abc", "N/A"), (None, "N/A")]


def test_settings(tmp_path):
    (tmp_path / "s.ini").write_text("[factloom]\nmax_age = 30\npivots = usd, chf\n")
    assert load_settings(str(tmp_path / "s.ini")) == Settings(pivots=("USD", "CHF"), max_age=30)
    (tmp_path / "t.ini").write_text("[factloom]\nnone = 1\n")
    with pytest.raises(ValueError):
        load_settings(str(tmp_path / "t.ini"))
