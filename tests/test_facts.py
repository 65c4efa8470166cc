"""Fact operators against short independent versions in Python."""

import random
from datetime import date, datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.operators import facts as P
from factloom.operators import fx
from factloom.operators.nested import flatten
from factloom.operators.normalize import facts_from_entries, in_target_currency, unit_flips, with_derived_facts, with_implied_eps
from factloom.operators.ranking import RankedMetric, Ranking, score
from factloom.operators.universe import classify, fill_missing, group_issuers
from factloom.operators.upsert import changed_payloads, refuse_mass_removal, replace_slices, upsert
from factloom.plans.records import PAYLOAD_TABLES
from factloom.plans.screen import fallout, parse_screen, run_screen, screen_details
from factloom.streaming.increment import facts_stream

REF = date(2026, 6, 30)
SCHEMA = "listing_id long, concept string, fiscal_period string, end_date date, value double, filed date, updated_at timestamp, fact_id long"


def _facts(spark, rows):
    return spark.createDataFrame([(*r, datetime(2026, 1, 1), i) for i, r in enumerate(rows)], SCHEMA)


def _ttm(rows, annual):
    """rows: (end, value, period, filed)"""
    seen = {}
    for end, v, p, filed in sorted((r for r in rows if r[2][0] == "Q"), key=lambda r: r[3] or date(1, 1, 1), reverse=True):
        seen.setdefault(end, v)
    ends = sorted(seen, reverse=True)
    gaps = [(a - b).days for a, b in zip(ends, ends[1:], strict=False)]
    q, h = (lambda g: 70 <= g <= 110), (lambda g: 150 <= g <= 220)
    if len(ends) < 2:
        out = "too_few"
    elif (REF - ends[0]).days > 400:
        out = "too_old"
    elif len(ends) >= 4 and all(map(q, gaps[:3])):
        return "quarterly", sum(seen[e] for e in ends[:4])
    elif h(gaps[0]) and (len(ends) == 2 or h(gaps[1])):
        return "semi_annual", sum(seen[e] for e in ends[:2])
    else:
        out = "too_few" if q(gaps[0]) and len(ends) < 4 else "no_cadence"
    years = [(end, v) for end, v, p, _ in rows if p == "FY"]
    if annual and years and (REF - max(years)[0]).days <= 480:
        return "annual", max(years)[1]
    return out


def test_ttm_windows(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for listing in range(150):
        end, own = REF - timedelta(rng.choice([10, 90, 390, 420])), []
        for i in range(rng.randrange(7)):
            own.append((end, float(rng.randrange(100)), f"Q{i % 4 + 1}", end + timedelta(30)))
            if rng.random() < 0.2:
                own.append((end, float(rng.randrange(100)), f"Q{i % 4 + 1}", end + timedelta(60)))
            end -= timedelta(rng.choice([91, 91, 92, 182, 182, 130]))
        if rng.random() < 0.5:
            own.append((REF - timedelta(rng.choice([100, 470, 500])), 1000.0, "FY", None))
        rows += [(listing, "Revenues", p, e, v, f) for e, v, p, f in own]
        want[listing] = own
    df = _facts(spark, rows)
    for annual in (None, 480):
        got = {r.listing_id: r for r in P.ttm_windows(df, F.lit(REF), annual_max_age=annual).collect()}
        for listing, own in want.items():
            if not any(annual or r[2] != "FY" for r in own):
                assert listing not in got
                continue
            w, r = _ttm(own, annual), got[listing]
            assert (r.failure == w and r.value is None) if isinstance(w, str) else ((r.cadence, r.value) == w and r.failure is None)


def test_years(spark):
    years = {1: [2025, 2024, 2023, 2021, 2020], 2: [2025, 2023], 3: [2025, 2024, 2023]}
    df = _facts(spark, [(i, "c", "FY", date(y, 12, 31), float(y), None) for i, ys in years.items() for y in ys] + [(3, "c", "FY", date(2025, 6, 30), -1.0, None)])
    series = P.by_year(df)
    assert {r.listing_id for r in P.strict_years(series, 3).collect()} == {1, 3}
    assert {(r.listing_id, r.year) for r in P.consecutive_years(series, 10, 2).collect()} == {(i, y) for i in (1, 3) for y in (2023, 2024, 2025)}
    assert {(r.listing_id, r.year) for r in P.consecutive_years(series, 2, 2).collect()} == {(i, y) for i in (1, 3) for y in (2024, 2025)}
    assert {r.listing_id: r.streak for r in P.streak(df, F.col("value") > 0).collect()} == {1: 5, 2: 2, 3: 1}
    assert {r.value for r in P.by_year(df, newest=False).filter("listing_id = 3 AND year = 2025").collect()} == {-1.0}
    assert P.by_year(df.limit(0)).count() == 0


def test_rates(spark):
    rows = [("EUR", "USD", date(2026, 1, 5), 1.1), ("USD", "SEK", date(2026, 1, 6), 10.0), ("EUR", "SEK", date(2026, 1, 1), 11.5), ("GBP", "USD", date(2026, 1, 2), 1.3), ("USD", "XXX", date(2026, 1, 1), 0.0)]
    rates = spark.createDataFrame([(*r, datetime(2026, 1, 1)) for r in rows], "base_currency string, quote_currency string, rate_date date, rate double, updated_at timestamp")
    asked = [("EUR", "USD"), ("USD", "EUR"), ("SEK", "USD"), ("EUR", "SEK"), ("GBP", "SEK"), ("USD", "USD"), ("DEM", "EUR"), ("DEM", "USD"), ("JPY", "USD"), (None, "USD"), ("XXX", "USD")]
    keys = spark.createDataFrame([(*a, date(2026, 1, 20)) for a in asked] + [("EUR", "USD", date(2026, 1, 4))], "base string, quote string, on_date date")
    got = {(r.base, r.quote, r.on_date.day): (round(r.rate, 6), r.rate_date.day, r.kind, r.is_stale) for r in fx.rates_for(keys, rates).collect()}
    assert got == {
        ("EUR", "USD", 20): (1.1, 5, 3, True), ("USD", "EUR", 20): (round(1 / 1.1, 6), 5, 2, True), ("SEK", "USD", 20): (0.1, 6, 2, True),
        ("EUR", "SEK", 20): (11.0, 5, 1, True), ("GBP", "SEK", 20): (13.0, 2, 1, True), ("USD", "USD", 20): (1.0, 20, 5, False),
        ("DEM", "EUR", 20): (round(1 / 1.95583, 6), 20, 4, False), ("DEM", "USD", 20): (round(1.1 / 1.95583, 6), 5, 1, True),
    }


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.none() | st.integers(0, 5)), min_size=1, max_size=30))
def test_ranking(spark, rows):
    df = spark.createDataFrame([(f"{i:02d}", s, None if v is None else float(v)) for i, (s, v) in enumerate(rows)], "symbol string, sector string, m double")
    got = {r.symbol: r for r in score(df, Ranking([RankedMetric("m")], min_sector_peers=4, lower=0.0, upper=1.0)).collect()}
    for i, (s, v) in enumerate(rows):
        peers = [r for r in rows if r[0] == s] if s and sum(r[0] == s for r in rows) >= 4 else rows
        x = [p[1] for p in peers if p[1] is not None]
        want = 50.0 if v is None else 100 * (sum(p < v for p in x) + 0.5 * sum(p == v for p in x)) / len(x)
        assert got[f"{i:02d}"].score == pytest.approx(want)
    assert sorted(r.rank for r in got.values()) == list(range(1, len(rows) + 1))


def test_screen(spark):
    screen = parse_screen({"criteria": [
        {"name": "a", "left": {"metric": "x"}, "operator": ">=", "right": {"metric": "y", "multiplier": 2}},
        {"name": "g", "at_least": 2, "any_of": [{"name": n, "left": {"metric": n}, "operator": ">", "right": {"value": 0}} for n in ("x", "y", "z")]},
    ]})
    df = spark.createDataFrame([(1, 4.0, 2.0, None), (2, 3.0, 2.0, None), (3, None, 1.0, 1.0), (4, 1.0, None, None), (5, None, None, float("nan"))], "listing_id long, x double, y double, z double")
    assert [(r.listing_id, r.g1) for r in run_screen(df, screen).collect()] == [(1, 4.0)]
    got = {(r.listing_id, r.criterion): (r.verdict, list(r.missing)) for r in screen_details(df, screen).collect()}
    assert got[(2, "a")] == ("comparison_failed", []) and got[(3, "a")] == ("na_blocked", ["x"]) and got[(3, "g")] == ("passed", ["x"]) and got[(5, "g")] == ("na_blocked", ["x", "y", "z"])
    assert {r.criterion: r.failed for r in fallout(df, screen).collect()} == {"a": 4, "g": 2}
    for bad in ({"criteria": [{"left": {"metric": "x"}, "operator": "!=", "right": {"value": 1}}]}, {"criteria": [{"at_least": 3, "any_of": [{"left": {"metric": "x"}, "operator": ">", "right": {"value": 1}}]}]}):
        with pytest.raises(ValueError):
            parse_screen(bad)


def test_listings(spark):
    i1, i2, i3, l1, l2 = "US0000000011", "US0000000022", "US0000000033", "A" * 18 + "01", "B" * 18 + "02"
    ids = spark.createDataFrame([(5, i1, l1), (4, i1, None), (3, i2, None), (2, i2, None), (9, i3, l1), (8, i3, l2), (7, i3, None), (6, None, None)], "listing_id long, isin string, lei string")
    assert {r.listing_id: r.issuer_group for r in group_issuers(ids).collect()} == {5: 4, 4: 4, 9: 4, 3: 2, 2: 2, 8: 8, 7: 7, 6: 6}
    ev = spark.createDataFrame([(1, "A.US", "A.US", None, i1), (2, "A.L", "A.US", None, i1), (3, "A.PA", None, None, i1), (4, "D.US", "D.US", "adr ", i2), (5, "Z.US", " ", None, None)], "listing_id long, provider_symbol string, primary_ticker string, home_category string, isin string")
    assert {r.listing_id: (r.status, r.rule) for r in classify(ev).collect()} == {1: ("primary", "R2"), 2: ("secondary", "R2"), 3: ("secondary", "R3"), 4: ("secondary", "R1"), 5: ("unknown", "R4")}
    parts = spark.createDataFrame([(1, "a", None, 1), (1, None, "x", 2), (1, "b", None, 0)], "k long, p string, q string, t long")
    assert [(r.p, r.q) for r in fill_missing(parts, ["k"], ["p", "q"], "t").collect()] == [("a", "x")]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k long, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, None), (None, "m")], "k long, v string")
    assert sorted(((r.k, r.v) for r in upsert(old, new, ["k"]).collect()), key=str) == sorted([(1, "a"), (2, "d"), (3, None), (None, "m")], key=str)
    assert sorted((r.k, r.v) for r in replace_slices(old.dropna(), new.dropna(), ["k"], ["k"]).collect() if r.k != 2) == [(1, "a")]
    many = spark.range(40).withColumnRenamed("id", "k")
    refuse_mass_removal(many, many.filter("k >= 19"), ["k"])
    with pytest.raises(ValueError):
        refuse_mass_removal(many, many.filter("k >= 30"), ["k"])
    raw = spark.createDataFrame([(1, "h"), (2, "h2")], "provider_listing_id long, payload_hash string")
    assert changed_payloads(raw, raw.filter("provider_listing_id = 1")).count() == 1


PAYLOAD = """{"General": {"CurrencyCode": "GBX"}, "Financials": {
 "Balance_Sheet": {"currency_symbol": "USD", "yearly": {"2024-12-31": {"date": "2024-12-31", "TOTALASSETS": "1,000", "totalLiab": 700, "totalCurrentLiabilities": 200}}},
 "Income_Statement": {"quarterly": [{"date": "2025-03-31", "netIncome": 5000, "filing_date": "2025-05-01"}, {"date": "n/a", "netIncome": 1}]},
 "Cash_Flow": {"quarterly": {"2025-03-31": {"totalCashFromOperatingActivities": 90, "freeCashFlow": 50, "currency_symbol": "EUR"}}}},
 "Earnings": {"History": {"2024-12-31": {"date": "2024-12-31", "epsActual": 120}}}, "outstandingShares": {"quarterly": [{"date": "2025-04-30", "sharesMln": "0.0001", "shares": null}, {"date": "2024", "shares": 0}]}}"""


def test_normalize(spark, tmp_path):
    raw = spark.createDataFrame([(1, PAYLOAD, datetime(2026, 1, 1)), (2, "{", datetime(2026, 1, 1))], "id long, data string, fetched timestamp")
    facts = facts_from_entries(flatten(raw, "data", ["id"], PAYLOAD_TABLES), "id")
    got = {(r.concept, r.fiscal_period, str(r.end_date)): (r.value, r.currency, r.filed and str(r.filed)) for r in facts.collect()}
    assert got == {
        ("Assets", "FY", "2024-12-31"): (1000.0, "USD", None), ("Liabilities", "FY", "2024-12-31"): (700.0, "USD", None), ("LiabilitiesCurrent", "FY", "2024-12-31"): (200.0, "USD", None), ("LongTermDebt", "FY", "2024-12-31"): (500.0, "USD", None),
        ("NetIncomeLoss", "Q1", "2025-03-31"): (50.0, "GBP", "2025-05-01"), ("NetCashProvidedByUsedInOperatingActivities", "Q1", "2025-03-31"): (90.0, "EUR", None),
        ("CapitalExpenditures", "Q1", "2025-03-31"): (40.0, "EUR", None),
        ("EarningsPerShare", "Q4", "2024-12-31"): (1.2, "GBP", None), ("CommonStockSharesOutstanding", "Q2", "2025-04-30"): (100.0, None, None),
    }
    eps = with_implied_eps(facts, "id").filter("concept = 'EarningsPerShare' AND fiscal_period = 'Q1'").collect()
    assert [r.value for r in eps] == [0.5]

    src, dst = f"{tmp_path}/in", f"{tmp_path}/out"
    raw.write.parquet(src)
    start = lambda: facts_stream(spark.readStream.schema(raw.schema).parquet(src), PAYLOAD_TABLES, "id", "data", "fetched", dst, f"{tmp_path}/cp", 4).awaitTermination(120)
    start()
    assert spark.read.parquet(dst).count() == 9
    again = [(1, '{"Earnings": {"History": {"2025-12-31": {"epsActual": 3}}}}', datetime(2026, 2, 1)), (3, PAYLOAD, datetime(2026, 2, 1))]
    spark.createDataFrame(again, raw.schema).write.mode("append").parquet(src)
    start()
    assert {(r.id, r["count"]) for r in spark.read.parquet(dst).groupBy("id").count().collect()} == {(1, 1), (3, 9)}


RICH = """{"General": {"CurrencyCode": "USD", "UpdatedAt": "2026-02-01"}, "SharesStats": {"SharesOutstanding": "1,000"}, "Highlights": {"MarketCapitalization": 5000, "DividendShare": "0.5"},
 "Financials": {"Balance_Sheet": {"quarterly": [{"date": "2025-12-31", "totalAssets": 100, "totalLiab": 40, "preferredStock": 5, "noncontrollingInterestInConsolidatedEntity": 3, "commonStockTotalEquity": 1, "intangibleAssets": 7, "shareIssued": 900},
   {"date": "2025-12-31", "shareIssued": 800}]},
  "Income_Statement": {"quarterly": [{"date": "2025-12-31", "netIncome": 10, "preferredStockAndOtherAdjustments": 2, "eps": 0.4, "epsDiluted": null}, {"date": "2025-09-30", "netIncome": 8}]}},
 "Earnings": {"History": {"2026-03-31": {"epsActual": 0, "reportDate": "2026-04-20"}, "2025-09-30": {"epsActual": 0}, "2025-06-30": {"epsActual": 0}, "2026-06-30": {"epsActual": 4, "reportDate": "2026-07-20"}}}}"""


def test_facts_of_a_rich_payload(spark):
    raw = spark.createDataFrame([(1, RICH)], "id long, data string")
    facts = facts_from_entries(flatten(raw, "data", ["id"], PAYLOAD_TABLES), "id")
    got = {(r.concept, r.fiscal_period, str(r.end_date)): r.value for r in facts.collect()}
    # The smallest of two counts; a zero without a statement of its quarter and reports of the future are placeholders.
    assert got["CommonStockSharesOutstanding", "Q4", "2025-12-31"] == 800 and got["CommonStockSharesOutstanding", "INSTANT", "2026-02-01"] == 1000
    assert {k[2] for k in got if k[0] == "EarningsPerShare"} == {"2025-09-30"}
    assert got["ProviderMarketCapitalization", "INSTANT", "2026-02-01"] == 5000 and got["CommonStockDividendsPerShareCashPaid", "TTM", "2026-02-01"] == 0.5
    derived = {(r.concept, str(r.end_date)): r.value for r in with_derived_facts(facts, "id").collect() if r.fiscal_period == "Q4"}
    day = "2025-12-31"
    assert derived["StockholdersEquity", day] == 60 and derived["CommonStockholdersEquity", day] == 52 and derived["IntangibleAssetsNetExcludingGoodwill", day] == 7
    assert derived["NetIncomeLossAvailableToCommonStockholdersBasic", day] == 8 and derived["EarningsPerShare", day] == 0.4
    targets = spark.createDataFrame([(1, "EUR")], "id long, target string")
    rates = spark.createDataFrame([("EUR", "USD", date(2025, 12, 1), 2.0, datetime(2026, 1, 1))], "base_currency string, quote_currency string, rate_date date, rate double, updated_at timestamp")
    moved = {(r.concept, r.fiscal_period): (r.value, r.currency) for r in in_target_currency(facts, "id", targets, rates).collect()}
    assert moved["Assets", "Q4"] == (50.0, "EUR") and moved["CommonStockSharesOutstanding", "Q4"] == (800.0, None) and ("NetIncomeLoss", "Q3") not in moved
    assert with_derived_facts(facts.limit(0), "id").count() == 0


def test_unit_flips(spark):
    rows = [("a", i, v) for i, v in enumerate([1.0, 1.1, 110.0, 120.0, 1.2, None, 0.0])] + [("b", i, v) for i, v in enumerate([5.0, 6.0])]
    got = {(r.s, r.t): r.scale for r in unit_flips(spark.createDataFrame(rows, "s string, t long, v double"), ["s"], "t", "v").collect()}
    assert [got[("a", i)] for i in range(5)] == [1.0, 1.0, 0.01, 0.01, 1.0] and got[("b", 0)] == 1.0
