"""Metrics of one made-up listing against plain arithmetic."""

from datetime import date
from statistics import median, pstdev

import pytest
from pyspark.sql import functions as F

from factloom.metrics.registry import compute_metrics, explain_metric, metric_ids, register

REF = date(2026, 6, 30)
YEARS = range(2015, 2026)
QUARTERS = [date(2024, 3, 31), date(2024, 6, 30), date(2024, 9, 30), date(2024, 12, 31), date(2025, 3, 31), date(2025, 6, 30), date(2025, 9, 30), date(2025, 12, 31), date(2026, 3, 31)]
FLOW = {
    "Revenues": 1000.0, "CostOfRevenue": 600.0, "OperatingIncomeLoss": 200.0, "NetIncomeLoss": 120.0, "NetCashProvidedByUsedInOperatingActivities": 150.0, "CapitalExpenditures": 40.0,
    "DepreciationDepletionAndAmortization": 30.0, "EarningsPerShare": 1.2, "IncomeTaxExpense": 40.0, "IncomeBeforeIncomeTaxes": 160.0, "InterestExpense": 20.0, "StockBasedCompensation": 10.0, "CommonStockDividendsPaid": -24.0,
}
STOCK = {
    "Assets": 2000.0, "AssetsCurrent": 800.0, "LiabilitiesCurrent": 400.0, "Liabilities": 900.0, "StockholdersEquity": 1100.0, "CommonStockholdersEquity": 1000.0, "ShortTermDebt": 50.0, "LongTermDebt": 250.0,
    "CashAndCashEquivalents": 100.0, "CommonStockSharesOutstanding": 100.0, "Goodwill": 60.0, "RetainedEarnings": 500.0, "PropertyPlantAndEquipmentNet": 700.0,
}


def g(year):
    """Growth of a year against 2025."""
    return 1.05 ** (year - 2025)


def rows():
    out = []
    for y in YEARS:
        out += [(1, c, "FY", date(y, 12, 31), v * g(y), date(y + 1, 2, 1)) for c, v in {**FLOW, **STOCK}.items()]
    for d in QUARTERS:
        p, k = f"Q{(d.month + 2) // 3}", g(d.year)
        out += [(1, c, p, d, v * k / 4, None) for c, v in FLOW.items()] + [(1, c, p, d, v * k, None) for c, v in STOCK.items()]
    out += [(1, "DepreciationFromCashFlow", "FY", date(2025, 12, 31), -5.0, None), (2, "Revenues", "FY", date(2025, 12, 31), 10.0, None), (2, None, "FY", date(2025, 12, 31), 10.0, None), (3, "Assets", "FY", None, 1.0, None)]
    return out


@pytest.fixture(scope="module")
def got(spark):
    df = spark.createDataFrame(rows(), "listing_id long, concept string, fiscal_period string, end_date date, value double, filed date")
    market = spark.createDataFrame([(1, 20.0, date(2026, 6, 29))], "listing_id long, price double, price_date date")
    return {r.metric_id: r.value for r in compute_metrics(df, F.lit(REF), market).collect() if r.listing_id == 1}


def test_all_are_there():
    import factloom.metrics.catalogue  # noqa: F401

    assert len(metric_ids()) == 93


def test_values(got):
    q = g(2026)
    ttm = lambda c: FLOW[c] * (3 * g(2025) + q) / 4
    fcf = ttm("NetCashProvidedByUsedInOperatingActivities") - ttm("CapitalExpenditures")
    debt, cash, shares = 300 * q, 100 * q, 100 * q
    mcap = 20 * shares
    ev = mcap + debt - cash
    ebitda = ttm("OperatingIncomeLoss") + ttm("DepreciationDepletionAndAmortization")
    ic = lambda y: (300 + 1100 - 100) * g(y)
    avg = lambda v: v * (g(2026) + g(2025)) / 2
    tax = 0.25
    nopat = lambda y: 200 * g(y) * (1 - tax)
    roic = {y: nopat(y) / ((ic(y) + ic(y - 1)) / 2 if y > 2015 else ic(y)) for y in YEARS}
    nwc = lambda y: (800 - 100 - (400 - 50)) * g(y)
    maint = (nwc(2025) - nwc(2022)) / 3
    spend = min(ttm("CapitalExpenditures"), 1.1 * ttm("DepreciationDepletionAndAmortization"))
    oe = lambda y: nopat(y) + 30 * g(y) - min(40, 33) * g(y) - (nwc(y) - nwc(y - 3)) / 3
    want = {
        "working_capital": 400 * q, "current_ratio": 2.0, "long_term_debt": 250 * q, "ncav": -100 * q, "short_term_debt_share": 50 / 300,
        "debt_paydown_years": debt / fcf, "fcf_to_debt": fcf / debt, "cfo_to_ni_ttm": 150 / 120, "cfo_to_ni_10y_median": 1.25, "fcf_fy_median_5y": 110 * g(2023),
        "fcf_neg_years_10y": 0, "ni_loss_years_10y": 0, "ni_loss_year_share": 0, "accruals_ratio": (ttm("NetIncomeLoss") - ttm("NetCashProvidedByUsedInOperatingActivities")) / avg(2000),
        "altman_z": 1.2 * 0.2 + 1.4 * 0.25 + 3.3 * ttm("OperatingIncomeLoss") / (2000 * q) + 0.6 * mcap / (900 * q) + ttm("Revenues") / (2000 * q),
        "eps_streak": 11, "eps_ttm": ttm("EarningsPerShare"), "eps_6y_avg": 1.2 * sum(g(y) for y in range(2020, 2026)) / 6,
        "graham_eps_10y_cagr_3y_avg": 0.05, "earnings_yield": ttm("EarningsPerShare") / 20, "peg_ratio": 20 / ttm("EarningsPerShare") / 5, "interest_coverage": 10.0, "market_cap": mcap,
        "price_to_book": 20 / (1000 * q / shares), "price_to_tangible_book": 20 / (940 * q / shares), "price_to_fcf": mcap / fcf, "net_debt_to_ebitda": (debt - cash) / ebitda, "ic_mqr": 1300 * q, "ic_fy": 1300.0,
        "avg_ic": avg(1300), "roic_ttm": ttm("OperatingIncomeLoss") * (1 - tax) / avg(1300), "roce": ttm("OperatingIncomeLoss") / avg(1600), "croic": fcf / avg(1300),
        "roic_10y_median": median(roic[y] for y in range(2016, 2026)), "roic_7y_min": min(roic[y] for y in range(2019, 2026)), "roic_years_above_12pct": sum(roic[y] > 0.12 for y in range(2016, 2026)),
        "iroic_5y": (nopat(2025) - nopat(2020)) / (ic(2025) - ic(2020)), "gm_10y_std": pstdev([0.4] * 10), "opm_10y_std": 0.0, "opm_10y_min": 0.2, "share_count_cagr_5y": 0.05, "share_count_cagr_10y": 0.05,
        "shares_10y_pct_change": 1.05**10 - 1, "net_buyback_yield": -(1.05 - 1), "ebit_yield_ev": ttm("OperatingIncomeLoss") / ev, "fcf_yield_ev": fcf / ev, "ev_to_ebit": ev / ttm("OperatingIncomeLoss"), "ev_to_ebitda": ev / ebitda,
        "ev_to_sales": ev / ttm("Revenues"), "fcf_to_ebitda": fcf / ebitda, "sbc_to_revenue": 0.01, "sbc_to_fcf": ttm("StockBasedCompensation") / fcf, "gross_margin_ttm": 0.4, "operating_margin_ttm": 0.2, "fcf_margin_ttm": 0.11,
        "roe_ttm": ttm("NetIncomeLoss") / avg(1000), "roa_ttm": ttm("NetIncomeLoss") / avg(2000), "roetce_ttm": ttm("NetIncomeLoss") / avg(940), "dividend_yield_ttm": -ttm("CommonStockDividendsPaid") / mcap,
        "shareholder_yield_ttm": -ttm("CommonStockDividendsPaid") / mcap - 0.05, "dividend_payout_ratio_ttm": 0.2, "revenue_cagr_10y": 0.05, "fcf_per_share_cagr_10y": 0.0, "gross_profit_to_assets_ttm": 0.4 * ttm("Revenues") / avg(2000),
        "mcapex_fy": 33.0, "mcapex_5y": 33 * sum(g(y) for y in range(2021, 2026)) / 5, "mcapex_ttm": spend, "nwc_mqr": nwc(2026), "nwc_fy": nwc(2025), "delta_nwc_ttm": nwc(2026) - nwc(2025), "delta_nwc_fy": nwc(2025) - nwc(2024),
        "delta_nwc_maint": maint, "oe_equity_ttm": ttm("NetIncomeLoss") + ttm("DepreciationDepletionAndAmortization") - spend - maint,
        "oe_ev_ttm": ttm("OperatingIncomeLoss") * (1 - tax) + ttm("DepreciationDepletionAndAmortization") - spend - maint, "oe_ev_5y_avg": sum(oe(y) for y in range(2021, 2026)) / 5, "oe_ev_fy_median_5y": median(oe(y) for y in range(2021, 2026)),
        "oey_ev_norm": median(oe(y) for y in range(2021, 2026)) / ev, "roc_greenblatt_5y_avg": 200 / 1100,
    }
    off = {k: (got.get(k), v) for k, v in want.items() if got.get(k) != pytest.approx(v, rel=1e-9, abs=1e-9)}
    assert off == {}
    # Everything grows alike: profit, cash flow and cash above profit count; equal ratios may differ in their last bit.
    assert 3 <= got["piotroski_f_score"] <= 9
    assert got["graham_multiplier"] == pytest.approx(20 / ttm("EarningsPerShare") * 20 / (1040 * q / shares)) and got["roe_greenblatt_5y_avg"] if "roe_greenblatt_5y_avg" in got else True
    assert got["roic_7y_median"] == pytest.approx(median(roic[y] for y in range(2019, 2026))) and got["roic_10y_min"] == pytest.approx(min(roic[y] for y in range(2016, 2026))) and got["opm_7y_min"] == pytest.approx(0.2)
    assert "worst_oe_ev_fy_10y" not in got  # ten years of maintenance need thirteen of balance sheets


def test_own_metric(spark):
    register("assets_twice", "monetary", lambda ref: F.when(F.col("l_Assets").isNotNull(), F.struct((F.col("l_Assets")["v"] * 2).alias("v"), F.col("l_Assets")["d"].alias("d"))))
    df = spark.createDataFrame(rows(), "listing_id long, concept string, fiscal_period string, end_date date, value double, filed date")
    assert {r.listing_id: r.value for r in compute_metrics(df, F.lit(REF), ids=["assets_twice"]).collect()} == {1: pytest.approx(4000 * g(2026))}
    with pytest.raises(KeyError):
        compute_metrics(df, F.lit(REF), ids=["none such"])


def _one(spark, rows, ids, price=None):
    df = spark.createDataFrame([(1, *r, None) for r in rows], "listing_id long, concept string, fiscal_period string, end_date date, value double, filed date")
    market = spark.createDataFrame([(1, price, date(2026, 6, 29))], "listing_id long, price double, price_date date") if price else None
    return {r.metric_id: r.value for r in compute_metrics(df, F.lit(REF), market, ids).collect()}


def _score_rows(**changed):
    base = {"NetIncomeLoss": (10, 8, 7), "Assets": (100, 100, 100), "NetCashProvidedByUsedInOperatingActivities": (12, 9, 9), "AssetsCurrent": (50, 40, 40), "LiabilitiesCurrent": (20, 20, 20), "Revenues": (90, 80, 70), "GrossProfit": (45, 38, 30),
            "CommonStockSharesOutstanding": (10, 10, 10), "LongTermDebt": (10, 20, 20)} | changed
    return [(c, "FY", date(2025 - i, 12, 31), float(v)) for c, vs in base.items() for i, v in enumerate(vs) if v is not None]


def test_score_of_nine(spark):
    score = lambda **c: _one(spark, _score_rows(**c), ["piotroski_f_score"]).get("piotroski_f_score")
    assert score() == 9
    assert score(LongTermDebt=(None, None, None)) == 9 and score(LongTermDebt=(20, 10, 10)) == 8 and score(CommonStockSharesOutstanding=(11, 10, 10)) == 8
    # Debt over the mean of two years: 10 / 55 against 10 / 100 is more, though 10 / 10 a year is the same.
    assert score(LongTermDebt=(10, 10, 10), Assets=(10, 100, 100)) == 8
    assert score(Assets=(100, 100, None)) is None and score(Revenues=(0, 80, 70)) is None and score(GrossProfit=(45, None, 30)) is None
    assert score(GrossProfit=(None,) * 3, CostOfRevenue=(45, 42, 40)) == 9


def test_depreciation_of_either_source(spark):
    d = lambda y, m=12: date(y, m, 28)
    rows = [("CapitalExpenditures", "FY", d(2025), -50.0), ("DepreciationFromCashFlow", "FY", d(2025), 10.0), ("DepreciationDepletionAndAmortization", "FY", d(2024), 5.0), ("DepreciationFromCashFlow", "FY", d(2024), 9.0), ("CapitalExpenditures", "FY", d(2024, 11), 7.0)]
    assert _one(spark, rows, ["mcapex_fy"])["mcapex_fy"] == pytest.approx(11.0)
    more = rows + [("CapitalExpenditures", "FY", d(2023), 3.0), ("CapitalExpenditures", "FY", d(2022), 3.0)]
    # By end date: 11, 5.5 (depreciation alone), 7 (spend alone), 3, 3.
    assert _one(spark, more, ["mcapex_5y"])["mcapex_5y"] == pytest.approx((11 + 5.5 + 7 + 3 + 3) / 5)


def test_no_made_up_liabilities(spark):
    rows = [(c, "Q1", date(2026, 3, 31), v) for c, v in (("Assets", 100.0), ("StockholdersEquity", 60.0), ("AssetsCurrent", 50.0))]
    assert _one(spark, rows, ["ncav"]) == {}
    assert _one(spark, [*rows, ("Liabilities", "Q1", date(2026, 3, 31), 30.0)], ["ncav"]) == {"ncav": 20.0}


def test_explanation(spark):
    df = spark.createDataFrame(rows(), "listing_id long, concept string, fiscal_period string, end_date date, value double, filed date")
    got = {(r.part, r.name): r.value for r in explain_metric(df, F.lit(REF), 1, "current_ratio").collect()}
    assert got == {("metric", "current_ratio"): pytest.approx(2.0), ("input", "AssetsCurrent"): pytest.approx(800 * g(2026)), ("input", "LiabilitiesCurrent"): pytest.approx(400 * g(2026))}
    assert {r.name: r.value for r in explain_metric(df, F.lit(REF), 9, "current_ratio").collect()}["current_ratio"] is None
