"""The metrics on facts made up from the project's: the test tables hold no prices, few concepts a listing and six years."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.materialize import materialize
from factloom.plans.fundamentals import clean_facts, reference
from factloom.plans.metric_sql import BALANCES, MADE, metric_sql

_FAMILIES = {
    "met_balance_sheet": "working_capital current_ratio long_term_debt ncav short_term_debt_share debt_paydown_years fcf_to_debt ic_mqr ic_fy avg_ic nwc_mqr nwc_fy delta_nwc_ttm delta_nwc_fy delta_nwc_maint",
    "met_windows": "cfo_to_ni_ttm accruals_ratio eps_ttm interest_coverage net_debt_to_ebitda fcf_to_ebitda sbc_to_revenue sbc_to_fcf gross_margin_ttm operating_margin_ttm fcf_margin_ttm roe_ttm roa_ttm roetce_ttm gross_profit_to_assets_ttm roic_ttm roce croic dividend_payout_ratio_ttm",
    "met_years": "cfo_to_ni_10y_median fcf_fy_median_5y fcf_neg_years_10y ni_loss_years_10y ni_loss_year_share piotroski_f_score eps_streak eps_6y_avg graham_eps_10y_cagr_3y_avg gm_10y_std opm_10y_std opm_10y_min opm_7y_min revenue_cagr_10y fcf_per_share_cagr_10y share_count_cagr_5y share_count_cagr_10y shares_10y_pct_change roc_greenblatt_5y_avg roe_greenblatt_5y_avg",
    "met_invested": "roic_10y_median roic_7y_median roic_10y_median_adaptive roic_years_above_12pct roic_10y_min roic_7y_min iroic_5y",
    "met_market": "market_cap price_to_ncav altman_z graham_multiplier earnings_yield peg_ratio peg_ratio_div_adj price_to_book price_to_tangible_book price_to_fcf ebit_yield_ev fcf_yield_ev ev_to_ebit ev_to_ebitda ev_to_sales net_buyback_yield dividend_yield_ttm shareholder_yield_ttm",
    "met_owner": "owner_earnings_cagr_10y mcapex_fy mcapex_5y mcapex_ttm oe_equity_ttm oe_equity_5y_avg oey_equity oey_equity_5y oey_ev oey_ev_norm oe_ev_ttm oe_ev_5y_avg oe_ev_fy_median_5y worst_oe_ev_fy_10y",
}


def made_up_facts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Facts of all concepts at the dates and of the size of the recorded ones, with two earlier stretches of fiscal years, and prices."""
    rows = clean_facts(spark, d).filter("unit_kind = 'monetary'").groupBy("listing_id", F.col("fiscal_period").alias("p"), F.col("end_date").alias("d"))
    rows = materialize(rows.agg((F.floor(F.max(F.abs("value"))).cast("long") % 1000 + 200).alias("b")), "bases")
    prices = rows.filter(F.col("listing_id") % 17 != 0).select("listing_id").distinct().select("listing_id", (5.0 + F.col("listing_id") % 23).alias("price"), F.to_date(F.lit("2026-06-29")).alias("price_date"))
    shift = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for m, k in ((0, 1.0), (-72, 0.7), (-144, 0.4))))
    rows = rows.select("listing_id", "p", "d", "b", F.explode(F.when(F.col("p") == "FY", shift).otherwise(F.slice(shift, 1, 1))).alias("s"))
    rows = rows.groupBy("listing_id", "p", F.add_months("d", F.col("s.m")).alias("d")).agg(F.max(F.col("b") * F.col("s.k")).alias("b")).withColumn("y", F.year("d")).withColumn("m", F.month("d"))
    x = F.col("listing_id")
    period = F.col("p").isin("FY", "Q1", "Q2", "Q3", "Q4")
    made = []
    for i, (concept, (share, gap, loss)) in enumerate(MADE.items()):
        here = (period | (F.col("p") == "INSTANT") if concept in BALANCES else period) & ((x * 7 + i * 3) % gap != 0) & ~((x % 5 == 0) & ((F.lit(i) + F.col("y")) % 11 == 0))
        value = F.col("b") * share * ((94 + (x * 31 + i * 17 + F.col("y") * 7 + F.col("m")) % 13) / F.lit(100.0))
        made.append((concept, here, F.when((x + i + F.col("y")) % 9 == 0, -value).otherwise(value) if loss else value))
    n = 1000.0 + (x % 50) * 10 + (F.col("y") - 2000) * (x % 7 - 2)
    made += [
        ("CommonStockSharesOutstanding", (F.col("p") != "TTM") & (x % 11 != 3), n * F.when(F.col("p") != "INSTANT", 1.0).when(x % 3 == 0, 1.01).otherwise(1.5)),
        ("EntityCommonStockSharesOutstanding", period & (x % 4 == 1), n * 1.2),
        ("ProviderMarketCapitalization", (F.col("p") == "INSTANT") & (x % 2 == 0), n * (5.0 + x % 23) * 1.4),
        ("CommonStockDividendsPerShareCashPaid", F.col("p") == "TTM", 0.2 + x % 4),
    ]
    cells = F.array(*(F.when(here, F.struct(F.lit(c).alias("concept"), v.cast("double").alias("value"))) for c, here, v in made))
    facts = rows.select("listing_id", F.explode(F.array_compact(cells)).alias("c"), F.col("p").alias("fiscal_period"), F.col("d").alias("end_date"), F.lit(None).cast("date").alias("filed"))
    return facts.select("listing_id", "c.concept", "fiscal_period", "end_date", "c.value", "filed"), prices


def _family(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        from factloom.metrics.registry import compute_metrics

        facts, prices = made_up_facts(spark, d)
        out = compute_metrics(facts, reference(), prices, _FAMILIES[name].split())
        return out.select("listing_id", "metric_id", (F.round("value", 6) + 0.0).alias("value"))

    query.__name__ = name
    return query


QUERIES = {name: _family(name) for name in _FAMILIES}
SQL = {name: metric_sql(ids.split()) for name, ids in _FAMILIES.items()}
