"""Fact operators on the project's tables: scans, windows of a year, series, exchange rates, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import facts as P
from factloom.operators import fx
from factloom.operators.latest import latest_by
from factloom.plans import oracle as O
from factloom.plans.records import common_facts
from factloom.sources.tables import read_table

#: Dates of results are relative to this one.
REFERENCE_DATE = "2026-06-30"


def reference():
    return F.to_date(F.lit(REFERENCE_DATE))


def clean_facts(spark: SparkSession, d: str) -> DataFrame:
    """Facts in common units, one per natural key (the latest filing), without filler dates."""
    rows = common_facts(spark, d).filter(~F.col("end_date").isin(*(F.to_date(F.lit(x)) for x in ("1900-01-01", "2099-12-31"))))
    rows = rows.select("listing_id", "concept", "fiscal_period", "end_date", "unit_kind", F.col("common_value").alias("value"), "filed", F.col("common_unit").alias("currency"), "source", "updated_at", "fact_id")
    return P.one_per_natural_key(rows)


def _r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


def src_clean_facts(spark, d):
    return clean_facts(spark, d).select("fact_id", "currency", F.when(F.abs("value") >= 1000, F.round("value", 2)).otherwise(F.round("value", 8)).alias("value"))


def src1_latest_facts(spark, d):
    return P.latest_facts(clean_facts(spark, d)).select("listing_id", "concept", "fiscal_period", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "fact_id")


def src2_newest_four_quarters(spark, d):
    rows = P.first_n_facts(clean_facts(spark, d), 4, ["Q1", "Q2", "Q3", "Q4"])
    return rows.select("listing_id", "concept", F.col("rn").cast("long").alias("rn"), "fact_id")


def src4_facts_in_scope(spark, d):
    """Facts of two concepts for listings that are primary in the newest snapshot: a semi-join, and the concepts reach the scan."""
    listings = read_table(spark, d, "listings")
    newest = listings.agg(F.max("snapshot_date").alias("snapshot_date"))
    scope = latest_by(listings.join(F.broadcast(newest), "snapshot_date", "left_semi"), ["listing_id"], ["delivered_at"]).filter(F.lower(S.trimmed("status")) == "primary")
    return read_table(spark, d, "financial_facts").filter(F.col("concept").isin("Revenues", "Assets")).join(scope, "listing_id", "left_semi").select("fact_id")


def src5_share_count(spark, d):
    """The diagnostic share count: newest date, common before entity, then quarters before the year, the smaller value, the later filing."""
    rows = clean_facts(spark, d).filter(F.col("concept").isin("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding"))
    order = [F.desc("end_date"), F.asc("concept"), F.when(F.col("fiscal_period").rlike("^Q[1-4]$"), 5 - F.substring("fiscal_period", 2, 1).cast("int")).otherwise(5), F.abs("value"), F.desc_nulls_last("filed"), F.asc("fact_id")]
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy("listing_id").orderBy(*order))).filter("rn = 1").select("listing_id", "concept", _r("value"), "fact_id")


def src10_descriptions(spark, d):
    rows = latest_by(read_table(spark, d, "securities"), ["security_id"], ["updated_at"])
    return rows.select("security_id", S.symbol_part("canonical_symbol").alias("symbol"), S.exchange_part("canonical_symbol").alias("exchange"), F.initcap(S.trimmed("sector")).alias("sector"))


def src11_metric_matrix(spark, d):
    """Values of three metrics side by side, each the newest of its listing."""
    rows = read_table(spark, d, "metrics").filter(F.col("metric_id").isin("current_ratio", "price_to_book", "eps_ttm") & F.col("value").isNotNull() & ~F.isnan("value"))
    rows = rows.groupBy("listing_id", "metric_id").agg(F.max_by("value", F.struct("as_of", "value")).alias("value"))
    return rows.groupBy("listing_id").pivot("metric_id", ["current_ratio", "eps_ttm", "price_to_book"]).agg(F.first("value"))


def flt5_fresh_listings(spark, d):
    rows = read_table(spark, d, "financial_facts").filter((F.col("end_date") >= F.date_sub(reference(), P.MAX_AGE)) & (F.col("end_date") <= reference()))
    return rows.groupBy("listing_id").agg(F.bool_or(F.col("concept") == "Revenues").alias("has_revenues"), F.count("*").alias("n"))


def flt13_violations(spark, d):
    """Rows that break the rules of the fact table, by rule."""
    f = read_table(spark, d, "financial_facts")
    rules = {
        "monetary without currency": S.is_monetary("unit_kind") & F.col("currency").isNull(),
        "currency without money": ~S.is_monetary("unit_kind") & F.col("currency").isNotNull(),
        "currency of wrong shape": F.col("currency").isNotNull() & ~F.coalesce(F.col("currency").rlike("^[A-Z]{3}$"), F.lit(False)),
        "filler date": F.col("end_date").isin(*(F.to_date(F.lit(x)) for x in ("1900-01-01", "2099-12-31"))),
        "filed before its end": F.col("filed") < F.col("end_date"),
    }
    counts = f.agg(*(F.count_if(rule).alias(name) for name, rule in rules.items()))
    return counts.unpivot([], list(rules), "rule", "n")


def agg1_coverage_by_exchange(spark, d):
    """Listings of each exchange: stored, missing, stale and fresh by the newest fetch."""
    raw = read_table(spark, d, "fundamentals_raw").groupBy(F.col("provider_listing_id").alias("security_id")).agg(F.max("last_fetched_at").alias("fetched"))
    rows = latest_by(read_table(spark, d, "securities"), ["security_id"], ["updated_at"]).join(raw, "security_id", "left")
    cutoff = F.date_sub(reference(), 90).cast("timestamp")
    return rows.groupBy(F.upper(S.trimmed("canonical_exchange_code")).alias("exchange")).agg(
        F.count("*").alias("listings"), F.count("fetched").alias("stored"), F.count_if(F.col("fetched").isNull()).alias("missing"), F.count_if(F.col("fetched") <= cutoff).alias("stale")
    )


def agg4_fx_coverage(spark, d):
    rows = read_table(spark, d, "fx_rates").groupBy("base_currency", "quote_currency", "rate_date").agg(F.max("rate").alias("rate"))
    gap = F.datediff("rate_date", F.lag("rate_date").over(Window.partitionBy("base_currency", "quote_currency").orderBy("rate_date")))
    rows = rows.withColumn("gap", gap).groupBy("base_currency", "quote_currency").agg(F.count("*").alias("days"), F.min("rate_date").alias("a"), F.max("rate_date").alias("b"), F.max("gap").cast("long").alias("longest_gap"))
    return rows.select("base_currency", "quote_currency", "days", F.date_format("a", "yyyy-MM-dd").alias("first_date"), F.date_format("b", "yyyy-MM-dd").alias("last_date"), "longest_gap")


def agg5_concept_freshness(spark, d):
    newest = read_table(spark, d, "financial_facts").filter(F.col("end_date") <= reference()).groupBy("listing_id", "concept").agg(F.max("end_date").alias("newest"))
    fresh = F.col("newest") >= F.date_sub(reference(), P.MAX_AGE)
    total = read_table(spark, d, "financial_facts").select("listing_id").distinct().agg(F.count("*").alias("total"))
    out = newest.groupBy("concept").agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"), F.count("*").alias("present"))
    return out.join(F.broadcast(total)).select("concept", "fresh", "stale", (F.col("total") - F.col("present")).alias("missing"))


def agg13_currencies(spark, d):
    a = read_table(spark, d, "financial_facts").select(S.currency_code("currency").alias("code")).distinct()
    b = read_table(spark, d, "listings").select(S.currency_code("currency").alias("code")).distinct()
    return a.union(b).distinct().filter("code IS NOT NULL")


def join6_listings_without_payload(spark, d):
    ids = read_table(spark, d, "securities").select("security_id").distinct()
    return ids.join(read_table(spark, d, "fundamentals_raw").select(F.col("provider_listing_id").alias("security_id")), "security_id", "left_anti")


def join9_debt_by_period(spark, d):
    """Balance concepts side by side by end date and period: one aggregation in place of full outer joins."""
    names = ["Assets", "Liabilities", "LongTermDebt"]
    rows = clean_facts(spark, d).filter(F.col("concept").isin(*names)).groupBy("listing_id", "end_date", "fiscal_period").pivot("concept", names).agg(F.round(F.max("value"), 4))
    return rows.select("listing_id", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "fiscal_period", *(F.col(n).alias(n.lower()) for n in names))


def win2_ttm(spark, d):
    out = P.ttm_windows(clean_facts(spark, d).filter(F.col("concept").isin(*FLOWS)), reference())
    return out.select("listing_id", "concept", "cadence", F.round("value", 2).alias("value"), F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "failure")


def win2_ttm_or_year(spark, d):
    out = P.ttm_windows(clean_facts(spark, d).filter(F.col("concept").isin(*FLOWS)), reference(), annual_max_age=P.MAX_AGE_FY)
    return out.select("listing_id", "concept", "cadence", F.round("value", 2).alias("value"), F.date_format("as_of", "yyyy-MM-dd").alias("as_of"), "failure")


#: Concepts that are sums over a period.
FLOWS = ("Revenues", "CostOfRevenue", "GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss", "NetCashProvidedByOperatingActivities", "DepreciationAndAmortization", "InterestExpense", "EarningsPerShare")


def win4_by_year(spark, d):
    return P.by_year(clean_facts(spark, d)).select("listing_id", "concept", "year", "fact_id")


def win5_strict_three_years(spark, d):
    rows = P.strict_years(P.by_year(clean_facts(spark, d)), 3)
    return rows.groupBy("listing_id", "concept").agg(F.max("year").alias("last_year"), F.round(F.avg("value"), 2).alias("mean"), F.count_if(F.col("value") < 0).alias("negative_years"))


def win6_chain_of_years(spark, d):
    rows = P.consecutive_years(P.by_year(clean_facts(spark, d)), 10, 2)
    return rows.groupBy("listing_id", "concept").agg(F.count("*").alias("years"), F.min("year").alias("first_year"), F.round(F.median("value"), 2).alias("median"))


def win12_profit_streak(spark, d):
    return P.streak(clean_facts(spark, d).filter("concept = 'NetIncomeLoss'"), F.col("value") > 0).select("listing_id", "streak", F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


def win14_sector_midrank(spark, d):
    """Midrank percentile of each listing's newest book multiple within its sector."""
    rows = src11_metric_matrix(spark, d).filter(F.col("price_to_book").isNotNull() & (F.abs("price_to_book") != float("inf"))).join(src10_descriptions(spark, d).select(F.col("security_id").alias("listing_id"), "sector"), "listing_id")
    by = Window.partitionBy("sector")
    midrank = (F.rank().over(by.orderBy("price_to_book")) - 1 + 0.5 * F.count("*").over(Window.partitionBy("sector", "price_to_book"))) / F.count("*").over(by)
    return rows.select("listing_id", "sector", F.round(midrank, 6).alias("midrank"))


def fx_rates_as_of(spark, d):
    """The rate of every currency and end date of the facts to USD, with its kind: through the as-of candidates."""
    keys = read_table(spark, d, "financial_facts").select(S.currency_code("currency").alias("base"), F.lit("USD").alias("quote"), F.col("end_date").alias("on_date"))
    out = fx.rates_for(keys, read_table(spark, d, "fx_rates"))
    return out.select("base", F.date_format("on_date", "yyyy-MM-dd").alias("on_date"), F.round("rate", 9).alias("rate"), F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), F.col("kind").cast("long").alias("kind"), "is_stale")


def fx7_aligned_facts(spark, d):
    """Facts in the currency of their listing's newest snapshot; those without a rate are left out."""
    listing = latest_by(read_table(spark, d, "listings"), ["listing_id"], ["snapshot_date", "delivered_at"]).select("listing_id", S.currency_code("currency").alias("target"))
    facts = clean_facts(spark, d).filter(S.is_monetary("unit_kind")).join(listing, "listing_id")
    out = fx.convert(facts, "value", "currency", "end_date", "target", read_table(spark, d, "fx_rates"))
    return out.filter("converted IS NOT NULL").select("fact_id", "target", F.when(F.abs("converted") >= 1000, F.floor("converted").cast("double")).otherwise(F.round("converted", 6)).alias("converted"))


_D = "strftime({0}, '%Y-%m-%d') AS {1}"
_CODE = "CASE upper(trim({0})) WHEN 'GBX' THEN 'GBP' WHEN 'GBP0.01' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE upper(trim({0})) END"
_SECURITIES = "(SELECT * FROM securities QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY updated_at DESC) = 1)"
_INITCAP = r"array_to_string(list_transform(string_split(lower(trim(sector)), ' '), lambda x: upper(x[1]) || x[2:]), ' ')"
_FLOWS = ", ".join(f"'{c}'" for c in FLOWS)
_TTM = f"""
WITH {O.CLEAN}, q AS (
  SELECT * FROM clean WHERE fiscal_period IN ('Q1', 'Q2', 'Q3', 'Q4') AND concept IN ({_FLOWS})
  QUALIFY row_number() OVER (PARTITION BY listing_id, concept, end_date ORDER BY filed DESC NULLS LAST, {O.PERIOD_RANK}) = 1
), r AS (
  SELECT *, row_number() OVER w AS rn, date_diff('day', lead(end_date) OVER w, end_date) AS gap, count(*) OVER (PARTITION BY listing_id, concept) AS n
  FROM q WINDOW w AS (PARTITION BY listing_id, concept ORDER BY end_date DESC)
), a AS (
  SELECT listing_id, concept, max(n) AS n, max(end_date) AS newest, max(gap) FILTER (rn = 1) AS g1, max(gap) FILTER (rn = 2) AS g2, max(gap) FILTER (rn = 3) AS g3,
    sum(value) FILTER (rn <= 4) AS s4, sum(value) FILTER (rn <= 2) AS s2
  FROM r GROUP BY 1, 2
), y AS (
  SELECT listing_id, concept, max(end_date) AS fy_end, arg_max(value, end_date) AS fy_value FROM clean WHERE fiscal_period = 'FY' AND concept IN ({_FLOWS}) GROUP BY 1, 2
), b AS (
  SELECT *, n >= 4 AND g1 BETWEEN 70 AND 110 AND g2 BETWEEN 70 AND 110 AND g3 BETWEEN 70 AND 110 AS four, g1 BETWEEN 150 AND 220 AND (n = 2 OR coalesce(g2 BETWEEN 150 AND 220, false)) AS two,
    newest < DATE '{REFERENCE_DATE}' - 400 AS old
  FROM a FULL JOIN y USING (listing_id, concept)
), c AS (
  SELECT *, CASE WHEN coalesce(n, 0) < 2 OR old THEN NULL WHEN coalesce(four, false) THEN 'quarterly' WHEN coalesce(two, false) THEN 'semi_annual' END AS cad,
    CASE WHEN coalesce(n, 0) < 2 THEN 'too_few' WHEN old THEN 'too_old' WHEN coalesce(four, false) OR coalesce(two, false) THEN NULL WHEN g1 BETWEEN 70 AND 110 AND n < 4 THEN 'too_few' ELSE 'no_cadence' END AS fail
  FROM b
)
"""


SQL = {
    "src_clean_facts": f"WITH {O.CLEAN} SELECT fact_id, currency, CASE WHEN abs(value) >= 1000 THEN round(value, 2) ELSE round(value, 8) END AS value FROM clean",
    "src1_latest_facts": f"WITH {O.CLEAN} SELECT listing_id, concept, fiscal_period, {_D.format('end_date', 'end_date')}, fact_id FROM clean QUALIFY row_number() OVER (PARTITION BY listing_id, concept ORDER BY {O.NEWEST}) = 1",
    "src2_newest_four_quarters": f"WITH {O.CLEAN} SELECT listing_id, concept, row_number() OVER (PARTITION BY listing_id, concept ORDER BY {O.NEWEST}) AS rn, fact_id FROM clean WHERE fiscal_period LIKE 'Q%' QUALIFY rn <= 4",
    "src4_facts_in_scope": """SELECT fact_id FROM financial_facts WHERE concept IN ('Revenues', 'Assets') AND listing_id IN (
        SELECT listing_id FROM (SELECT * FROM listings WHERE snapshot_date = (SELECT max(snapshot_date) FROM listings)
        QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY delivered_at DESC) = 1) WHERE lower(trim(status)) = 'primary')""",
    "src5_share_count": f"""WITH {O.CLEAN} SELECT listing_id, concept, round(value, 4) AS value, fact_id FROM clean WHERE concept IN ('CommonStockSharesOutstanding', 'EntityCommonStockSharesOutstanding')
        QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY end_date DESC, concept, CASE fiscal_period WHEN 'Q4' THEN 1 WHEN 'Q3' THEN 2 WHEN 'Q2' THEN 3 WHEN 'Q1' THEN 4 ELSE 5 END, abs(value), filed DESC NULLS LAST, fact_id) = 1""",
    "src10_descriptions": rf"""SELECT security_id, upper(trim(regexp_extract(canonical_symbol, '^(.*)\.([^.]+)$', 1))) AS symbol, upper(trim(regexp_extract(canonical_symbol, '^(.*)\.([^.]+)$', 2))) AS exchange, {_INITCAP} AS sector FROM {_SECURITIES}""",
    "src11_metric_matrix": """WITH n AS (SELECT listing_id, metric_id, value FROM metrics WHERE metric_id IN ('current_ratio', 'price_to_book', 'eps_ttm') AND value IS NOT NULL AND NOT isnan(value)
        QUALIFY row_number() OVER (PARTITION BY listing_id, metric_id ORDER BY as_of DESC, value DESC) = 1)
        SELECT listing_id, max(value) FILTER (metric_id = 'current_ratio') AS current_ratio, max(value) FILTER (metric_id = 'eps_ttm') AS eps_ttm, max(value) FILTER (metric_id = 'price_to_book') AS price_to_book FROM n GROUP BY 1""",
    "flt5_fresh_listings": f"SELECT listing_id, bool_or(concept = 'Revenues') AS has_revenues, count(*) AS n FROM financial_facts WHERE end_date BETWEEN DATE '{REFERENCE_DATE}' - 400 AND DATE '{REFERENCE_DATE}' GROUP BY 1",
    "flt13_violations": """SELECT 'monetary without currency' AS rule, count(*) AS n FROM financial_facts WHERE unit_kind IN ('monetary', 'per_share') AND currency IS NULL
        UNION ALL SELECT 'currency without money', count(*) FROM financial_facts WHERE unit_kind NOT IN ('monetary', 'per_share') AND currency IS NOT NULL
        UNION ALL SELECT 'currency of wrong shape', count(*) FROM financial_facts WHERE NOT regexp_full_match(currency, '[A-Z]{3}')
        UNION ALL SELECT 'filler date', count(*) FROM financial_facts WHERE end_date IN (DATE '1900-01-01', DATE '2099-12-31')
        UNION ALL SELECT 'filed before its end', count(*) FROM financial_facts WHERE filed < end_date""",
    "agg1_coverage_by_exchange": f"""SELECT upper(trim(canonical_exchange_code)) AS exchange, count(*) AS listings, count(fetched) AS stored, count(*) FILTER (fetched IS NULL) AS missing,
        count(*) FILTER (fetched <= CAST(DATE '{REFERENCE_DATE}' - 90 AS TIMESTAMP)) AS stale
        FROM {_SECURITIES} s LEFT JOIN (SELECT provider_listing_id, max(last_fetched_at) AS fetched FROM fundamentals_raw GROUP BY 1) r ON r.provider_listing_id = s.security_id GROUP BY 1""",
    "agg4_fx_coverage": """WITH r AS (SELECT DISTINCT base_currency, quote_currency, rate_date FROM fx_rates),
        g AS (SELECT *, date_diff('day', lag(rate_date) OVER (PARTITION BY base_currency, quote_currency ORDER BY rate_date), rate_date) AS gap FROM r)
        SELECT base_currency, quote_currency, count(*) AS days, strftime(min(rate_date), '%Y-%m-%d') AS first_date, strftime(max(rate_date), '%Y-%m-%d') AS last_date, max(gap) AS longest_gap FROM g GROUP BY 1, 2""",
    "agg5_concept_freshness": f"""WITH n AS (SELECT listing_id, concept, max(end_date) AS newest FROM financial_facts WHERE end_date <= DATE '{REFERENCE_DATE}' GROUP BY 1, 2)
        SELECT concept, count(*) FILTER (newest >= DATE '{REFERENCE_DATE}' - 400) AS fresh, count(*) FILTER (newest < DATE '{REFERENCE_DATE}' - 400) AS stale,
        (SELECT count(DISTINCT listing_id) FROM financial_facts) - count(*) AS missing FROM n GROUP BY 1""",
    "agg13_currencies": f"SELECT code FROM (SELECT {_CODE.format('currency')} AS code FROM financial_facts UNION SELECT {_CODE.format('currency')} FROM listings) WHERE code IS NOT NULL",
    "join6_listings_without_payload": "SELECT DISTINCT security_id FROM securities WHERE security_id NOT IN (SELECT provider_listing_id FROM fundamentals_raw WHERE provider_listing_id IS NOT NULL)",
    "join9_debt_by_period": f"""WITH {O.CLEAN} SELECT listing_id, {_D.format('end_date', 'end_date')}, fiscal_period, round(max(value) FILTER (concept = 'Assets'), 4) AS assets, round(max(value) FILTER (concept = 'Liabilities'), 4) AS liabilities,
        round(max(value) FILTER (concept = 'LongTermDebt'), 4) AS longtermdebt FROM clean WHERE concept IN ('Assets', 'Liabilities', 'LongTermDebt') GROUP BY listing_id, clean.end_date, fiscal_period""",
    "win2_ttm": _TTM + "SELECT listing_id, concept, cad AS cadence, round(CASE cad WHEN 'quarterly' THEN s4 WHEN 'semi_annual' THEN s2 END, 2) AS value, CASE WHEN cad IS NOT NULL THEN strftime(newest, '%Y-%m-%d') END AS as_of, fail AS failure FROM c WHERE n IS NOT NULL",
    "win2_ttm_or_year": _TTM + f"""SELECT listing_id, concept, CASE WHEN annual THEN 'annual' ELSE cad END AS cadence, round(CASE WHEN annual THEN fy_value WHEN cad = 'quarterly' THEN s4 WHEN cad = 'semi_annual' THEN s2 END, 2) AS value,
        CASE WHEN annual THEN strftime(fy_end, '%Y-%m-%d') WHEN cad IS NOT NULL THEN strftime(newest, '%Y-%m-%d') END AS as_of, CASE WHEN NOT annual THEN fail END AS failure
        FROM (SELECT *, cad IS NULL AND coalesce(fy_end >= DATE '{REFERENCE_DATE}' - 480, false) AS annual FROM c)""",
    "win4_by_year": f"WITH {O.CLEAN} SELECT listing_id, concept, year(end_date) AS year, fact_id FROM clean WHERE fiscal_period = 'FY' QUALIFY row_number() OVER (PARTITION BY listing_id, concept, year(end_date) ORDER BY end_date DESC, filed DESC NULLS LAST) = 1",
    "win5_strict_three_years": f"""WITH {O.CLEAN}, y AS (SELECT *, year(end_date) AS yr FROM clean WHERE fiscal_period = 'FY' QUALIFY row_number() OVER (PARTITION BY listing_id, concept, yr ORDER BY end_date DESC, filed DESC NULLS LAST) = 1),
        z AS (SELECT *, max(yr) OVER (PARTITION BY listing_id, concept) AS top FROM y)
        SELECT listing_id, concept, max(yr) AS last_year, round(avg(value), 2) AS mean, count(*) FILTER (value < 0) AS negative_years FROM z WHERE yr > top - 3 GROUP BY 1, 2 HAVING count(*) = 3""",
    "win6_chain_of_years": f"""WITH {O.CLEAN}, y AS (SELECT *, year(end_date) AS yr FROM clean WHERE fiscal_period = 'FY' QUALIFY row_number() OVER (PARTITION BY listing_id, concept, yr ORDER BY end_date DESC, filed DESC NULLS LAST) = 1),
        z AS (SELECT *, yr + row_number() OVER (PARTITION BY listing_id, concept ORDER BY yr DESC) AS island, max(yr) OVER (PARTITION BY listing_id, concept) + 1 AS top FROM y)
        SELECT listing_id, concept, count(*) AS years, min(yr) AS first_year, round(median(value), 2) AS median FROM z WHERE island = top AND yr >= top - 10 GROUP BY 1, 2 HAVING count(*) >= 2""",
    "win12_profit_streak": f"""WITH {O.CLEAN}, r AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY {O.NEWEST}) AS rn FROM clean WHERE concept = 'NetIncomeLoss' AND fiscal_period = 'FY')
        SELECT listing_id, coalesce(min(rn) FILTER (value <= 0), max(rn) + 1) - 1 AS streak, strftime(max(end_date), '%Y-%m-%d') AS as_of FROM r GROUP BY 1""",
    "win14_sector_midrank": f"""WITH n AS (SELECT listing_id, value FROM metrics WHERE metric_id = 'price_to_book' AND value IS NOT NULL AND NOT isnan(value)
        QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY as_of DESC, value DESC) = 1),
        s AS (SELECT n.listing_id, n.value, {_INITCAP} AS sector FROM n JOIN {_SECURITIES} t ON t.security_id = n.listing_id WHERE NOT isinf(value))
        SELECT listing_id, sector, round((rank() OVER (PARTITION BY sector ORDER BY value) - 1 + 0.5 * count(*) OVER (PARTITION BY sector, value)) / count(*) OVER (PARTITION BY sector), 6) AS midrank FROM s""",
    "fx_rates_as_of": f"""WITH k AS (SELECT DISTINCT {_CODE.format('currency')} AS base, end_date AS on_date FROM financial_facts WHERE currency IS NOT NULL),
        r AS (SELECT * FROM fx_rates QUALIFY row_number() OVER (PARTITION BY base_currency, quote_currency, rate_date ORDER BY updated_at DESC, rate DESC) = 1),
        ri AS (SELECT base_currency, quote_currency, rate_date, 1.0 / rate AS rate FROM fx_rates QUALIFY row_number() OVER (PARTITION BY base_currency, quote_currency, rate_date ORDER BY updated_at DESC, 1.0 / rate DESC) = 1),
        legs AS (SELECT base_currency AS b, quote_currency AS q, rate_date, rate, 3 AS kind FROM r UNION ALL SELECT quote_currency, base_currency, rate_date, rate, 2 FROM ri),
        bl AS (SELECT k.base, p.q AS quote, k.on_date, l.rate, l.rate_date, l.kind FROM k CROSS JOIN (VALUES ('USD'), ('EUR'), ('GBP')) p(q) JOIN legs l ON l.b = k.base AND l.q = p.q AND l.rate_date <= k.on_date
          QUALIFY row_number() OVER (PARTITION BY k.base, p.q, k.on_date ORDER BY l.rate_date DESC, l.kind DESC) = 1),
        pl AS (SELECT p.p, k.on_date, l.rate, l.rate_date FROM (SELECT DISTINCT on_date FROM k) k CROSS JOIN (VALUES ('EUR'), ('GBP')) p(p) JOIN legs l ON l.b = p.p AND l.q = 'USD' AND l.rate_date <= k.on_date
          QUALIFY row_number() OVER (PARTITION BY p.p, k.on_date ORDER BY l.rate_date DESC, l.kind DESC) = 1),
        cand AS (SELECT base, on_date, 1.0 AS rate, on_date AS rate_date, 5 AS kind, 0 AS pr FROM k WHERE base = 'USD'
          UNION ALL SELECT base, on_date, rate, rate_date, kind, 0 FROM bl WHERE quote = 'USD'
          UNION ALL SELECT bl.base, bl.on_date, bl.rate * pl.rate, least(bl.rate_date, pl.rate_date), 1, CASE bl.quote WHEN 'EUR' THEN 2 ELSE 1 END FROM bl JOIN pl ON pl.p = bl.quote AND pl.on_date = bl.on_date WHERE bl.base <> bl.quote)
        SELECT base, strftime(on_date, '%Y-%m-%d') AS on_date, round(rate, 9) AS rate, strftime(rate_date, '%Y-%m-%d') AS rate_date, kind, date_diff('day', rate_date, cand.on_date) > 7 AS is_stale FROM cand
        QUALIFY row_number() OVER (PARTITION BY base, cand.on_date ORDER BY cand.rate_date DESC, kind DESC, pr DESC) = 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        src_clean_facts, src1_latest_facts, src2_newest_four_quarters, src4_facts_in_scope, src5_share_count, src10_descriptions, src11_metric_matrix, flt5_fresh_listings, flt13_violations,
        agg1_coverage_by_exchange, agg4_fx_coverage, agg5_concept_freshness, agg13_currencies, join6_listings_without_payload, join9_debt_by_period, win2_ttm, win2_ttm_or_year, win4_by_year,
        win5_strict_three_years, win6_chain_of_years, win12_profit_streak, win14_sector_midrank, fx_rates_as_of, fx7_aligned_facts,
    )
}


#: Names of the project's concepts where the metrics use another (fixed values).
ALIASES = {"NetCashProvidedByOperatingActivities": "NetCashProvidedByUsedInOperatingActivities", "DepreciationAndAmortization": "DepreciationDepletionAndAmortization", "MarketCapitalization": "ProviderMarketCapitalization"}


def metric_facts(spark, d):
    """Clean facts under the metrics' names."""
    names = F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))
    return clean_facts(spark, d).withColumn("concept", F.coalesce(names[F.col("concept")], F.col("concept")))


def met_all(spark, d):
    """Every metric of every listing that can be computed from the facts (prices are not among the tables)."""
    from factloom.metrics.registry import compute_metrics

    out = compute_metrics(metric_facts(spark, d), reference())
    return out.select("listing_id", "metric_id", "unit_kind", F.round("value", 6).alias("value"), F.date_format("as_of", "yyyy-MM-dd").alias("as_of"))


QUERIES["met_all"] = met_all
SQL["fx7_aligned_facts"] = f"""WITH {O.CLEAN}, l AS (SELECT listing_id, {_CODE.format('currency')} AS target FROM listings QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY listings.snapshot_date DESC, delivered_at DESC) = 1),
  m AS (SELECT fact_id, value, currency, end_date, target FROM clean JOIN l USING (listing_id) WHERE unit_kind IN ('monetary', 'per_share')), k AS (SELECT currency AS base, target AS quote, end_date AS on_date FROM m), {O.rates_sql("k")},
  c AS (SELECT fact_id, target, CASE WHEN currency = target THEN value ELSE value * rate END AS x FROM m LEFT JOIN rated ON rated.base = m.currency AND rated.quote = m.target AND rated.on_date = m.end_date)
  SELECT fact_id, target, CASE WHEN abs(x) >= 1000 THEN CAST(floor(x) AS DOUBLE) ELSE round(x, 6) END AS converted FROM c WHERE x IS NOT NULL"""
