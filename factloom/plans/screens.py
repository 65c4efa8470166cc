"""Screens, ranking, listings and upserts on the project's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators.latest import latest_by
from factloom.operators.materialize import materialize
from factloom.operators.normalize import facts_from_entries, in_target_currency, unit_flips, with_derived_facts, with_implied_eps
from factloom.operators.ranking import score
from factloom.operators.universe import DEPOSITARY, PRIMARY_US_VENUES, claim_representatives, classify, fill_missing, group_issuers, newest_identities, rescue_sole_listings
from factloom.operators.upsert import changed_payloads, upsert
from factloom.plans import normalize_sql
from factloom.plans import oracle as O
from factloom.plans.fundamentals import _INITCAP, _SECURITIES, REFERENCE_DATE, clean_facts, reference, src10_descriptions
from factloom.plans.records import payload_rows
from factloom.plans.screen import align, aligned_input, fallout, parse_screen, rank_inputs, run_screen, screen_details, screen_input
from factloom.sources.tables import read_table

#: A screen in the form of a parsed YAML file.
SCREEN = {
    "criteria": [
        {"name": "solid", "left": {"metric": "current_ratio"}, "operator": ">=", "right": {"value": 0.08}},
        {
            "name": "two of three", "at_least": 2,
            "any_of": [
                {"name": "cheap", "left": {"metric": "price_to_book"}, "operator": "<=", "right": {"value": 1.5}},
                {"name": "earning", "left": {"metric": "roce_ttm"}, "operator": ">", "right": {"metric": "croic", "multiplier": 0.5}},
                {"name": "steady", "left": {"metric": "eps_streak"}, "operator": ">=", "right": {"value": 3}},
            ],
        },
    ],
    "ranking": {
        "metrics": [{"metric": "price_to_book", "weight": 2, "direction": "lower"}, {"metric": "roce_ttm", "weight": 1, "cap": 50}],
        "tie_breakers": [{"metric": "eps_streak", "direction": "descending"}], "min_sector_peers": 10, "winsorize": {"lower_percentile": 5, "upper_percentile": 95},
    },
}


def _wide(spark, d):
    screen = parse_screen(SCREEN)
    rows = read_table(spark, d, "metrics").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != -999999.0) & (F.abs("value") != float("inf")))
    return screen_input(rows, screen.metric_ids()), screen


def scr_passers(spark, d):
    return run_screen(*_wide(spark, d)).select("listing_id", F.col("g0").alias("solid"), F.col("g1").alias("reported"))


def scr_details(spark, d):
    return screen_details(*_wide(spark, d)).select("listing_id", "criterion", "verdict", F.concat_ws(",", "missing").alias("missing"))


def scr_fallout(spark, d):
    return fallout(*_wide(spark, d))


def rnk_scores(spark, d):
    wide, screen = _wide(spark, d)
    named = src10_descriptions(spark, d).select(F.col("security_id").alias("listing_id"), "sector")
    passers = run_screen(wide, screen).select("listing_id", "price_to_book", "roce_ttm", "eps_streak").join(named, "listing_id", "left").withColumn("symbol", F.lpad(F.col("listing_id").cast("string"), 12, "0"))
    return score(passers, screen.ranking).select("listing_id", F.round("score", 6).alias("score"), "rank")


#: A screen over amounts in the currencies of their listings.
MONEY_SCREEN = {
    "criteria": [
        {"name": "large", "left": {"metric": "market_cap"}, "operator": ">=", "right": {"value": 2.0e8, "currency": "USD"}},
        {"name": "covered", "left": {"metric": "enterprise_value"}, "operator": ">=", "right": {"metric": "working_capital", "multiplier": 0.5}},
        {"name": "either", "any_of": [{"name": "odd", "left": {"metric": "working_capital"}, "operator": ">", "right": {"metric": "current_ratio"}}, {"name": "cheap", "left": {"metric": "price_to_book"}, "operator": "<=", "right": {"metric": "croic", "multiplier": 3.0}}]},
    ],
    "ranking": {"metrics": [{"metric": "market_cap"}, {"metric": "price_to_book", "direction": "lower"}]},
}


def _usable(spark, d):
    return read_table(spark, d, "metrics").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("value") != -999999.0) & (F.abs("value") != float("inf")))


def scr_mixed_currencies(spark, d):
    """Verdicts with amounts brought to one currency, and what stood against a comparison."""
    screen = parse_screen(MONEY_SCREEN)
    wide, screen = align(aligned_input(_usable(spark, d), screen.metric_ids()), screen, read_table(spark, d, "fx_rates"))
    issues = wide.select("listing_id", F.concat_ws(",", F.array_compact(F.array(*(F.col(c) for c in wide.columns if c.endswith("issue"))))).alias("issues"))
    return screen_details(wide, screen).select("listing_id", "criterion", "verdict").join(issues, "listing_id")


def rnk_mixed_currencies(spark, d):
    """The inputs of a ranking of all listings in dollars."""
    screen = parse_screen(MONEY_SCREEN)
    wide = aligned_input(_usable(spark, d), ["market_cap", "price_to_book"])
    out = rank_inputs(wide, screen.ranking, read_table(spark, d, "fx_rates"), "USD")
    return out.select("listing_id", F.floor("market_cap").cast("double").alias("market_cap"), F.round("price_to_book", 6).alias("price_to_book"))


def _evidence(spark, d):
    return fill_missing(read_table(spark, d, "listing_evidence"), ["listing_id"], ["provider_symbol", "primary_ticker", "home_category", "isin", "lei", "venue_tier"], "fetched_at")


def uni1_classification(spark, d):
    return classify(_evidence(spark, d))


def uni2_rescued(spark, d):
    evidence = materialize(_evidence(spark, d), "evidence")
    return rescue_sole_listings(classify(evidence), evidence)


def uni3_issuer_groups(spark, d):
    return group_issuers(newest_identities(read_table(spark, d, "listing_evidence"), "fetched_at"))


def uni4_representatives(spark, d):
    """The issuer that stands for each group, of the issuers of its listings in the newest snapshot."""
    owners = latest_by(read_table(spark, d, "listings").select("listing_id", "issuer_id", "snapshot_date", "delivered_at"), ["listing_id"], ["snapshot_date", "delivered_at"])
    return claim_representatives(uni3_issuer_groups(spark, d).join(owners.select("listing_id", "issuer_id"), "listing_id"))


def uni5_completed_evidence(spark, d):
    return fill_missing(read_table(spark, d, "listing_evidence"), ["listing_id"], ["primary_ticker", "isin", "lei", "venue_tier"], "fetched_at")


def snk2_upserted_listings(spark, d):
    """The newest snapshot written over all earlier ones, by listing."""
    rows = read_table(spark, d, "listings").select("listing_id", "symbol", "status", "snapshot_date", "delivered_at")
    last = rows.agg(F.max("snapshot_date").alias("snapshot_date"))
    old = latest_by(rows.join(F.broadcast(last), "snapshot_date", "left_anti"), ["listing_id"], ["snapshot_date", "delivered_at"]).select(*rows.columns)
    new = rows.join(F.broadcast(last), "snapshot_date", "left_semi").select(*rows.columns)
    out = upsert(old, new, ["listing_id"], ["delivered_at"])
    return out.select("listing_id", F.upper(S.trimmed("symbol")).alias("symbol"), F.lower(S.trimmed("status")).alias("status"), F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"))


def norm9_changed_payloads(spark, d):
    """Payloads fetched in the last month that were not there before with the same hash."""
    raw = read_table(spark, d, "fundamentals_raw").select("provider_listing_id", "payload_hash", "last_fetched_at")
    cut = F.date_sub(reference(), 30).cast("timestamp")
    return changed_payloads(raw.filter(F.col("last_fetched_at") >= cut), raw.filter(F.col("last_fetched_at") < cut)).select("provider_listing_id", "payload_hash").distinct()


def rep_source_profile(spark, d):
    """Facts by source and period: rows, share without filing date, newest end date."""
    f = clean_facts(spark, d)
    return f.groupBy("source", "fiscal_period").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("filed").isNull()) / F.count("*"), 6).alias("unfiled"), F.date_format(F.max("end_date"), "yyyy-MM-dd").alias("newest"))


def _facts(spark, d):
    return materialize(facts_from_entries(materialize(payload_rows(spark, d), "payload-rows"), "provider_listing_id"), "facts")


def _shown(facts):
    value = F.when(F.abs("value") >= 1000, F.round("value", 2)).otherwise(F.round("value", 6)).alias("value")
    return facts.select("provider_listing_id", "concept", "fiscal_period", F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "unit_kind", value, F.date_format("filed", "yyyy-MM-dd").alias("filed"), "currency")


def norm1_facts(spark, d):
    """Facts of the newest payloads."""
    return _shown(_facts(spark, d))


def norm6_implied_eps(spark, d):
    out = with_implied_eps(_facts(spark, d), "provider_listing_id").filter("concept = 'EarningsPerShare'")
    return _shown(out).drop("filed")


def norm7_derived_facts(spark, d):
    return _shown(with_derived_facts(_facts(spark, d), "provider_listing_id"))


def fx7_normalized_facts(spark, d):
    """Facts of the newest payloads, derived ones too, in the currency of their listing's newest snapshot."""
    targets = latest_by(read_table(spark, d, "listings").select("listing_id", "currency", "snapshot_date", "delivered_at"), ["listing_id"], ["snapshot_date", "delivered_at"])
    targets = targets.select(F.col("listing_id").alias("provider_listing_id"), S.shaped_currency("currency").alias("target")).filter("target IS NOT NULL")
    facts = materialize(with_derived_facts(_facts(spark, d), "provider_listing_id"), "derived")
    return _shown(in_target_currency(facts, "provider_listing_id", targets, read_table(spark, d, "fx_rates")))


def win13_unit_flips(spark, d):
    """Earnings per share recorded in hundredths for a while: values as delivered, one per series and date (the latest filing)."""
    rows = read_table(spark, d, "financial_facts").filter("concept = 'EarningsPerShare' AND fiscal_period IN ('Q1', 'Q2', 'Q3', 'Q4')")
    rows = rows.groupBy("listing_id", "source", "end_date").agg(F.max_by(F.struct("value", "fact_id"), F.struct(F.coalesce("filed", F.lit("0001-01-01").cast("date")), "fact_id")).alias("r")).select("listing_id", "source", "end_date", "r.*")
    return unit_flips(rows, ["listing_id", "source"], "end_date", "value").select("fact_id", "scale")


_IDS = ["current_ratio", "price_to_book", "roce_ttm", "croic", "eps_streak"]
_WIDE = "n AS (SELECT listing_id, metric_id, value FROM metrics WHERE metric_id IN ('current_ratio', 'price_to_book', 'roce_ttm', 'croic', 'eps_streak') AND value IS NOT NULL AND NOT isnan(value) AND value <> -999999.0 AND NOT isinf(value) QUALIFY row_number() OVER (PARTITION BY listing_id, metric_id ORDER BY as_of DESC, value DESC) = 1), w AS (SELECT listing_id, " + ", ".join(f"max(value) FILTER (metric_id = '{i}') AS {i}" for i in _IDS) + """ FROM n GROUP BY 1),
m AS (SELECT *, current_ratio >= 0.08 AS a, price_to_book <= 1.5 AS b, roce_ttm > croic * 0.5 AS c, eps_streak >= 3 AS e FROM w),
p AS (SELECT *, coalesce(a, false) AS p0, CAST(coalesce(b, false) AS INTEGER) + CAST(coalesce(c, false) AS INTEGER) + CAST(coalesce(e, false) AS INTEGER) >= 2 AS p1 FROM m)"""
_DETAIL = f"""WITH {_WIDE}, g AS (
  SELECT listing_id, 'solid' AS criterion, CASE WHEN p0 THEN 'passed' WHEN a IS NOT NULL THEN 'comparison_failed' ELSE 'na_blocked' END AS verdict, CASE WHEN current_ratio IS NULL THEN 'current_ratio' ELSE '' END AS missing FROM p
  UNION ALL SELECT listing_id, 'two of three', CASE WHEN p1 THEN 'passed' WHEN NOT coalesce(b, true) OR NOT coalesce(c, true) OR NOT coalesce(e, true) THEN 'comparison_failed' ELSE 'na_blocked' END,
    concat_ws(',', CASE WHEN price_to_book IS NULL THEN 'price_to_book' END, CASE WHEN roce_ttm IS NULL THEN 'roce_ttm' END, CASE WHEN croic IS NULL THEN 'croic' END, CASE WHEN eps_streak IS NULL THEN 'eps_streak' END) FROM p)"""


def _ranked(metric: str, value: str, higher: bool) -> str:
    def one(group: str, tag: str) -> str:
        part = f"PARTITION BY {group}" if group else ""
        sep = f"{group}, " if group else ""
        return f"""{metric}_{tag}0 AS (SELECT listing_id, sector, {value} AS v FROM t WHERE {metric} IS NOT NULL),
        {metric}_{tag}1 AS (SELECT *, greatest(quantile_cont(v, 0.05) OVER ({part}), least(quantile_cont(v, 0.95) OVER ({part}), v)) AS x FROM {metric}_{tag}0),
        {metric}_{tag} AS (SELECT listing_id, (rank() OVER ({part} ORDER BY x) - 1 + 0.5 * count(*) OVER (PARTITION BY {sep}x)) / count(*) OVER ({part}) AS p FROM {metric}_{tag}1)"""

    return one("sector", "s") + ",\n" + one("", "a")


_RANK_SQL = f"""WITH {_WIDE}, t AS (
  SELECT p.listing_id, price_to_book, roce_ttm, eps_streak, sector, sector IS NOT NULL AND count(*) OVER (PARTITION BY sector) >= 10 AS own
  FROM p LEFT JOIN (SELECT security_id, {_INITCAP} AS sector FROM {_SECURITIES}) s ON s.security_id = p.listing_id WHERE p0 AND p1),
{_ranked("price_to_book", "price_to_book", False)}, {_ranked("roce_ttm", "least(roce_ttm, 50.0)", True)},
z AS (SELECT t.*, coalesce(100 * (1 - CASE WHEN own THEN bs.p ELSE ba.p END), 50) AS s1, coalesce(100 * CASE WHEN own THEN rs.p ELSE ra.p END, 50) AS s2 FROM t
  LEFT JOIN price_to_book_s bs USING (listing_id) LEFT JOIN price_to_book_a ba USING (listing_id) LEFT JOIN roce_ttm_s rs USING (listing_id) LEFT JOIN roce_ttm_a ra USING (listing_id))
SELECT listing_id, round((2 * s1 + s2) / 3, 6) AS score, row_number() OVER (ORDER BY (2 * s1 + s2) / 3 DESC, eps_streak DESC NULLS LAST, listing_id) AS rank FROM z"""

_FILL = "(SELECT listing_id, " + ", ".join(f"arg_max({c}, (fetched_at, {c})) FILTER ({c} IS NOT NULL) AS {c}" for c in ("provider_symbol", "primary_ticker", "home_category", "isin", "lei", "venue_tier")) + " FROM listing_evidence GROUP BY 1)"
_TRIM = r"nullif(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '')"
_ISIN = rf"CASE WHEN regexp_full_match(upper({_TRIM.format('isin')}), '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN upper({_TRIM.format('isin')}) END"
_LEI = rf"CASE WHEN regexp_full_match(upper({_TRIM.format('lei')}), '[A-Z0-9]{{20}}') THEN upper({_TRIM.format('lei')}) END"
_CLASSES = f"""WITH r AS (SELECT listing_id, upper({_TRIM.format('provider_symbol')}) AS symbol, upper({_TRIM.format('primary_ticker')}) AS ticker, upper({_TRIM.format('home_category')}) AS home, {_ISIN} AS isin, {_LEI} AS lei, upper({_TRIM.format('venue_tier')}) AS venue FROM {_FILL}),
  x AS (SELECT *, EXISTS (SELECT 1 FROM r p WHERE p.isin = r.isin AND p.listing_id <> r.listing_id AND p.ticker IS NOT NULL) AS peers, EXISTS (SELECT 1 FROM r p WHERE p.isin = r.isin AND p.listing_id <> r.listing_id AND p.ticker = r.symbol) AS named FROM r),
  ru AS (SELECT *, CASE WHEN home IN ({", ".join(f"'{x}'" for x in DEPOSITARY)}) THEN 'R1' WHEN ticker IS NOT NULL THEN 'R2' WHEN peers THEN 'R3' ELSE 'R4' END AS rule FROM x),
  st AS (SELECT *, CASE rule WHEN 'R1' THEN 'secondary' WHEN 'R4' THEN 'unknown' WHEN 'R2' THEN CASE WHEN ticker = symbol THEN 'primary' ELSE 'secondary' END ELSE CASE WHEN named THEN 'primary' ELSE 'secondary' END END AS status FROM ru)"""
_GROUPS = f"""WITH sh AS (SELECT listing_id, fetched_at, {_ISIN} AS isin, {_LEI} AS lei FROM listing_evidence),
  r AS (SELECT listing_id, arg_max(isin, (fetched_at, isin)) FILTER (isin IS NOT NULL) AS isin, arg_max(lei, (fetched_at, lei)) FILTER (lei IS NOT NULL) AS lei FROM sh GROUP BY 1),
  i AS (SELECT isin, count(DISTINCT lei) AS n, min(lei) AS one FROM r WHERE isin IS NOT NULL GROUP BY 1),
  k AS (SELECT listing_id, CASE WHEN r.lei IS NOT NULL THEN 'L' || r.lei WHEN i.n = 1 THEN 'L' || i.one WHEN i.n = 0 THEN 'I' || r.isin ELSE 'N' || CAST(listing_id AS VARCHAR) END AS key FROM r LEFT JOIN i USING (isin)),
  g AS (SELECT listing_id, min(listing_id) OVER (PARTITION BY key) AS issuer_group FROM k)"""
_LATEST = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, concept ORDER BY {O.NEWEST}) AS rn FROM clean) WHERE rn = 1"

SQL = {
    "scr_passers": f"WITH {_WIDE} SELECT listing_id, current_ratio AS solid, CASE WHEN b THEN price_to_book WHEN c THEN roce_ttm WHEN e THEN eps_streak END AS reported FROM p WHERE p0 AND p1",
    "scr_details": _DETAIL + " SELECT * FROM g",
    "scr_fallout": _DETAIL + " SELECT criterion, count(*) FILTER (verdict <> 'passed') AS failed, count(*) FILTER (verdict = 'na_blocked') AS na_blocked, count(*) FILTER (verdict = 'comparison_failed') AS compared_and_lost FROM g GROUP BY 1",
    "rnk_scores": _RANK_SQL,
    "uni1_classification": _CLASSES + " SELECT listing_id, status, rule FROM st",
    "uni2_rescued": _CLASSES + f""", alive AS (SELECT isin, lei FROM st WHERE status <> 'secondary') SELECT listing_id, CASE WHEN sole THEN 'unknown' ELSE status END AS status, CASE WHEN sole THEN 'rescue' ELSE rule END AS rule FROM (
        SELECT *, rule = 'R1' AND coalesce(venue IN ({", ".join(f"'{x}'" for x in PRIMARY_US_VENUES)}), false) AND NOT EXISTS (SELECT 1 FROM alive WHERE alive.isin = st.isin) AND NOT EXISTS (SELECT 1 FROM alive WHERE alive.lei = st.lei) AS sole FROM st)""",
    "uni3_issuer_groups": _GROUPS + " SELECT listing_id, issuer_group FROM g",
    "uni4_representatives": _GROUPS + """, o AS (SELECT listing_id, issuer_id FROM listings QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY listings.snapshot_date DESC, delivered_at DESC) = 1)
        SELECT issuer_group, min(issuer_id) AS representative FROM g JOIN o USING (listing_id) GROUP BY 1""",
    "uni5_completed_evidence": f"SELECT listing_id, primary_ticker, isin, lei, venue_tier FROM {_FILL}",
    "snk2_upserted_listings": """SELECT listing_id, upper(trim(symbol)) AS symbol, lower(trim(status)) AS status, strftime(snapshot_date, '%Y-%m-%d') AS snapshot_date FROM listings
        QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY listings.snapshot_date DESC, delivered_at DESC) = 1""",
    "norm9_changed_payloads": f"""SELECT DISTINCT provider_listing_id, payload_hash FROM fundamentals_raw r WHERE last_fetched_at >= CAST(DATE '{REFERENCE_DATE}' - 30 AS TIMESTAMP) AND NOT EXISTS
        (SELECT 1 FROM fundamentals_raw o WHERE o.last_fetched_at < CAST(DATE '{REFERENCE_DATE}' - 30 AS TIMESTAMP) AND o.provider_listing_id = r.provider_listing_id AND o.payload_hash = r.payload_hash)""",
    "win13_unit_flips": """WITH r AS (SELECT listing_id, source, end_date, arg_max(value, (coalesce(filed, DATE '0001-01-01'), fact_id)) AS v, arg_max(fact_id, (coalesce(filed, DATE '0001-01-01'), fact_id)) AS fact_id
        FROM financial_facts WHERE concept = 'EarningsPerShare' AND fiscal_period IN ('Q1', 'Q2', 'Q3', 'Q4') GROUP BY 1, 2, 3),
        a AS (SELECT *, abs(nullif(v, 0)) AS x, abs(last_value(nullif(v, 0) IGNORE NULLS) OVER (PARTITION BY listing_id, source ORDER BY end_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS p FROM r),
        s AS (SELECT *, sum(CASE WHEN greatest(x / p, p / x) BETWEEN 40 AND 140 THEN 1 ELSE 0 END) OVER (PARTITION BY listing_id, source ORDER BY end_date) AS seg FROM a),
        m AS (SELECT *, median(x) OVER (PARTITION BY listing_id, source, seg) AS med FROM s)
        SELECT fact_id, CASE WHEN max(seg) OVER (PARTITION BY listing_id, source) > 0 AND med > sqrt(min(med) OVER (PARTITION BY listing_id, source) * max(med) OVER (PARTITION BY listing_id, source)) THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS scale FROM m""",
    "rep_source_profile": f"WITH {O.CLEAN} SELECT source, fiscal_period, count(*) AS n, round(count(*) FILTER (filed IS NULL) / count(*), 6) AS unfiled, strftime(max(end_date), '%Y-%m-%d') AS newest FROM clean GROUP BY 1, 2",
}

_M = ["market_cap", "enterprise_value", "working_capital", "current_ratio", "price_to_book", "croic"]
_MONEY_WIDE = """n AS (SELECT * FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) AND value <> -999999.0 AND NOT isinf(value) QUALIFY row_number() OVER (PARTITION BY listing_id, metric_id ORDER BY as_of DESC, value DESC, unit_kind DESC, currency DESC NULLS LAST) = 1),
  w AS (SELECT listing_id, """ + ", ".join(f"max(value) FILTER (metric_id = '{m}') AS {m}, max(unit_kind) FILTER (metric_id = '{m}') AS {m}_k, max(currency) FILTER (metric_id = '{m}') AS {m}_c, max(as_of) FILTER (metric_id = '{m}') AS {m}_d" for m in _M) + " FROM n GROUP BY 1)"
SQL["scr_mixed_currencies"] = f"""WITH {_MONEY_WIDE}, w2 AS (SELECT * FROM w WHERE coalesce(market_cap, enterprise_value, working_capital, current_ratio, price_to_book, croic) IS NOT NULL),
  k AS (SELECT 'USD' AS base, market_cap_c AS quote, market_cap_d AS on_date FROM w2 UNION ALL SELECT working_capital_c, enterprise_value_c, working_capital_d FROM w2), {O.rates_sql("k")},
  j AS (SELECT w2.*, a.rate AS ra, b.rate AS rb FROM w2 LEFT JOIN rated a ON a.base = 'USD' AND a.quote = market_cap_c AND a.on_date = market_cap_d LEFT JOIN rated b ON b.base = working_capital_c AND b.quote = enterprise_value_c AND b.on_date = working_capital_d),
  v AS (SELECT *, market_cap >= 2.0e8::DOUBLE * ra AS x0, enterprise_value >= working_capital * rb * 0.5 AS x1, price_to_book <= croic * 3.0 AS x3, CASE WHEN market_cap IS NULL THEN NULL WHEN market_cap_c IS NULL THEN 'currency_missing' WHEN ra IS NULL THEN 'fx_missing' END AS i0,
    CASE WHEN enterprise_value IS NULL OR working_capital IS NULL THEN NULL WHEN enterprise_value_c IS NULL OR working_capital_c IS NULL THEN 'currency_missing' WHEN rb IS NULL THEN 'fx_missing' END AS i1, CASE WHEN working_capital IS NOT NULL AND current_ratio IS NOT NULL THEN 'unit_mismatch' END AS i2 FROM j)
  SELECT listing_id, criterion, CASE WHEN coalesce(x, false) THEN 'passed' WHEN x IS NOT NULL THEN 'comparison_failed' ELSE 'na_blocked' END AS verdict, concat_ws(',', i0, i1, i2) AS issues FROM (
    SELECT *, 'large' AS criterion, x0 AS x FROM v UNION ALL SELECT *, 'covered', x1 FROM v UNION ALL SELECT *, 'either', x3 FROM v)"""
SQL["rnk_mixed_currencies"] = f"""WITH {_MONEY_WIDE}, w2 AS (SELECT * FROM w WHERE coalesce(market_cap, price_to_book) IS NOT NULL), k AS (SELECT market_cap_c AS base, 'USD' AS quote, market_cap_d AS on_date FROM w2), {O.rates_sql("k")}
  SELECT listing_id, CAST(floor(market_cap * rate) AS DOUBLE) AS market_cap, round(price_to_book, 6) AS price_to_book FROM w2 LEFT JOIN rated ON base = market_cap_c AND on_date = market_cap_d"""
SQL |= normalize_sql.SQL

QUERIES = {f.__name__: f for f in (scr_passers, scr_details, scr_fallout, rnk_scores, scr_mixed_currencies, rnk_mixed_currencies, uni1_classification, uni2_rescued, uni3_issuer_groups, uni4_representatives, uni5_completed_evidence, snk2_upserted_listings, norm9_changed_payloads, rep_source_profile, norm1_facts, norm6_implied_eps, norm7_derived_facts, fx7_normalized_facts, win13_unit_flips)}
