"""Scans, scopes, joins, counts and scalars on the project's tables, each beside the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import scalars as S
from factloom.operators import facts as P
from factloom.operators import scope as R
from factloom.operators.latest import latest_by
from factloom.operators.universe import classify, fill_missing
from factloom.operators.upsert import upsert
from factloom.plans import oracle as O
from factloom.plans.fundamentals import REFERENCE_DATE, clean_facts, reference
from factloom.plans.records import newest_payloads
from factloom.sources.tables import read_table

QUERIES, SQL = {}, {}
_REF = f"DATE '{REFERENCE_DATE}'"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def newest_listings(spark, d):
    """The newest row of each listing in the newest snapshot, cleaned."""
    rows = read_table(spark, d, "listings")
    newest = rows.agg(F.max("snapshot_date").alias("snapshot_date"))
    rows = latest_by(rows.join(F.broadcast(newest), "snapshot_date", "left_semi"), ["listing_id"], ["delivered_at"])
    return rows.select("listing_id", "issuer_id", F.upper(S.trimmed("symbol")).alias("symbol"), F.upper(S.trimmed("exchange")).alias("exchange"), F.upper(S.trimmed("currency")).alias("currency"), F.lower(S.trimmed("status")).alias("status"), "isin")


_LN = """(SELECT listing_id, issuer_id, upper(trim(symbol)) AS symbol, upper(trim(exchange)) AS exchange, upper(trim(currency)) AS currency, lower(trim(status)) AS status, isin FROM listings WHERE snapshot_date = (SELECT max(snapshot_date) FROM listings)
  QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY delivered_at DESC) = 1)"""
_PAYLOAD = "(SELECT provider_listing_id, CASE WHEN json_valid(data) THEN CAST(data AS JSON) END AS j FROM fundamentals_raw QUALIFY row_number() OVER (PARTITION BY provider_listing_id ORDER BY last_fetched_at DESC, payload_hash DESC) = 1)"
_CUT = f"CAST({_REF} - 30 AS TIMESTAMP)"
_FY = f"y AS (SELECT *, year(end_date) AS yr FROM clean WHERE fiscal_period = 'FY' QUALIFY row_number() OVER (PARTITION BY listing_id, concept, year(end_date) ORDER BY end_date DESC, filed DESC NULLS LAST) = 1)"


# Scans and sinks


@query("SELECT fact_id, concept, fiscal_period, source FROM financial_facts WHERE listing_id = 1")
def src3_facts_of_listing(spark, d):
    return read_table(spark, d, "financial_facts").filter("listing_id = 1").select("fact_id", "concept", "fiscal_period", "source")


@query(f"""WITH old AS (SELECT DISTINCT provider_listing_id, payload_hash FROM fundamentals_raw WHERE last_fetched_at < {_CUT}),
  new AS (SELECT provider_listing_id, payload_hash FROM fundamentals_raw WHERE last_fetched_at >= {_CUT} QUALIFY row_number() OVER (PARTITION BY provider_listing_id ORDER BY last_fetched_at DESC, payload_hash DESC) = 1)
  SELECT n.provider_listing_id, l.symbol || '.' || l.exchange AS symbol, n.payload_hash, o.payload_hash IS NULL AS is_new FROM new n JOIN {_LN} l ON l.listing_id = n.provider_listing_id AND coalesce(l.status, 'unknown') <> 'secondary'
  LEFT JOIN old o ON o.provider_listing_id = n.provider_listing_id AND o.payload_hash = n.payload_hash""")
def src9_work_list(spark, d):
    """Payloads of the last month of listings in scope, with whether the same payload was there before."""
    raw = read_table(spark, d, "fundamentals_raw").select("provider_listing_id", "payload_hash", "last_fetched_at")
    cut = F.date_sub(reference(), 30).cast("timestamp")
    new = latest_by(raw.filter(F.col("last_fetched_at") >= cut), ["provider_listing_id"], ["last_fetched_at", "payload_hash"]).drop("last_fetched_at")
    old = raw.filter(F.col("last_fetched_at") < cut).select("provider_listing_id", "payload_hash").distinct().withColumn("known", F.lit(True))
    listed = R.in_scope(newest_listings(spark, d)).select(F.col("listing_id").alias("provider_listing_id"), F.concat_ws(".", "symbol", "exchange").alias("symbol"))
    return new.join(listed, "provider_listing_id").join(old, ["provider_listing_id", "payload_hash"], "left").select("provider_listing_id", "symbol", "payload_hash", F.col("known").isNull().alias("is_new"))


@query(f"""SELECT s.security_id, coalesce(json_extract_string(j, '$.General.Name'), entity_name) AS name, coalesce(json_extract_string(j, '$.General.Sector'), sector) AS sector
  FROM (SELECT * FROM securities QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY updated_at DESC) = 1) s LEFT JOIN {_PAYLOAD} p ON p.provider_listing_id = s.security_id""")
def src10_metadata(spark, d):
    """Names and sectors, those of the payload before those of the catalogue."""
    payload = newest_payloads(spark, d).select(F.col("provider_listing_id").alias("security_id"), F.get_json_object("data", "$.General.Name").alias("n"), F.get_json_object("data", "$.General.Sector").alias("s"), F.try_parse_json("data").isNotNull().alias("ok"))
    rows = latest_by(read_table(spark, d, "securities"), ["security_id"], ["updated_at"]).join(payload, "security_id", "left")
    own = lambda c: F.when(F.col("ok"), F.col(c))
    return rows.select("security_id", F.coalesce(own("n"), "entity_name").alias("name"), F.coalesce(own("s"), "sector").alias("sector"))


@query("""SELECT listing_id, metric_id, value, strftime(as_of, '%Y-%m-%d') AS as_of FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND value <> -999999.0
  QUALIFY row_number() OVER (PARTITION BY listing_id, metric_id ORDER BY metrics.as_of DESC, value DESC) = 1""")
def src11_newest_metrics(spark, d):
    """The newest value of every metric of every listing."""
    rows = read_table(spark, d, "metrics").filter(F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") != float("inf")) & (F.col("value") != -999999.0))
    rows = rows.groupBy("listing_id", "metric_id").agg(F.max(F.struct("as_of", "value")).alias("r"))
    return rows.select("listing_id", "metric_id", "r.value", F.date_format("r.as_of", "yyyy-MM-dd").alias("as_of"))


@query("""WITH n AS (SELECT *, upper(trim(exchange)) AS e FROM listings WHERE snapshot_date = (SELECT max(snapshot_date) FROM listings)), o AS (SELECT *, upper(trim(exchange)) AS e FROM listings WHERE snapshot_date < (SELECT max(snapshot_date) FROM listings))
  SELECT e AS exchange, count(*) AS n, strftime(min(snapshot_date), '%Y-%m-%d') AS oldest FROM (SELECT * FROM o WHERE e NOT IN (SELECT e FROM n WHERE e IS NOT NULL) UNION ALL SELECT * FROM n) GROUP BY 1""")
def snk1_replaced_exchanges(spark, d):
    """All snapshots with the exchanges of the newest one replaced by it."""
    rows = read_table(spark, d, "listings").withColumn("e", F.upper(S.trimmed("exchange")))
    newest = F.broadcast(rows.agg(F.max("snapshot_date").alias("snapshot_date")))
    out = R.replaced_slice(rows.join(newest, "snapshot_date", "left_anti").select(*rows.columns), rows.join(newest, "snapshot_date", "left_semi").select(*rows.columns), ["e"])
    return out.groupBy(F.col("e").alias("exchange")).agg(F.count("*").alias("n"), F.date_format(F.min("snapshot_date"), "yyyy-MM-dd").alias("oldest"))


@query("SELECT DISTINCT provider_listing_id, sha256(data) AS content_hash FROM fundamentals_raw QUALIFY row_number() OVER (PARTITION BY provider_listing_id ORDER BY last_fetched_at DESC, payload_hash DESC) = 1")
def snk5_content_hashes(spark, d):
    return newest_payloads(spark, d).select("provider_listing_id", S.content_hash("data").alias("content_hash"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS nulls FROM financial_facts" for c in ("fact_id", "listing_id", "concept", "fiscal_period", "end_date", "unit_kind", "unit", "value", "filed", "currency", "source", "updated_at")))
def snk8_profile(spark, d):
    return R.table_profile(read_table(spark, d, "financial_facts")).drop("type")


# Scopes and filters


@query(f"SELECT listing_id, symbol, exchange FROM {_LN} WHERE coalesce(status, 'unknown') <> 'secondary' AND exchange IN ('LSE', 'US')")
def flt2_scope(spark, d):
    return R.in_scope(newest_listings(spark, d), exchanges=["LSE", "us"]).select("listing_id", "symbol", "exchange")


@query(f"""SELECT DISTINCT l.listing_id, s.canonical_symbol AS symbol FROM {_LN} l JOIN securities s ON s.security_id = l.listing_id JOIN fundamentals_raw f ON f.provider_listing_id = l.listing_id WHERE coalesce(l.status, 'unknown') <> 'secondary'""")
def flt3_listed_with_payload(spark, d):
    ids = read_table(spark, d, "fundamentals_raw").select(F.col("provider_listing_id").alias("listing_id")).distinct()
    named = read_table(spark, d, "securities").select(F.col("security_id").alias("listing_id"), F.col("canonical_symbol").alias("symbol")).distinct()
    return R.in_scope(newest_listings(spark, d)).select("listing_id").join(named, "listing_id").join(ids, "listing_id")


@query(f"""SELECT DISTINCT upper(trim(canonical_symbol)) AS symbol FROM securities WHERE NOT EXISTS (SELECT 1 FROM {_LN} l WHERE coalesce(l.status, 'unknown') <> 'secondary' AND l.symbol || '.' || l.exchange = upper(trim(canonical_symbol)))""")
def flt4_unknown_symbols(spark, d):
    return R.missing_symbols(newest_listings(spark, d), read_table(spark, d, "securities").select(F.col("canonical_symbol").alias("symbol")), "symbol")


@query(f"SELECT listing_id, bool_or(end_date >= {_REF} - 400 AND concept IN ('Revenues', 'NetIncomeLoss', 'Assets')) AS recent FROM financial_facts WHERE end_date <= {_REF} GROUP BY 1")
def flt6_any_recent(spark, d):
    rows = read_table(spark, d, "financial_facts").filter(F.col("end_date") <= reference())
    return rows.groupBy("listing_id").agg(F.bool_or((F.col("end_date") >= F.date_sub(reference(), P.MAX_AGE)) & F.col("concept").isin("Revenues", "NetIncomeLoss", "Assets")).alias("recent"))


@query("SELECT concept, source, count(*) FILTER (value < 0) AS dropped, count(*) FILTER (NOT value < 0) AS kept FROM financial_facts WHERE concept IN ('InterestExpense', 'DepreciationAndAmortization') GROUP BY 1, 2")
def flt7_guarded(spark, d):
    """Costs below zero are dropped, never turned."""
    rows = read_table(spark, d, "financial_facts").filter(F.col("concept").isin("InterestExpense", "DepreciationAndAmortization"))
    return rows.groupBy("concept", "source").agg(F.count_if(F.col("value") < 0).alias("dropped"), F.count_if(~(F.col("value") < 0)).alias("kept"))


@query("WITH bad AS (SELECT DISTINCT listing_id, end_date FROM financial_facts WHERE filed < end_date) SELECT source, count(*) AS n FROM financial_facts f WHERE NOT EXISTS (SELECT 1 FROM bad WHERE bad.listing_id = f.listing_id AND bad.end_date = f.end_date) GROUP BY 1")
def flt9_without_quarantined(spark, d):
    """Without all facts of the dates at which a listing has a fact filed before its end."""
    rows = read_table(spark, d, "financial_facts")
    return R.without_quarantined(rows, rows.filter(F.col("filed") < F.col("end_date")), ["listing_id", "end_date"]).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT fact_id FROM financial_facts WHERE (unit_kind IN ('monetary', 'per_share')) = (currency IS NULL)")
def flt12_kind_mismatch(spark, d):
    return R.violations_of_kind(read_table(spark, d, "financial_facts")).select("fact_id")


@query("""WITH s AS (SELECT DISTINCT snapshot_date FROM listings ORDER BY 1 DESC LIMIT 2), r AS (SELECT DISTINCT snapshot_date, upper(trim(exchange)) AS exchange, upper(trim(symbol)) AS symbol FROM listings WHERE snapshot_date IN (SELECT * FROM s)),
  o AS (SELECT exchange, symbol FROM r WHERE snapshot_date = (SELECT min(snapshot_date) FROM s)), n AS (SELECT exchange, symbol FROM r WHERE snapshot_date = (SELECT max(snapshot_date) FROM s))
  SELECT o.exchange, count(*) AS before, count(*) FILTER (n.symbol IS NULL) AS removed, count(*) FILTER (n.symbol IS NULL) >= 20 AND count(*) FILTER (n.symbol IS NULL) > 0.5 * count(*) AS refused FROM o LEFT JOIN n USING (exchange, symbol) GROUP BY 1""")
def flt16_mass_removals(spark, d):
    rows = read_table(spark, d, "listings").select("snapshot_date", F.upper(S.trimmed("exchange")).alias("exchange"), F.upper(S.trimmed("symbol")).alias("symbol"))
    # As many rows as there are snapshots.
    dates = rows.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(2).agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("b"))
    marked = rows.join(F.broadcast(dates), (F.col("snapshot_date") == F.col("a")) | (F.col("snapshot_date") == F.col("b")))
    return R.share_of_removals(marked.filter("snapshot_date = a"), marked.filter("snapshot_date = b"), ["symbol"], ["exchange"])


# Joins


@query(f"""SELECT l.exchange, f.source, count(*) AS n, count(DISTINCT l.issuer_id) AS issuers FROM financial_facts f JOIN {_LN} l ON l.listing_id = f.listing_id JOIN (SELECT DISTINCT security_id FROM securities) s ON s.security_id = f.listing_id GROUP BY 1, 2""")
def join1_chain(spark, d):
    """Facts through their listing and its security: counted by listing before they meet the dimensions."""
    facts = read_table(spark, d, "financial_facts").groupBy("listing_id", "source").agg(F.count("*").alias("n"))
    known = read_table(spark, d, "securities").select(F.col("security_id").alias("listing_id")).distinct()
    rows = facts.join(newest_listings(spark, d), "listing_id").join(known, "listing_id")
    return rows.groupBy("exchange", "source").agg(F.sum("n").alias("n"), F.count_distinct("issuer_id").alias("issuers"))


@query(f"""WITH {O.CLEAN}, b AS (SELECT listing_id, end_date, max(fact_id) AS near_id FROM clean WHERE concept = 'BookValuePerShare' GROUP BY 1, 2), a AS (SELECT fact_id, listing_id, end_date FROM clean WHERE concept IN ('Revenues', 'NetIncomeLoss'))
  SELECT a.fact_id, b.near_id, strftime(b.end_date, '%Y-%m-%d') AS near_date FROM a JOIN b ON a.listing_id = b.listing_id AND b.end_date BETWEEN a.end_date - 45 AND a.end_date + 45
  QUALIFY row_number() OVER (PARTITION BY a.fact_id ORDER BY abs(date_diff('day', a.end_date, b.end_date)), b.end_date) = 1""")
def join5_nearest_book_value(spark, d):
    """Each flow with the book value nearest in time, at most 45 days away."""
    facts = clean_facts(spark, d)
    left = facts.filter(F.col("concept").isin("Revenues", "NetIncomeLoss")).select("fact_id", "listing_id", "end_date")
    right = facts.filter("concept = 'BookValuePerShare'").groupBy("listing_id", F.col("end_date").alias("near")).agg(F.max("fact_id").alias("near_id"))
    out = R.nearest_row(left, right, ["listing_id"], "end_date", "near", 45, ["near_id"])
    return out.select("fact_id", "near_id", F.date_format("near", "yyyy-MM-dd").alias("near_date"))


_CODES = r"""(SELECT listing_id, kind, value FROM (SELECT listing_id, 'isin' AS kind, upper(trim(isin)) AS value FROM listing_evidence UNION SELECT listing_id, 'lei', upper(trim(lei)) FROM listing_evidence)
  WHERE CASE kind WHEN 'isin' THEN regexp_full_match(value, '[A-Z]{2}[A-Z0-9]{9}[0-9]') ELSE regexp_full_match(value, '[A-Z0-9]{20}') END)"""
_ADR = "(SELECT DISTINCT listing_id FROM listing_evidence WHERE upper(trim(home_category)) = 'ADR')"


def _codes(spark, d):
    rows = read_table(spark, d, "listing_evidence")
    kinds = F.array(F.struct(F.lit("isin").alias("kind"), S.shaped_isin("isin").alias("value")), F.struct(F.lit("lei").alias("kind"), S.shaped_lei("lei").alias("value")))
    return rows.select("listing_id", F.inline(kinds)).dropna().distinct()


def _receipts(spark, d):
    return read_table(spark, d, "listing_evidence").filter(F.upper(S.trimmed("home_category")) == "ADR").select("listing_id").distinct()


@query(f"SELECT DISTINCT c.listing_id FROM {_CODES} c WHERE kind = 'isin' AND value IN (SELECT value FROM {_CODES} x WHERE kind = 'isin' AND listing_id IN (SELECT listing_id FROM {_ADR}))")
def join7_isin_neighbours(spark, d):
    """Listings with an ISIN that a depositary receipt has too."""
    held = _codes(spark, d).filter("kind = 'isin'")
    values = held.join(_receipts(spark, d), "listing_id", "left_semi").select("value").distinct()
    return held.join(values, "value", "left_semi").select("listing_id").distinct()


@query(f"WITH {O.CLEAN}, {_FY} SELECT a.listing_id, a.concept, a.yr AS year, round(a.value / b.value - 1, 6) AS growth FROM y a JOIN y b ON a.listing_id = b.listing_id AND a.concept = b.concept AND b.yr = a.yr - 1 WHERE b.value > 0")
def join10_year_over_year(spark, d):
    """Growth against exactly the calendar year before."""
    rows = P.by_year(clean_facts(spark, d)).select("listing_id", "concept", "year", "value")
    before = rows.select("listing_id", "concept", (F.col("year") + 1).alias("year"), F.col("value").alias("before"))
    return rows.join(before.filter("before > 0"), ["listing_id", "concept", "year"]).select("listing_id", "concept", "year", F.round(F.col("value") / F.col("before") - 1, 6).alias("growth"))


@query(f"""SELECT DISTINCT e.listing_id FROM {_CODES} e JOIN (SELECT provider_listing_id, upper(trim(json_extract_string(j, '$.General.LEI'))) AS lei FROM {_PAYLOAD}) p ON e.kind = 'lei' AND e.value = p.lei""")
def join13_payload_lei(spark, d):
    """Listings whose LEI a payload has."""
    leis = newest_payloads(spark, d).filter(F.try_parse_json("data").isNotNull()).select(S.shaped_lei(F.get_json_object("data", "$.General.LEI")).alias("value")).dropna().distinct()
    return _codes(spark, d).filter("kind = 'lei'").join(leis, "value", "left_semi").select("listing_id").distinct()


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT a.listing_id AS x, b.listing_id AS y FROM {_CODES} a JOIN {_CODES} b USING (kind, value)),
  r AS (SELECT listing_id, 0 AS n FROM {_ADR} UNION SELECT e.y, r.n + 1 FROM r JOIN e ON e.x = r.listing_id WHERE r.n < 8) SELECT DISTINCT listing_id FROM r""")
def join14_neighbourhood(spark, d):
    """Listings reached from depositary receipts over shared identifiers in at most eight steps."""
    return R.neighbourhood(_receipts(spark, d), "listing_id", _codes(spark, d))


# Counts and orders


_STATE = "CASE WHEN value IS NULL THEN 'missing' WHEN isnan(value) THEN 'not a number' WHEN isinf(value) THEN 'infinite' WHEN value = -999999.0 THEN 'filler' ELSE 'success' END"


def _state():
    v = F.col("value")
    return F.when(v.isNull(), "missing").when(F.isnan(v), "not a number").when(F.abs(v) == float("inf"), "infinite").when(v == -999999.0, "filler").otherwise("success")


@query(f"SELECT metric_id, count(*) FILTER (s = 'success') AS success, count(*) FILTER (s <> 'success') AS failure FROM (SELECT metric_id, {_STATE} AS s FROM metrics) GROUP BY 1")
def agg3_states_by_metric(spark, d):
    return read_table(spark, d, "metrics").groupBy("metric_id").agg(F.count_if(_state() == "success").alias("success"), F.count_if(_state() != "success").alias("failure"))


_NEEDS = {"working_capital": ("AssetsCurrent", "LiabilitiesCurrent"), "long_term_debt": ("LongTermDebt",), "roa_ttm": ("NetIncomeLoss", "Assets"), "interest_coverage": ("OperatingIncomeLoss", "InterestExpense")}


@query(f"""WITH n(metric_id, concept) AS (VALUES {", ".join(f"('{m}', '{c}')" for m, cs in _NEEDS.items() for c in cs)}), l AS (SELECT listing_id, concept, max(end_date) AS d FROM financial_facts WHERE end_date <= {_REF} GROUP BY 1, 2),
  t AS (SELECT count(DISTINCT listing_id) AS n FROM financial_facts)
  SELECT n.metric_id, n.concept, count(*) FILTER (l.d >= {_REF} - 400) AS fresh, count(*) FILTER (l.d < {_REF} - 400) AS stale, (SELECT t.n FROM t) - count(l.d) AS missing FROM n LEFT JOIN l ON l.concept = n.concept GROUP BY 1, 2""")
def agg5_coverage_by_metric(spark, d):
    """Of the concepts each metric needs: how many listings have a fresh fact, an old one, or none."""
    facts = read_table(spark, d, "financial_facts")
    needs = spark.createDataFrame([(m, c) for m, cs in _NEEDS.items() for c in cs], "metric_id string, concept string")
    newest = facts.filter(F.col("end_date") <= reference()).groupBy("listing_id", "concept").agg(F.max("end_date").alias("d"))
    fresh = F.col("d") >= F.date_sub(reference(), P.MAX_AGE)
    counts = newest.groupBy("concept").agg(F.count_if(fresh).alias("fresh"), F.count_if(~fresh).alias("stale"))
    total = facts.select("listing_id").distinct().agg(F.count("*").alias("total"))
    out = needs.join(counts, "concept", "left").join(F.broadcast(total), F.lit(True))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("metric_id", "concept", zero("fresh"), zero("stale"), (F.col("total") - F.coalesce("fresh", F.lit(0)) - F.coalesce("stale", F.lit(0))).alias("missing"))


@query(f"WITH {O.CLEAN} SELECT listing_id, concept, count(*) FILTER (fiscal_period = 'FY') AS fy_rows, count(*) FILTER (fiscal_period LIKE 'Q_') AS quarter_rows, strftime(max(end_date), '%Y-%m-%d') AS newest FROM clean GROUP BY 1, 2")
def agg6_fact_detail(spark, d):
    rows = clean_facts(spark, d).groupBy("listing_id", "concept")
    return rows.agg(F.count_if(F.col("fiscal_period") == "FY").alias("fy_rows"), F.count_if(F.col("fiscal_period").rlike("^Q[1-4]$")).alias("quarter_rows"), F.date_format(F.max("end_date"), "yyyy-MM-dd").alias("newest"))


@query(f"WITH {O.CLEAN} SELECT listing_id, concept, CASE WHEN min(currency) = max(currency) AND count(currency) = count(*) THEN round(sum(value), 1) END AS total, CASE WHEN min(currency) = max(currency) AND count(currency) = count(*) THEN min(currency) END AS currency FROM clean WHERE unit_kind = 'monetary' AND fiscal_period = 'FY' AND value IS NOT NULL GROUP BY 1, 2")
def agg7_single_currency_totals(spark, d):
    rows = clean_facts(spark, d).filter("unit_kind = 'monetary' AND fiscal_period = 'FY'")
    return R.single_currency_sum(rows, ["listing_id", "concept"], "value", "currency").select("listing_id", "concept", F.round("total", 1).alias("total"), "currency")


@query(f"WITH {O.CLEAN}, {_FY}, z AS (SELECT *, max(yr) OVER (PARTITION BY listing_id, concept) AS top FROM y) SELECT listing_id, concept, round(stddev_pop(value / 1000), 3) AS spread, round(min(value), 2) AS least, count(*) FILTER (value > 0) / count(*) AS share_above FROM z WHERE yr > top - 3 GROUP BY 1, 2 HAVING count(*) = 3")
def agg9_spread_of_years(spark, d):
    rows = P.strict_years(P.by_year(clean_facts(spark, d)), 3)
    return rows.groupBy("listing_id", "concept").agg(F.round(F.stddev_pop(F.col("value") / 1000), 3).alias("spread"), F.round(F.min("value"), 2).alias("least"), (F.count_if(F.col("value") > 0) / F.count("*")).alias("share_above"))


@query(f"""WITH c AS (SELECT listing_id, max(value) AS cap FROM metrics WHERE metric_id = 'market_cap' AND {_STATE} = 'success' GROUP BY 1), m AS (SELECT m.listing_id, metric_id, {_STATE} AS reason, cap FROM metrics m LEFT JOIN c USING (listing_id))
  SELECT metric_id, reason, count(*) AS n, arg_max(listing_id, (coalesce(cap, -1e308), -listing_id)) AS example FROM m WHERE reason <> 'success' GROUP BY 1, 2""")
def agg14_failures(spark, d):
    """Values that can't be used by metric and reason, with the listing of the largest market value as an example."""
    rows = read_table(spark, d, "metrics").select("listing_id", "metric_id", "value", _state().alias("reason"))
    caps = rows.filter("metric_id = 'market_cap' AND reason = 'success'").groupBy("listing_id").agg(F.max("value").alias("cap"))
    bad = rows.filter("reason <> 'success'").join(caps, "listing_id", "left")
    return bad.groupBy("metric_id", "reason").agg(F.count("*").alias("n"), F.max_by("listing_id", F.struct(F.coalesce("cap", F.lit(-1e308)), -F.col("listing_id"))).alias("example"))


@query(f"SELECT metric_id, failure, na_share, row_number() OVER (ORDER BY na_share DESC, failure DESC, metric_id) AS place FROM (SELECT metric_id, count(*) FILTER (s <> 'success') AS failure, round(count(*) FILTER (s <> 'success') / count(*), 6) AS na_share FROM (SELECT metric_id, {_STATE} AS s FROM metrics) GROUP BY 1)")
def sort5_metric_report(spark, d):
    """Metrics by the share of values that can't be used.  As many rows as there are metrics, so one task orders them."""
    from pyspark.sql import Window

    rows = agg3_states_by_metric(spark, d).select("metric_id", "failure", F.round(F.col("failure") / (F.col("success") + F.col("failure")), 6).alias("na_share"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("na_share"), F.desc("failure"), "metric_id")).cast("long"))


@query("SELECT security_id, canonical_symbol FROM (SELECT * FROM securities QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY updated_at DESC) = 1) ORDER BY upper(trim(canonical_symbol)), security_id LIMIT 25")
def sort6_preview(spark, d):
    """The first 25 securities by symbol: the preview of a report."""
    rows = latest_by(read_table(spark, d, "securities").select("security_id", "canonical_symbol", "updated_at"), ["security_id"], ["updated_at"]).select("security_id", "canonical_symbol")
    return R.first_rows(rows, [F.upper(F.trim("canonical_symbol")), F.col("security_id")], 25)


# Scalars


@query(r"""SELECT fact_id, CASE WHEN upper(trim(currency)) IN ('GBX', 'GBP0.01', 'ZAC', 'ILA') OR trim(currency) = 'GBp' THEN value / 100 ELSE value END AS major, CASE WHEN fiscal_period LIKE 'Q_' THEN fiscal_period ELSE 'Q' || quarter(end_date) END AS quarter,
  greatest(-1.0::DOUBLE, least(1.0::DOUBLE, value)) AS clamped, least(3600.0::DOUBLE * power(2.0, fact_id % 8), 86400.0::DOUBLE) AS wait, CASE WHEN regexp_full_match(upper(trim(currency)), '[A-Z]{3}') OR upper(trim(currency)) = 'GBP0.01' THEN CASE upper(trim(currency)) WHEN 'GBX' THEN 'GBP' WHEN 'GBP0.01' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE upper(trim(currency)) END END AS code FROM financial_facts""")
def sc_fact_scalars(spark, d):
    rows = read_table(spark, d, "financial_facts")
    return rows.select(
        "fact_id", S.major_amount("value", "currency").alias("major"), S.quarter_label("fiscal_period", "end_date").alias("quarter"), S.clamp("value", -1.0, 1.0).alias("clamped"),
        S.backoff_seconds((F.col("fact_id") % 8 + 1).cast("int")).alias("wait"), S.shaped_currency("currency").alias("code"),
    )


@query(r"""SELECT security_id, regexp_replace(regexp_replace(regexp_replace(m, '\b[A-Z0-9][A-Z0-9-]*\.[A-Z]{2,5}\b', '<symbol>', 'g'), '\d{4}-\d{2}-\d{2}', '<date>', 'g'), '-?\d+(\.\d+)?', '<n>', 'g') AS reason, 'https://host/x?api_token=***&s=' || security_id AS url,
  CASE WHEN regexp_full_match(upper(trim(canonical_ticker)), '[A-Z]{6}') THEN 'pair' WHEN regexp_full_match(upper(trim(canonical_ticker)), '[A-Z]{3}') THEN 'usd_alias' ELSE 'none' END AS pair_kind,
  CASE WHEN canonical_exchange_code IS NULL THEN NULL ELSE 'USD' END AS merged, substr(entity_name, 1, 12) AS short_name
  FROM (SELECT *, 'no value for ' || upper(trim(canonical_symbol)) || ' on ' || strftime(updated_at, '%Y-%m-%d') || ': -12.5 of ' || security_id AS m FROM securities QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY updated_at DESC) = 1)""")
def sc_text_scalars(spark, d):
    rows = latest_by(read_table(spark, d, "securities"), ["security_id"], ["updated_at"])
    message = F.concat(F.lit("no value for "), F.upper(F.trim("canonical_symbol")), F.lit(" on "), F.date_format("updated_at", "yyyy-MM-dd"), F.lit(": -12.5 of "), F.col("security_id").cast("string"))
    url = F.concat(F.lit("https://host/x?api_token="), F.md5("canonical_symbol"), F.lit("&s="), F.col("security_id").cast("string"))
    return rows.select(
        "security_id", S.reason_template(message).alias("reason"), S.redacted(url).alias("url"), S.fx_pair_kind("canonical_ticker").alias("pair_kind"),
        S.merged_currency(F.when(F.col("canonical_exchange_code").isNotNull(), F.lit("usd ")), F.when(F.col("canonical_exchange_code").isNotNull(), F.lit("USD"))).alias("merged"), F.substring("entity_name", 1, 12).alias("short_name"),
    )


@query("""WITH s AS (SELECT base_currency, quote_currency, min(rate_date) AS f, max(rate_date) AS l FROM fx_rates GROUP BY 1, 2)
  SELECT base_currency, quote_currency, '2015-01-01' AS first, strftime(f - 1, '%Y-%m-%d') AS last FROM s WHERE f > DATE '2015-01-01' UNION ALL SELECT base_currency, quote_currency, strftime(l + 1, '%Y-%m-%d'), '2027-12-31' FROM s WHERE l < DATE '2027-12-31'""")
def fx9_ranges_to_fetch(spark, d):
    """What is missing of the years 2015 to 2027 before and after the stored rates of each pair."""
    stored = read_table(spark, d, "fx_rates").groupBy("base_currency", "quote_currency").agg(F.min("rate_date").alias("first"), F.max("rate_date").alias("last"))
    wanted = stored.select("base_currency", "quote_currency", F.to_date(F.lit("2015-01-01")).alias("first"), F.to_date(F.lit("2027-12-31")).alias("last"))
    out = R.outer_ranges(wanted, stored, ["base_currency", "quote_currency"])
    return out.select("base_currency", "quote_currency", F.date_format("first", "yyyy-MM-dd").alias("first"), F.date_format("last", "yyyy-MM-dd").alias("last"))


@query("""WITH s AS (SELECT DISTINCT snapshot_date FROM listings ORDER BY 1 DESC LIMIT 2), r AS (SELECT DISTINCT snapshot_date, upper(trim(exchange)) AS exchange, upper(trim(symbol)) AS symbol FROM listings)
  SELECT exchange, symbol FROM r WHERE snapshot_date = (SELECT min(snapshot_date) FROM s) EXCEPT SELECT exchange, symbol FROM r WHERE snapshot_date = (SELECT max(snapshot_date) FROM s)""")
def cat1_pruned_tickers(spark, d):
    """Tickers of the snapshot before the newest that the newest has not: what a slice's replacement prunes."""
    rows = read_table(spark, d, "listings").select("snapshot_date", F.upper(S.trimmed("exchange")).alias("exchange"), F.upper(S.trimmed("symbol")).alias("symbol"))
    dates = rows.select("snapshot_date").distinct().orderBy(F.desc("snapshot_date")).limit(2).agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("b"))
    marked = rows.join(F.broadcast(dates), (F.col("snapshot_date") == F.col("a")) | (F.col("snapshot_date") == F.col("b"))).distinct()
    return marked.filter("snapshot_date = a").select("exchange", "symbol").join(marked.filter("snapshot_date = b"), ["exchange", "symbol"], "left_anti")


@query(f"""WITH r AS (SELECT listing_id, upper(trim(provider_symbol)) AS symbol, upper(trim(primary_ticker)) AS ticker, upper(trim(home_category)) AS home, upper(trim(isin)) AS isin FROM (SELECT listing_id, {", ".join(f"arg_max({c}, (fetched_at, {c})) FILTER ({c} IS NOT NULL) AS {c}" for c in ("provider_symbol", "primary_ticker", "home_category", "isin"))} FROM listing_evidence GROUP BY 1)),
  ok AS (SELECT * REPLACE (CASE WHEN regexp_full_match(isin, '[A-Z]{{2}}[A-Z0-9]{{9}}[0-9]') THEN isin END AS isin) FROM r),
  x AS (SELECT *, EXISTS (SELECT 1 FROM ok o WHERE o.isin = ok.isin AND o.listing_id <> ok.listing_id AND o.ticker IS NOT NULL AND o.ticker <> '') AS peers FROM ok)
  SELECT CASE WHEN home IN ('ADR', 'ADR PRIMARY', 'ADR SECONDARY', 'ADR PREFERRED', 'BDR') THEN 'R1' WHEN ticker <> '' THEN 'R2' WHEN peers THEN 'R3' ELSE 'R4' END AS rule, count(*) AS n FROM x GROUP BY 1""")
def agg15_rule_counts(spark, d):
    rows = fill_missing(read_table(spark, d, "listing_evidence"), ["listing_id"], ["provider_symbol", "primary_ticker", "home_category", "isin"], "fetched_at")
    return classify(rows).groupBy("rule").agg(F.count("*").alias("n"))


@query("""SELECT base_currency, quote_currency, strftime(rate_date, '%Y-%m-%d') AS rate_date, rate FROM fx_rates QUALIFY row_number() OVER (PARTITION BY base_currency, quote_currency, fx_rates.rate_date ORDER BY (updated_at >= TIMESTAMP '2025-01-01') DESC, updated_at DESC, rate DESC) = 1""")
def snk4_upserted_rates(spark, d):
    """Rates updated since 2025 written over the older ones, by pair and day; within either the latest update counts."""
    rows = read_table(spark, d, "fx_rates")
    cut = F.col("updated_at") >= F.lit("2025-01-01").cast("timestamp")
    keys = ["base_currency", "quote_currency", "rate_date"]
    old, new = (latest_by(rows.filter(c), keys, ["updated_at", "rate"]) for c in (~cut, cut))
    return upsert(old, new, keys, ["updated_at", "rate"]).select("base_currency", "quote_currency", F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"), "rate")


@query("""SELECT base_currency, quote_currency, year(rate_date) AS year, count(DISTINCT rate_date) AS days, count(DISTINCT rate_date) = date_diff('day', min(rate_date), max(rate_date)) + 1 AS without_gap FROM fx_rates GROUP BY 1, 2, 3""")
def agg4_years_without_gap(spark, d):
    """How many days each pair has in a year, and whether no day between the first and the last is missing."""
    rows = read_table(spark, d, "fx_rates").select("base_currency", "quote_currency", "rate_date").distinct()
    whole = F.count("*") == F.datediff(F.max("rate_date"), F.min("rate_date")) + 1
    return rows.groupBy("base_currency", "quote_currency", F.year("rate_date").cast("long").alias("year")).agg(F.count("*").alias("days"), whole.alias("without_gap"))


@query(f"WITH {O.CLEAN}, {_FY} SELECT concept, listing_id, round(median(value), 2) AS median, round(quantile_disc(value, 0.5), 2) AS low_median FROM y GROUP BY 1, 2")
def agg8_medians_of_years(spark, d):
    """The median of the years: the mean of the middle two of an even number, and the lower of them."""
    rows = P.by_year(clean_facts(spark, d)).groupBy("concept", "listing_id")
    return rows.agg(F.round(F.median("value"), 2).alias("median"), F.round(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)"), 2).alias("low_median"))


@query(f"""WITH {O.CLEAN}, l AS (SELECT concept, value, end_date, fiscal_period FROM clean WHERE listing_id = 1 AND concept IN ('AssetsCurrent', 'LiabilitiesCurrent') QUALIFY row_number() OVER (PARTITION BY concept ORDER BY end_date DESC, value DESC, fiscal_period DESC) = 1)
  SELECT 'input' AS part, n AS name, round(value, 2) AS value, strftime(end_date, '%Y-%m-%d') AS end_date, fiscal_period FROM (VALUES ('AssetsCurrent'), ('LiabilitiesCurrent')) c(n) LEFT JOIN l ON l.concept = n""")
def rep7_explained_inputs(spark, d):
    """The facts behind the current ratio of the largest listing."""
    from factloom.metrics.registry import explain_metric
    from factloom.plans.fundamentals import metric_facts

    out = explain_metric(metric_facts(spark, d), reference(), 1, "current_ratio").filter("part = 'input'")
    return out.select("part", "name", F.round("value", 2).alias("value"), F.date_format("end_date", "yyyy-MM-dd").alias("end_date"), "fiscal_period")


@query("""WITH m AS (SELECT fact_id, CASE WHEN upper(trim(currency)) IN ('GBX', 'GBP0.01', 'ZAC', 'ILA') OR trim(currency) = 'GBp' THEN value / 100 ELSE value END AS v, CASE upper(trim(currency)) WHEN 'GBX' THEN 'GBP' WHEN 'GBP0.01' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE nullif(upper(trim(currency)), '') END AS c FROM financial_facts)
  SELECT fact_id, CASE WHEN c = 'USD' THEN v + 1000 END AS more, CASE WHEN c = 'USD' THEN v / 1000 END AS times, CASE WHEN c = 'USD' THEN v >= 1000 END AS at_least FROM m""")
def sc_money(spark, d):
    """Each recorded amount against a thousand dollars: sums, ratios and comparisons only within one currency."""
    a, b = S.money("value", "currency"), S.money(F.lit(1000.0), F.lit("USD"))
    return read_table(spark, d, "financial_facts").select("fact_id", S.money_math(a, b, "+")["amount"].alias("more"), S.money_math(a, b, "/").alias("times"), S.money_math(a, b, ">=").alias("at_least"))


@query("SELECT security_id, CASE WHEN length(entity_name) > 20 THEN substr(entity_name, 1, 17) || '...' ELSE entity_name END AS name, format('{:,}', security_id) || '.00' AS shown FROM securities QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY updated_at DESC) = 1")
def sc_display(spark, d):
    rows = latest_by(read_table(spark, d, "securities").select("security_id", "entity_name", "updated_at"), ["security_id"], ["updated_at"])
    return rows.select("security_id", S.shortened("entity_name", 20).alias("name"), S.display_number("security_id").alias("shown"))
