"""Problems 1, 5, 6 and 7 on the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.units import resolve_unit, to_common
from factloom.operators.latest import latest_by
from factloom.operators.materialize import broadcast_if_small, materialize
from factloom.operators.nested import FlatTable, fields_to_columns, flatten
from factloom.operators.snapshots import snapshot_changes
from factloom.operators.spikes import implausible_values
from factloom.plans import oracle as O
from factloom.sources.tables import read_table

_ENTRIES = ("Financials.Balance_Sheet|Income_Statement|Cash_Flow.yearly|quarterly.*", "Earnings.History|Annual.*", "outstandingShares.annual|quarterly.*")
PAYLOAD_TABLES = [
    FlatTable("payloads", ""),
    *(FlatTable("entries", p, ("date",)) for p in _ENTRIES),
    *(FlatTable("adjustments", f"{p}.adjustments.[]") for p in _ENTRIES),
]


def newest_payloads(spark: SparkSession, d: str) -> DataFrame:
    """The newest payload of each provider listing (ties: the greatest hash).  Only ids, times, hashes and places of rows are compared; the
    text is read in a second scan and never goes through an aggregation."""
    raw = read_table(spark, d, "fundamentals_raw")
    rows = raw.select("provider_listing_id", "payload_hash", "last_fetched_at", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
    newest = latest_by(rows, ["provider_listing_id"], ["last_fetched_at", "payload_hash"])
    chosen = broadcast_if_small(materialize(newest.select(F.col("file").alias("__file"), F.col("place").alias("__place")), "newest"))
    text = raw.select("provider_listing_id", "data", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__place"))
    return text.join(chosen, ["__file", "__place"], "left_semi").select("provider_listing_id", "data")


def payload_rows(spark: SparkSession, d: str) -> DataFrame:
    """Flat rows of the newest payload of each provider listing; one whose newest payload is broken has none."""
    return flatten(newest_payloads(spark, d), "data", ["provider_listing_id"], PAYLOAD_TABLES)


def _entry_date(rows: DataFrame, above: str = "") -> DataFrame:
    """The date of an entry as text: its date field if it has one, else its map key; NULL if that is no calendar date.

    ``above`` is the prefix of the fields that a child has from its entry."""
    key = F.col("map_key") if not above else F.col("fields")[f"{above}map_key"]
    text = F.substring(F.when(F.map_contains_key("fields", F.lit(f"{above}date")), F.col("fields")[f"{above}date"]).otherwise(key), 1, 10)
    valid = text.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~text.startswith("0000") & F.try_to_date(text, "yyyy-MM-dd").isNotNull()
    return rows.withColumn("entry_date", F.when(valid, text))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Entries and adjustments of one pass; an adjustment has the date and the section of its entry."""
    rows = payload_rows(spark, d).filter(F.col("table_name") != "payloads")
    child = F.col("table_name") == "adjustments"
    pick = lambda own, above: F.when(child, above).otherwise(own)
    dated = _entry_date(rows, "../").withColumnRenamed("entry_date", "__above")
    dated = _entry_date(dated).select(
        "provider_listing_id", pick(F.col("section"), F.col("fields")["../section"]).alias("section"), pick(F.col("entry_date"), F.col("__above")).alias("entry_date"),
        pick(F.lit(0), F.col("ordinal")).cast("long").alias("adjustment_no"),
    )
    return dated.filter(F.col("entry_date").isNotNull()).distinct()


def p1_entries(spark: SparkSession, d: str) -> DataFrame:
    rows = _entry_date(payload_rows(spark, d).filter(F.col("table_name") == "entries"))
    return rows.select("provider_listing_id", "row_key", "parent_key", "section", "entry_date", "ordinal", F.col("fields")["filing_date"].alias("filing_date"), F.col("fields")["currency_symbol"].alias("currency_symbol"))


def p1_adjustments(spark: SparkSession, d: str) -> DataFrame:
    return fields_to_columns(payload_rows(spark, d), "adjustments", {"field": "field", "amount": "amount", "why_text": "why.text", "why_desk": "why.desk"}).select("provider_listing_id", "row_key", "parent_key", "ordinal", "field", "amount", "why_text", "why_desk")


def p1_payloads(spark: SparkSession, d: str) -> DataFrame:
    return fields_to_columns(payload_rows(spark, d), "payloads", {"name": "General.Name", "currency_code": "General.CurrencyCode", "updated_at": "General.UpdatedAt", "sector": "General.Sector", "isin": "General.ISIN", "lei": "General.LEI"}).select("provider_listing_id", "name", "currency_code", "updated_at", "sector", "isin", "lei")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    facts = read_table(spark, d, "financial_facts").select("fact_id", resolve_unit("unit_kind", "unit", "currency").alias("u"))
    return facts.select("fact_id", "u.common_unit", "u.power_of_ten").filter(F.col("power_of_ten") != 0)


def common_facts(spark: SparkSession, d: str) -> DataFrame:
    """Every fact with its value in the common unit (``common_value``)."""
    facts = read_table(spark, d, "financial_facts").withColumn("u", resolve_unit("unit_kind", "unit", "currency"))
    return facts.withColumn("common_unit", F.col("u.common_unit")).withColumn("common_value", to_common(F.col("value"), F.col("u"))).drop("u")


def p5_common_values(spark: SparkSession, d: str) -> DataFrame:
    return common_facts(spark, d).select("fact_id", "common_unit", F.when(F.abs("common_value") >= 1000, F.round("common_value", 2)).otherwise(F.round("common_value", 8)).alias("common_value"))


#: Concepts whose values may be negative, and those that rightly stay the same for long (fixed values).
SIGNED_CONCEPTS = ("GrossProfit", "OperatingIncomeLoss", "NetIncomeLoss", "NetCashProvidedByOperatingActivities", "StockholdersEquity", "EarningsPerShare", "BookValuePerShare")
STEADY_CONCEPTS = ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding")


def p6_flags(spark: SparkSession, d: str) -> DataFrame:
    facts = common_facts(spark, d)
    facts = facts.withColumn("period_class", F.when(F.col("fiscal_period").rlike("^Q[1-4]$"), "Q").otherwise(F.col("fiscal_period")))
    return implausible_values(
        facts, "fact_id", ["listing_id", "concept", "source", "period_class"], "end_date", "common_value", ["filed", "fact_id"],
        may_be_negative=F.coalesce(F.col("concept").isin(*SIGNED_CONCEPTS), F.lit(False)),
        upper_bound=F.when(F.col("unit_kind").isin("ratio", "percent"), 1.0),
        may_be_stuck=~F.coalesce(F.col("concept").isin(*STEADY_CONCEPTS), F.lit(False)),
    )


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_flags(spark, d).select("fact_id").distinct()


_TEXT = r"^[\s ]+|[\s ]+$"


def p7_changes(spark: SparkSession, d: str) -> DataFrame:
    key = lambda c: F.upper(F.regexp_replace(c, _TEXT, ""))
    changes = snapshot_changes(
        read_table(spark, d, "listings"), "snapshot_date", {"symbol": key("symbol"), "exchange": key("exchange")},
        {"status": F.lower(F.regexp_replace("status", _TEXT, "")), "currency": F.col("currency"), "isin": F.col("isin"), "issuer_id": F.col("issuer_id")}, "delivered_at",
    )
    return changes.select(F.date_format("snapshot_date", "yyyy-MM-dd").alias("snapshot_date"), "symbol", "exchange", "change_kind", F.concat_ws(",", "changed_fields").alias("changed_fields"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_changes(spark, d).drop("changed_fields")


QUERIES = {f.__name__: f for f in (p1_found, p1_entries, p1_adjustments, p1_payloads, p5_found, p5_common_values, p6_found, p6_flags, p7_found, p7_changes)}

_SECTIONS = [f"Financials.{a}.{b}" for a in ("Balance_Sheet", "Income_Statement", "Cash_Flow") for b in ("yearly", "quarterly")] + ["Earnings.History", "Earnings.Annual", "outstandingShares.annual", "outstandingShares.quarterly"]
_P1_WITH = f"""
WITH newest AS (
  SELECT provider_listing_id, data FROM fundamentals_raw QUALIFY row_number() OVER (PARTITION BY provider_listing_id ORDER BY last_fetched_at DESC, payload_hash DESC) = 1
), valid AS (
  SELECT provider_listing_id, CAST(data AS JSON) AS j FROM newest WHERE json_valid(data)
), sections AS (
  {" UNION ALL ".join(f"SELECT provider_listing_id, '{x}' AS section, json_extract(j, '$.{x}') AS s FROM valid" for x in _SECTIONS)}
), members AS (
  SELECT provider_listing_id, section, unnest(json_keys(s)) AS map_key, generate_subscripts(json_keys(s), 1) AS i, s FROM sections WHERE json_type(s) = 'OBJECT'
), entries AS (
  SELECT provider_listing_id, section, map_key, i, json_extract(s, '$."' || map_key || '"') AS e FROM members
  UNION ALL SELECT provider_listing_id, section, NULL, generate_subscripts(CAST(s AS JSON[]), 1), unnest(CAST(s AS JSON[])) FROM sections WHERE json_type(s) = 'ARRAY'
), dated AS (
  SELECT provider_listing_id, section, e, row_number() OVER (PARTITION BY provider_listing_id, section ORDER BY i) AS ordinal,
    substr(CASE WHEN list_contains(json_keys(e), 'date') THEN json_extract_string(e, '$.date') WHEN list_contains(json_keys(e), 'Date') THEN json_extract_string(e, '$.Date') ELSE map_key END, 1, 10) AS text_date
  FROM entries WHERE json_type(e) = 'OBJECT'
), keyed AS (
  SELECT *, '/' || section || '#' || CAST(ordinal AS VARCHAR) AS row_key,
    CASE WHEN regexp_full_match(text_date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND TRY_CAST(text_date AS DATE) IS NOT NULL AND text_date NOT LIKE '0000%' THEN text_date END AS entry_date FROM dated
), adjusted AS (
  SELECT provider_listing_id, section, entry_date, row_key AS parent_key, unnest(a) AS x, generate_subscripts(a, 1) AS ordinal
  FROM (SELECT *, list_filter(CAST(json_extract(e, '$.adjustments') AS JSON[]), lambda x: json_type(x) = 'OBJECT') AS a FROM keyed)
)
"""
_P1_SQL = _P1_WITH + """SELECT DISTINCT provider_listing_id, section, entry_date, 0::BIGINT AS adjustment_no FROM keyed WHERE entry_date IS NOT NULL
UNION SELECT provider_listing_id, section, entry_date, ordinal FROM adjusted WHERE entry_date IS NOT NULL"""
_P1_ENTRIES_SQL = _P1_WITH + "SELECT provider_listing_id, row_key, '' AS parent_key, section, entry_date, ordinal, json_extract_string(e, '$.filing_date') AS filing_date, json_extract_string(e, '$.currency_symbol') AS currency_symbol FROM keyed"
_P1_ADJUSTMENTS_SQL = _P1_WITH + """SELECT provider_listing_id, parent_key || '/adjustments#' || CAST(ordinal AS VARCHAR) AS row_key, parent_key, ordinal, json_extract_string(x, '$.field') AS field,
json_extract_string(x, '$.amount') AS amount, json_extract_string(x, '$.why.text') AS why_text, json_extract_string(x, '$.why.desk') AS why_desk FROM adjusted"""
_P1_PAYLOADS_SQL = _P1_WITH + "SELECT provider_listing_id, " + ", ".join(f"json_extract_string(j, '$.General.{f}') AS {n}" for n, f in (("name", "Name"), ("currency_code", "CurrencyCode"), ("updated_at", "UpdatedAt"), ("sector", "Sector"), ("isin", "ISIN"), ("lei", "LEI"))) + " FROM valid"
_P6_KEYS = "listing_id, concept, source, period_class"
_P6_SQL = f"""
WITH measured AS (SELECT *, {O.UNIT_SQL} AS power FROM financial_facts),
f AS (SELECT *, CASE WHEN power < 0 THEN value / power(10.0, -power) ELSE value * power(10.0, power) END AS v, CASE WHEN fiscal_period LIKE 'Q_' THEN 'Q' ELSE fiscal_period END AS period_class FROM measured),
imp AS (SELECT *, (v < 0 AND concept NOT IN ({", ".join(f"'{c}'" for c in SIGNED_CONCEPTS)})) OR (unit_kind IN ('ratio', 'percent') AND v > 1) AS impossible FROM f),
d AS (
  SELECT {_P6_KEYS}, end_date, arg_max(v, (coalesce(filed, DATE '0001-01-01'), fact_id)) AS v, min(v) AS low, max(v) AS high, count(*) AS n FROM imp
  WHERE end_date NOT IN (DATE '1900-01-01', DATE '2099-12-31') GROUP BY {_P6_KEYS}, end_date
), e AS (
  SELECT *, CASE WHEN high - low <= 1e-9 * greatest(abs(low), abs(high)) THEN v END AS one, sum(n) OVER (PARTITION BY {_P6_KEYS}) AS rows FROM d
), w AS (
  SELECT *, median(v) OVER (b ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS before, median(v) OVER (b ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS after,
    median(v) OVER (b ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING EXCLUDE CURRENT ROW) AS level,
    coalesce(abs(one - lag(one) OVER b) > 1e-9 * greatest(abs(one), abs(lag(one) OVER b)), true) AS fresh
  FROM e WINDOW b AS (PARTITION BY {_P6_KEYS} ORDER BY end_date)
), x AS (
  SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY {_P6_KEYS} ORDER BY end_date) AS stretch, CASE WHEN v = level THEN 0 WHEN level = 0 THEN 1e9 ELSE (v - level) / abs(level) END AS rel FROM w
), q AS (
  SELECT {_P6_KEYS}, (quantile_disc(rel, 0.75) - quantile_disc(rel, 0.25)) / 1.349 AS spread FROM x WHERE level IS NOT NULL AND rows >= 12 GROUP BY ALL
), y AS (
  SELECT x.*, count(*) OVER (PARTITION BY {_P6_KEYS}, stretch) >= 6 AND one IS NOT NULL AND concept NOT IN ({", ".join(f"'{c}'" for c in STEADY_CONCEPTS)}) AS stuck,
    CASE WHEN after IS NOT NULL AND rows >= 12 THEN greatest(before, after) + greatest(0.3, 6 * spread) * abs(greatest(before, after)) END AS upper,
    CASE WHEN after IS NOT NULL AND rows >= 12 THEN least(before, after) - greatest(0.3, 6 * spread) * abs(least(before, after)) END AS lower
  FROM x LEFT JOIN q USING ({_P6_KEYS})
), y2 AS (
  SELECT * EXCLUDE (upper, lower), CASE WHEN before IS NOT NULL THEN upper END AS upper, CASE WHEN before IS NOT NULL THEN lower END AS lower FROM y
), z AS (SELECT *, coalesce(upper > lower AND (v >= upper OR v <= lower), false) AS o FROM y2),
l AS (
  SELECT *, o AND ((lag(o, 1, false) OVER b AND lag(o, 2, false) OVER b) OR (lag(o, 1, false) OVER b AND lead(o, 1, false) OVER b) OR (lead(o, 1, false) OVER b AND lead(o, 2, false) OVER b)) AS long
  FROM z WINDOW b AS (PARTITION BY {_P6_KEYS} ORDER BY end_date)
)
SELECT DISTINCT imp.fact_id FROM imp LEFT JOIN l USING ({_P6_KEYS}, end_date)
WHERE imp.impossible OR coalesce(l.stuck, false) OR coalesce(NOT l.long AND l.upper > l.lower AND (imp.v >= l.upper OR imp.v <= l.lower), false)
"""
_P7_SQL = """
WITH r AS (
  SELECT snapshot_date, upper(trim(symbol)) AS symbol, upper(trim(exchange)) AS exchange, lower(trim(status)) AS status, currency, isin, issuer_id FROM listings
  WHERE snapshot_date IS NOT NULL AND symbol IS NOT NULL AND exchange IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY snapshot_date, upper(trim(symbol)), upper(trim(exchange)) ORDER BY delivered_at DESC) = 1
), s AS (SELECT snapshot_date AS at, lag(snapshot_date) OVER (ORDER BY snapshot_date) AS before FROM (SELECT DISTINCT snapshot_date FROM r)),
p AS (SELECT s.at, r.* FROM r JOIN s ON s.before = r.snapshot_date), c AS (SELECT s.at, r.* FROM r JOIN s ON s.at = r.snapshot_date WHERE s.before IS NOT NULL)
SELECT strftime(coalesce(c.at, p.at), '%Y-%m-%d') AS snapshot_date, coalesce(c.symbol, p.symbol) AS symbol, coalesce(c.exchange, p.exchange) AS exchange,
  CASE WHEN p.at IS NULL THEN 'added' WHEN c.at IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM c FULL JOIN p ON c.at = p.at AND c.symbol = p.symbol AND c.exchange = p.exchange
WHERE p.at IS NULL OR c.at IS NULL OR c.status IS DISTINCT FROM p.status OR c.currency IS DISTINCT FROM p.currency OR c.isin IS DISTINCT FROM p.isin OR c.issuer_id IS DISTINCT FROM p.issuer_id
"""
SQL = {
    "p1_found": _P1_SQL,
    "p1_entries": _P1_ENTRIES_SQL,
    "p1_adjustments": _P1_ADJUSTMENTS_SQL,
    "p1_payloads": _P1_PAYLOADS_SQL,
    "p5_found": f"SELECT * FROM (SELECT fact_id, {O.COMMON_UNIT_SQL} AS common_unit, CAST({O.UNIT_SQL} AS BIGINT) AS power_of_ten FROM financial_facts) WHERE power_of_ten <> 0",
    "p5_common_values": f"""WITH m AS (SELECT *, {O.UNIT_SQL} AS power, {O.COMMON_UNIT_SQL} AS common_unit FROM financial_facts),
      v AS (SELECT fact_id, common_unit, CASE WHEN power < 0 THEN value / power(10.0, -power) ELSE value * power(10.0, power) END AS x FROM m)
      SELECT fact_id, common_unit, CASE WHEN abs(x) >= 1000 THEN round(x, 2) ELSE round(x, 8) END AS common_value FROM v""",
    "p6_found": _P6_SQL,
    "p6_flags": _P6_SQL.replace("SELECT DISTINCT imp.fact_id FROM imp", "SELECT imp.fact_id, CASE WHEN imp.impossible THEN 'impossible' WHEN coalesce(l.stuck, false) THEN 'stuck' ELSE 'spike' END AS reason FROM imp"),
    "p7_found": _P7_SQL,
    "p7_changes": _P7_SQL.replace(
        "AS change_kind", "AS change_kind, CASE WHEN p.at IS NULL OR c.at IS NULL THEN '' ELSE concat_ws(',', " + ", ".join(f"CASE WHEN c.{f} IS DISTINCT FROM p.{f} THEN '{f}' END" for f in ("currency", "isin", "issuer_id", "status")) + ") END AS changed_fields"
    ),
}
