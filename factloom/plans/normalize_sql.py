"""SQL of the facts of payloads: every field of every entry as a row, the first number of a concept's fields, then what follows from others."""

from __future__ import annotations

from factloom.operators.normalize import FIELDS, PER_SHARE, SHARE_COUNTS
from factloom.plans.records import _P1_WITH

_RANKED = ", ".join(f"('{section}', '{concept}', {i}, '{f.lower()}')" for section, concepts in FIELDS.items() for concept, fields in concepts.items() for i, f in enumerate(fields))
_LIST = lambda names: ", ".join(f"'{n}'" for n in names)
_KIND = f"CASE WHEN concept IN ({_LIST(PER_SHARE)}) THEN 'per_share' WHEN concept IN ({_LIST(SHARE_COUNTS)}) THEN 'count' ELSE 'monetary' END"
_NUM = "TRY_CAST(nullif(replace(trim({0}), ',', ''), '') AS DOUBLE)"
_CODE = "(CASE WHEN regexp_full_match(c, '[A-Z]{3}') OR c = 'GBP0.01' THEN CASE c WHEN 'GBX' THEN 'GBP' WHEN 'GBP0.01' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE c END END)"
_n = lambda f: f"max(v) FILTER (k = '{f.lower()}')"
_OWED = f"coalesce({_n('totalLiabilities')}, {_n('totalLiab')})"
_IMPLIED = f"({_n('cashAndShortTermInvestments')} - coalesce({_n('shortTermInvestments')}, 0))"
_fits = lambda f: f"CASE WHEN abs({_n(f)} - {_IMPLIED}) <= 0.01 * abs({_IMPLIED}) THEN {_n(f)} END"
_plus = lambda x: f"CASE WHEN {x} >= 0 THEN {x} END"
#: Concept, section, value where none of its own fields is a number (or, for cash, before them), whether it comes first.
_DERIVED = [
    ("LongTermDebt", "Financials.Balance_Sheet", _plus(f"({_OWED} - {_n('totalCurrentLiabilities')})"), 1),
    ("AssetsCurrent", "Financials.Balance_Sheet", _plus(f"({_n('totalAssets')} - {_n('nonCurrentAssetsTotal')})"), 1),
    ("LiabilitiesCurrent", "Financials.Balance_Sheet", _plus(f"({_OWED} - {_n('nonCurrentLiabilitiesTotal')})"), 1),
    ("PropertyPlantAndEquipmentNet", "Financials.Balance_Sheet", _plus(f"({_n('propertyPlantAndEquipmentGross')} - {_n('accumulatedDepreciation')})"), 1),
    ("CashAndCashEquivalents", "Financials.Balance_Sheet", f"coalesce({_fits('cash')}, {_fits('cashAndEquivalents')})", -1),
    ("OperatingIncomeLoss", "Financials.Income_Statement", f"coalesce({_n('incomeBeforeTax')} + {_n('interestExpense')} - coalesce({_n('interestIncome')}, 0), {_n('totalRevenue')} - {_n('totalOperatingExpenses')})", 1),
    ("InterestExpenseFromNetInterestIncome", "Financials.Income_Statement", f"CASE WHEN {_n('interestExpense')} IS NULL AND {_n('netInterestIncome')} < 0 THEN -{_n('netInterestIncome')} END", 1),
    ("CapitalExpenditures", "Financials.Cash_Flow", f"{_n('totalCashFromOperatingActivities')} - {_n('freeCashFlow')}", 1),
    ("NetCashProvidedByUsedInOperatingActivities", "Financials.Cash_Flow", f"{_n('freeCashFlow')} + coalesce({_n('capitalExpenditures')}, {_n('capex')})", 1),
    ("CommonStockSharesOutstanding", "outstandingShares", f"{_n('sharesMln')} * 1000000.0", 1),
]
FACTS = f"""{_P1_WITH},
paths AS (SELECT provider_listing_id, j, json_extract_string(j, '$.General.UpdatedAt') AS updated, json_extract_string(j, '$.General.CurrencyCode') AS payload_code FROM valid),
kv0 AS (SELECT provider_listing_id, section, row_key, ordinal, e, unnest(json_keys(e)) AS raw, generate_subscripts(json_keys(e), 1) AS i FROM keyed),
kv1 AS (SELECT *, lower(raw) AS k, json_extract(e, '$."' || raw || '"') AS x FROM kv0),
kv AS (SELECT provider_listing_id, section, row_key, k, CAST({_NUM.format("json_extract_string(x, '$')")} AS DOUBLE) AS v0, json_extract_string(x, '$') AS t FROM kv1 WHERE json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL') QUALIFY row_number() OVER (PARTITION BY provider_listing_id, row_key, k ORDER BY i) = 1),
num AS (SELECT *, CASE WHEN isnan(v0) OR isinf(v0) THEN v0 ELSE v0 END AS v FROM kv),
field AS (SELECT num.*, regexp_replace(section, '\\.[^.]*$', '') AS statement FROM num),
first AS (
  SELECT provider_listing_id, section, row_key, concept, arg_min(v, rank) AS v FROM field JOIN (VALUES {_RANKED}) f(of, concept, rank, name) ON f.of = field.statement AND f.name = field.k WHERE v IS NOT NULL GROUP BY ALL
), derived AS (
  {" UNION ALL ".join(f"SELECT provider_listing_id, section, row_key, '{c}' AS concept, {x} AS v, {p} AS place FROM field WHERE statement = '{sec}' GROUP BY provider_listing_id, section, row_key" for c, sec, x, p in _DERIVED)}
), picked AS (
  SELECT provider_listing_id, section, row_key, concept, v FROM (SELECT *, 0 AS place FROM first UNION ALL SELECT * FROM derived) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY provider_listing_id, row_key, concept ORDER BY place) = 1
), entry AS (
  SELECT k.provider_listing_id, k.section, k.row_key, k.ordinal, k.text_date, f.t AS formatted, p.updated, p.j, coalesce(cs.t, json_extract_string(p.j, '$.' || regexp_replace(k.section, '\\.[^.]*$', '') || '.currency_symbol'), p.payload_code) AS recorded, coalesce(TRY_CAST(substr(fd.t, 1, 10) AS DATE), TRY_CAST(substr(rd.t, 1, 10) AS DATE)) AS filed, TRY_CAST(substr(rd.t, 1, 10) AS DATE) AS report
  FROM keyed k JOIN paths p USING (provider_listing_id) LEFT JOIN kv cs ON cs.provider_listing_id = k.provider_listing_id AND cs.row_key = k.row_key AND cs.k = 'currency_symbol' LEFT JOIN kv fd ON fd.provider_listing_id = k.provider_listing_id AND fd.row_key = k.row_key AND fd.k = 'filing_date'
  LEFT JOIN kv rd ON rd.provider_listing_id = k.provider_listing_id AND rd.row_key = k.row_key AND rd.k = 'reportdate' LEFT JOIN kv f ON f.provider_listing_id = k.provider_listing_id AND f.row_key = k.row_key AND f.k = 'dateformatted'
), dated2 AS (
  SELECT *, CASE WHEN section LIKE 'outstandingShares%' THEN coalesce(formatted, text_date) ELSE text_date END AS tx, upper(trim(recorded)) AS c, upper(trim(recorded)) IN ('GBX', 'GBP0.01', 'ZAC', 'ILA') OR trim(recorded) = 'GBp' AS sub FROM entry
), dated3 AS (
  SELECT *, coalesce(CASE WHEN regexp_full_match(substr(tx, 1, 10), '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN TRY_CAST(substr(tx, 1, 10) AS DATE) END, CASE WHEN section LIKE 'outstandingShares%' AND regexp_full_match(tx, '[0-9]{{4}}') THEN TRY_CAST(tx || '-12-31' AS DATE) END) AS end_date FROM dated2
), raw AS (
  SELECT d.*, concept, v, {_KIND} AS unit_kind, CASE WHEN regexp_matches(d.section, '\\.(yearly|Annual|annual)$') THEN 'FY' ELSE 'Q' || quarter(end_date) END AS fiscal_period
  FROM dated3 d JOIN picked USING (provider_listing_id, row_key) WHERE end_date IS NOT NULL AND (concept NOT IN ({_LIST(SHARE_COUNTS)}) OR v > 0)
), stated AS (SELECT DISTINCT provider_listing_id, end_date FROM raw WHERE section = 'Financials.Income_Statement.quarterly' AND concept IN ('NetIncomeLoss', 'EarningsPerShareDiluted', 'EarningsPerShareBasic')),
told AS (
  SELECT raw.* FROM raw LEFT JOIN stated USING (provider_listing_id, end_date)
  WHERE section <> 'Earnings.History' OR (NOT coalesce(report > TRY_CAST(substr(updated, 1, 10) AS DATE), false) AND (v <> 0 OR EXISTS (SELECT 1 FROM stated s WHERE s.provider_listing_id = raw.provider_listing_id AND s.end_date = raw.end_date)))
), f0 AS (
  SELECT provider_listing_id, concept, fiscal_period, end_date, unit_kind, CASE WHEN sub AND unit_kind <> 'count' THEN v / 100 ELSE v END AS value, filed, CASE WHEN unit_kind <> 'count' THEN {_CODE} END AS currency
  FROM told QUALIFY row_number() OVER (PARTITION BY provider_listing_id, concept, fiscal_period, end_date ORDER BY CASE WHEN unit_kind = 'count' THEN abs(v) END NULLS LAST, ordinal DESC, row_key DESC) = 1
), snap AS (
  SELECT provider_listing_id, TRY_CAST(substr(updated, 1, 10) AS DATE) AS end_date, upper(trim(coalesce(json_extract_string(j, '$.Highlights.currency_symbol'), payload_code))) AS c, coalesce(json_extract_string(j, '$.Highlights.currency_symbol'), payload_code) AS recorded,
    coalesce({_NUM.format("json_extract_string(j, '$.SharesStats.SharesOutstanding')")}, {_NUM.format("json_extract_string(j, '$.SharesStats.SharesFloat')")}) AS shares, {_NUM.format("json_extract_string(j, '$.Highlights.MarketCapitalization')")} AS cap, {_NUM.format("json_extract_string(j, '$.Highlights.DividendShare')")} AS dps FROM paths
), facts AS (
  SELECT * FROM f0 UNION ALL SELECT provider_listing_id, 'CommonStockSharesOutstanding', 'INSTANT', end_date, 'count', shares, NULL, NULL FROM snap WHERE shares > 0 AND end_date IS NOT NULL
  UNION ALL SELECT provider_listing_id, 'ProviderMarketCapitalization', 'INSTANT', end_date, 'monetary', cap, NULL, {_CODE} FROM snap WHERE cap > 0 AND end_date IS NOT NULL AND {_CODE} IS NOT NULL
  UNION ALL SELECT provider_listing_id, 'CommonStockDividendsPerShareCashPaid', 'TTM', end_date, 'per_share', dps / CASE WHEN c IN ('GBX', 'GBP0.01', 'ZAC', 'ILA') OR trim(recorded) = 'GBp' THEN 100 ELSE 1 END, NULL, {_CODE} FROM snap WHERE dps IS NOT NULL AND end_date IS NOT NULL AND {_CODE} IS NOT NULL
)"""
_SHOW = "SELECT provider_listing_id, concept, fiscal_period, strftime(end_date, '%Y-%m-%d') AS end_date, unit_kind, CASE WHEN abs(value) >= 1000 THEN round(value, 2) ELSE round(value, 6) END AS value, strftime(filed, '%Y-%m-%d') AS filed, currency FROM "
_col = lambda c, n: f"max({n}) FILTER (concept = '{c}')"
_NAMES = {"se": "StockholdersEquity", "ce": "CommonStockholdersEquity", "ta": "Assets", "tl": "Liabilities", "ps": "PreferredStock", "nci": "NoncontrollingInterestInConsolidatedEntity", "ni": "NetIncomeLoss", "nic": "NetIncomeLossAvailableToCommonStockholdersBasic", "pd": "PreferredStockDividendsAndOtherAdjustments",
          "eps": "EarningsPerShare", "epsd": "EarningsPerShareDiluted", "epsb": "EarningsPerShareBasic", "ia": "IntangibleAssetsNet", "iax": "IntangibleAssetsNetExcludingGoodwill", "nta": "NetTangibleAssets", "gw": "Goodwill", "sh": "CommonStockSharesOutstanding", "esh": "EntityCommonStockSharesOutstanding"}
_PIVOT = ", ".join(f"{_col(c, 'value')} AS {n}, {_col(c, 'currency')} AS {n}_c, {_col(c, 'filed')} AS {n}_f" for n, c in _NAMES.items())
_add = lambda c, v, base, when: f"SELECT provider_listing_id, '{c}' AS concept, fiscal_period, end_date, {v} AS value, {base}_f AS filed, {base}_c AS currency FROM w WHERE {when} AND ({v}) IS NOT NULL"
_ok = lambda base, *others: " AND ".join(f"({o} IS NULL OR {o}_c IS NOT DISTINCT FROM {base}_c)" for o in others)
_EQ = "(se IS NULL AND ta IS NOT NULL AND tl IS NOT NULL AND ta_c IS NOT DISTINCT FROM tl_c AND ta >= tl)"
DERIVED = f"""{FACTS}, w AS (SELECT provider_listing_id, fiscal_period, end_date, {_PIVOT} FROM facts GROUP BY provider_listing_id, fiscal_period, facts.end_date),
n AS (
  {_add("EarningsPerShare", "epsd", "epsd", "eps IS NULL")} UNION ALL {_add("EarningsPerShare", "epsb", "epsb", "eps IS NULL AND epsd IS NULL")}
  UNION ALL {_add("IntangibleAssetsNetExcludingGoodwill", "ia", "ia", "iax IS NULL")} UNION ALL {_add("IntangibleAssetsNetExcludingGoodwill", "ta - tl - nta - coalesce(gw, 0)", "ta", "iax IS NULL AND ia IS NULL AND tl_c IS NOT DISTINCT FROM ta_c AND nta_c IS NOT DISTINCT FROM ta_c AND " + _ok("ta", "gw") + " AND ta - tl - nta - coalesce(gw, 0) >= 0")}
  UNION ALL {_add("StockholdersEquity", "ta - tl", "ta", _EQ)} UNION ALL {_add("StockholdersEquity", "ce", "ce", f"se IS NULL AND NOT {_EQ}")}
  UNION ALL {_add("NetIncomeLossAvailableToCommonStockholdersBasic", "ni - coalesce(pd, 0)", "ni", "nic IS NULL AND " + _ok("ni", "pd"))}
  UNION ALL {_add("CommonStockholdersEquity", "se - coalesce(ps, 0) - coalesce(nci, 0)", "se", "se IS NOT NULL AND " + _ok("se", "ps", "nci"))}
  UNION ALL {_add("CommonStockholdersEquity", "ta - tl - coalesce(ps, 0) - coalesce(nci, 0)", "ta", _EQ + " AND " + _ok("ta", "ps", "nci"))}
  UNION ALL {_add("CommonStockholdersEquity", "ce - coalesce(ps, 0) - coalesce(nci, 0)", "ce", f"se IS NULL AND NOT {_EQ} AND ce IS NOT NULL AND " + _ok("ce", "ps", "nci"))}
  UNION ALL {_add("CommonStockSharesOutstanding", "esh", "esh", "sh IS NULL")}
), d AS (SELECT provider_listing_id, concept, fiscal_period, end_date, {_KIND} AS unit_kind, value, filed, currency FROM n),
everything AS (SELECT * FROM facts WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.concept = 'CommonStockholdersEquity' AND facts.concept = d.concept AND d.provider_listing_id = facts.provider_listing_id AND d.fiscal_period = facts.fiscal_period AND d.end_date = facts.end_date) UNION ALL SELECT * FROM d)
"""
_IMPLIED_EPS = f"""{FACTS}, s AS (SELECT provider_listing_id, end_date AS sd, value AS n FROM facts WHERE concept = 'CommonStockSharesOutstanding' AND value > 0),
i AS (SELECT f.provider_listing_id, f.fiscal_period, f.end_date, f.value / s.n AS value, f.currency FROM facts f JOIN s ON s.provider_listing_id = f.provider_listing_id AND abs(date_diff('day', s.sd, f.end_date)) <= 120
  WHERE f.concept = 'NetIncomeLoss' AND NOT EXISTS (SELECT 1 FROM facts x WHERE x.concept = 'EarningsPerShare' AND x.provider_listing_id = f.provider_listing_id AND x.fiscal_period = f.fiscal_period AND x.end_date = f.end_date)
  QUALIFY row_number() OVER (PARTITION BY f.provider_listing_id, f.fiscal_period, f.end_date ORDER BY abs(date_diff('day', s.sd, f.end_date)), s.sd, s.n) = 1)
SELECT provider_listing_id, 'EarningsPerShare' AS concept, fiscal_period, strftime(end_date, '%Y-%m-%d') AS end_date, 'per_share' AS unit_kind, CASE WHEN abs(value) >= 1000 THEN round(value, 2) ELSE round(value, 6) END AS value, currency
FROM (SELECT provider_listing_id, fiscal_period, end_date, value, currency FROM facts WHERE concept = 'EarningsPerShare' UNION ALL SELECT * FROM i)"""
SQL = {"norm1_facts": f"{FACTS} {_SHOW} facts", "norm7_derived_facts": f"{DERIVED} {_SHOW} everything", "norm6_implied_eps": _IMPLIED_EPS}
