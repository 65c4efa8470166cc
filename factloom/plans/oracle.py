"""SQL shared by the checks: the same results written another way, for an engine without our operators."""

#: Power of ten and major currency of a fact, by patterns over the unit text.
UNIT_SQL = r"""
  (CASE
    WHEN unit_kind IN ('ratio', 'percent') THEN CASE WHEN regexp_matches(unit, '(?i)^(bp|bps|basis points?)$') THEN -4 WHEN regexp_matches(unit, '(?i)^(%|pct|percent|per cent)$') THEN -2 ELSE 0 END
    WHEN unit_kind = 'multiple' THEN 0
    ELSE CASE
      WHEN regexp_matches(unit, '(?i)(\bbn\b|billion|\bmrd\b)') THEN 9
      WHEN regexp_matches(unit, '(?i)(crore|\bcr\b)') THEN 7
      WHEN regexp_matches(unit, '(?i)lakh') THEN 5
      WHEN regexp_matches(unit, '(?i)(million|\bmn\b|\bmio\b|\bmln\b|mln$|\bmm\b)') OR regexp_matches(unit, '([A-Z$€£¥.]| )m$') THEN 6
      WHEN regexp_matches(unit, '(?i)(thousand|000|\btsd\b|^k )') OR regexp_matches(unit, '^[Tk][A-Z]{3}$') THEN 3
      WHEN regexp_matches(unit, '(?i)lots') THEN 2
      ELSE 0 END
    END
  + CASE WHEN unit_kind IN ('monetary', 'per_share') AND (regexp_matches(unit, '(?i)(pence|cents|agorot|gbx|^zac|^ila$|^usc$|^p$)') OR unit = 'GBp'
      OR (trim(currency) IN ('GBX', 'GBp', 'GBP0.01', 'ZAC', 'ILA') AND NOT regexp_matches(coalesce(unit, ''), '[A-Z]{3}'))) THEN -2 ELSE 0 END)
"""

CURRENCY_SQL = """CASE upper(trim(currency)) WHEN 'GBX' THEN 'GBP' WHEN 'GBP0.01' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE upper(trim(currency)) END"""

#: The currency of a unit text, where no currency is recorded.
NAMED_SQL = r"""CASE
    WHEN regexp_matches(unit, '(USD|US\$|US dollars|^USc$|US cents)') THEN 'USD' WHEN regexp_matches(unit, '(EUR|€|euro)') THEN 'EUR'
    WHEN regexp_matches(unit, '(GBP|£|pounds|pence)') THEN 'GBP' WHEN regexp_matches(unit, '(CAD|C\$|Canadian)') THEN 'CAD' WHEN regexp_matches(unit, '(CHF|Swiss)') THEN 'CHF'
    WHEN regexp_matches(unit, '(SEK|Swedish)') THEN 'SEK' WHEN regexp_matches(unit, '(ILS|shekels)') THEN 'ILS' WHEN regexp_matches(unit, '(INR|Rs\.|rupees)') THEN 'INR'
    WHEN regexp_matches(unit, '(JPY|¥|yen)') THEN 'JPY' WHEN regexp_matches(unit, '(ZAR|rand|ZA cents)') THEN 'ZAR' END"""

COMMON_UNIT_SQL = f"""CASE WHEN unit_kind = 'count' THEN 'shares' WHEN unit_kind IN ('ratio', 'percent') THEN 'fraction' WHEN unit_kind = 'multiple' THEN 'times'
    ELSE coalesce({CURRENCY_SQL}, upper({NAMED_SQL}), CASE WHEN regexp_matches(upper(unit), '^[A-Z]{{3}}$') THEN upper(unit) END) END"""

#: Facts in common units, one per natural key (the latest filing), without filler dates: table ``clean``.
CLEAN = f"""
measured AS (
  SELECT *, {UNIT_SQL} AS power, {COMMON_UNIT_SQL} AS common_unit FROM financial_facts
), valued AS (
  SELECT *, CASE WHEN power < 0 THEN value / power(10.0, -power) ELSE value * power(10.0, power) END AS common_value FROM measured
), clean AS (
  SELECT listing_id, concept, fiscal_period, end_date, unit_kind, common_value AS value, filed, common_unit AS currency, source, updated_at, fact_id
  FROM (SELECT *, row_number() OVER (PARTITION BY listing_id, concept, fiscal_period, end_date ORDER BY coalesce(filed, DATE '0001-01-01') DESC, updated_at DESC, fact_id DESC) AS k FROM valued
        WHERE end_date NOT IN (DATE '1900-01-01', DATE '2099-12-31'))
  WHERE k = 1
)
"""

#: Order of periods with the same end and filing date.
PERIOD_RANK = "CASE fiscal_period WHEN 'FY' THEN 1 WHEN 'Q4' THEN 2 WHEN 'Q3' THEN 3 WHEN 'Q2' THEN 4 WHEN 'Q1' THEN 5 WHEN 'TTM' THEN 6 WHEN 'INSTANT' THEN 7 ELSE 99 END"
NEWEST = f"end_date DESC, filed DESC NULLS LAST, {PERIOD_RANK}"


def rates_sql(keys: str) -> str:
    """Tables up to ``rated`` (base, quote, on_date, rate) for a table ``keys`` of base, quote, on_date."""
    return f"""
  legs AS (
    SELECT base_currency AS b, quote_currency AS q, rate_date, rate, 3 AS kind FROM fx_rates QUALIFY row_number() OVER (PARTITION BY base_currency, quote_currency, rate_date ORDER BY updated_at DESC, rate DESC) = 1
    UNION ALL SELECT quote_currency, base_currency, rate_date, 1.0 / rate, 2 FROM fx_rates WHERE rate <> 0 QUALIFY row_number() OVER (PARTITION BY base_currency, quote_currency, rate_date ORDER BY updated_at DESC, 1.0 / rate DESC) = 1
  ), asked AS (SELECT DISTINCT base, quote, on_date FROM {keys} WHERE base IS NOT NULL AND quote IS NOT NULL AND on_date IS NOT NULL),
  via AS (SELECT asked.*, p, r FROM asked CROSS JOIN (VALUES ('USD', 3), ('EUR', 2), ('GBP', 1)) v(p, r) WHERE base <> quote AND p <> base AND p <> quote),
  want AS (SELECT base AS b, quote AS q, on_date FROM asked WHERE base <> quote UNION SELECT base, p, on_date FROM via UNION SELECT p, quote, on_date FROM via),
  got AS (SELECT want.b, want.q, on_date, rate, rate_date, kind FROM want JOIN legs ON legs.b = want.b AND legs.q = want.q AND legs.rate_date <= want.on_date QUALIFY row_number() OVER (PARTITION BY want.b, want.q, on_date ORDER BY rate_date DESC, kind DESC) = 1),
  cand AS (
    SELECT base, quote, on_date, 1.0 AS rate, on_date AS rate_date, 5 AS kind, 0 AS r FROM asked WHERE base = quote UNION ALL SELECT b, q, on_date, rate, rate_date, kind, 0 FROM got SEMI JOIN asked a ON a.base = got.b AND a.quote = got.q AND a.on_date = got.on_date
    UNION ALL SELECT via.base, via.quote, via.on_date, x.rate * y.rate, least(x.rate_date, y.rate_date), 1, via.r FROM via JOIN got x ON x.b = via.base AND x.q = via.p AND x.on_date = via.on_date JOIN got y ON y.b = via.p AND y.q = via.quote AND y.on_date = via.on_date
  ), rated AS (SELECT base, quote, on_date, rate FROM cand QUALIFY row_number() OVER (PARTITION BY base, quote, cand.on_date ORDER BY cand.rate_date DESC, kind DESC, r DESC) = 1)"""
