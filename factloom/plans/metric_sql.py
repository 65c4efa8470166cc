"""SQL of the metrics, from their definitions: facts are pivoted into wide tables by listing, by date and by year, and each metric is
a plain expression or a grouped query over those.  Nothing is shared with the expressions over arrays that it checks."""

from __future__ import annotations

from factloom.metrics.registry import CONCEPTS, GUARDED
from factloom.plans import oracle as O

REF = "DATE '2026-06-30'"
#: Concepts of the made-up facts: share of the base value, left out where (listing_id * 7 + place * 3) % the third is 0, may be negative.
MADE = {
    "Assets": (8.0, 97, 0), "AssetsCurrent": (4.5, 97, 0), "Liabilities": (4.0, 6, 0), "LiabilitiesCurrent": (1.5, 97, 0), "LongTermDebt": (1.2, 9, 0), "ShortTermDebt": (0.4, 3, 0),
    "TotalDebtFromBalanceSheet": (1.7, 2, 0), "CashAndCashEquivalents": (0.6, 5, 0), "ShortTermInvestments": (0.2, 2, 0), "CashAndShortTermInvestments": (0.9, 3, 0), "StockholdersEquity": (4.0, 8, 0),
    "CommonStockholdersEquity": (3.8, 3, 0), "Goodwill": (0.3, 2, 0), "IntangibleAssetsNet": (0.2, 2, 0), "IntangibleAssetsNetExcludingGoodwill": (0.15, 3, 0), "RetainedEarnings": (1.1, 9, 1),
    "PropertyPlantAndEquipmentNet": (2.5, 97, 0), "Revenues": (2.0, 97, 0), "CostOfRevenue": (1.2, 3, 0), "GrossProfit": (0.8, 4, 0), "OperatingIncomeLoss": (0.5, 97, 1), "NetIncomeLoss": (0.3, 8, 1),
    "NetIncomeLossAvailableToCommonStockholdersBasic": (0.28, 2, 1), "NetCashProvidedByUsedInOperatingActivities": (0.4, 97, 1), "CapitalExpenditures": (0.12, 4, 0), "DepreciationDepletionAndAmortization": (0.1, 3, 1),
    "DepreciationFromCashFlow": (0.11, 2, 0), "EBITDA": (0.7, 2, 0), "InterestExpense": (0.05, 3, 1), "InterestExpenseFromNetInterestIncome": (0.04, 2, 0), "IncomeTaxExpense": (0.08, 5, 1),
    "IncomeBeforeIncomeTaxes": (0.4, 4, 0), "StockBasedCompensation": (0.02, 2, 0), "CommonStockDividendsPaid": (-0.06, 2, 0), "SalePurchaseOfStock": (-0.03, 3, 0), "IssuanceOfCapitalStock": (0.02, 2, 0),
    "EarningsPerShare": (0.01, 9, 1),
}
#: Those that stand at a date.
BALANCES = tuple(list(MADE)[:17])
_SHORT = {c: f"c{i}" for i, c in enumerate(CONCEPTS)}
_OCF, _CAPEX, _NI, _NIC, _EBIT, _REV = "NetCashProvidedByUsedInOperatingActivities", "CapitalExpenditures", "NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "OperatingIncomeLoss", "Revenues"
_DA, _DACF, _STD, _LTD, _ROLL = "DepreciationDepletionAndAmortization", "DepreciationFromCashFlow", "ShortTermDebt", "LongTermDebt", "TotalDebtFromBalanceSheet"
_CASH, _STI, _CSTI, _SE, _CE = "CashAndCashEquivalents", "ShortTermInvestments", "CashAndShortTermInvestments", "StockholdersEquity", "CommonStockholdersEquity"
_SH, _ENT, _EPS, _GP, _COST = "CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding", "EarningsPerShare", "GrossProfit", "CostOfRevenue"
_AC, _LC, _TAX, _PRE, _INT, _INT2 = "AssetsCurrent", "LiabilitiesCurrent", "IncomeTaxExpense", "IncomeBeforeIncomeTaxes", "InterestExpense", "InterestExpenseFromNetInterestIncome"
_GW, _IN, _INX, _DIV, _DPS = "Goodwill", "IntangibleAssetsNet", "IntangibleAssetsNetExcludingGoodwill", "CommonStockDividendsPaid", "CommonStockDividendsPerShareCashPaid"


def _wide(prefix: str, by: str, more: str = "") -> str:
    """Columns v_<c>, d_<c> and p_<c> of every concept, by a grouping."""
    cols = ", ".join(f"max(v) FILTER (concept = '{c}') AS v_{s}, max(d) FILTER (concept = '{c}') AS d_{s}, max(p) FILTER (concept = '{c}') AS p_{s}" for c, s in _SHORT.items())
    return f"SELECT {by}, {cols} FROM {prefix} GROUP BY {by}"


def v(c: str, t: str = "w") -> str:
    return f"{t}.v_{_SHORT[c]}"


def d(c: str, t: str = "w") -> str:
    return f"{t}.d_{_SHORT[c]}"


_values = ", ".join(f"('{c}', {i}, CAST({x[0]} AS DOUBLE), {x[1]}, {x[2]}, {str(c in BALANCES).lower()})" for i, (c, x) in enumerate(MADE.items()))
FACTS = f"""
WITH {O.CLEAN},
base0 AS (SELECT listing_id, fiscal_period AS p, end_date AS d, CAST(floor(max(abs(value))) AS BIGINT) % 1000 + 200 AS b FROM clean WHERE unit_kind = 'monetary' GROUP BY ALL),
base AS (
  SELECT listing_id, p, d, b * 1.0::DOUBLE AS b FROM base0 UNION ALL SELECT listing_id, p, CAST(d - INTERVAL 72 MONTH AS DATE), b * 0.7::DOUBLE FROM base0 WHERE p = 'FY'
  UNION ALL SELECT listing_id, p, CAST(d - INTERVAL 144 MONTH AS DATE), b * 0.4::DOUBLE FROM base0 WHERE p = 'FY'
), base1 AS (SELECT listing_id, p, d, max(b) AS b, year(d) AS y, month(d) AS m FROM base GROUP BY listing_id, p, d),
shares0 AS (SELECT *, 1000.0::DOUBLE + (listing_id % 50) * 10 + (y - 2000) * (listing_id % 7 - 2) AS n FROM base1),
prices AS (SELECT DISTINCT listing_id, 5.0::DOUBLE + listing_id % 23 AS price, DATE '2026-06-29' AS price_date FROM base0 WHERE listing_id % 17 <> 0),
f AS (
  SELECT listing_id, concept, p, d, b * share * ((94 + (listing_id * 31 + i * 17 + y * 7 + m) % 13) / 100.0::DOUBLE) * CASE WHEN loss = 1 AND (listing_id + i + y) % 9 = 0 THEN -1 ELSE 1 END AS v
  FROM base1 JOIN (VALUES {_values}) c(concept, i, share, gap, loss, balance) ON (p IN ('FY', 'Q1', 'Q2', 'Q3', 'Q4') OR (balance AND p = 'INSTANT'))
    AND (listing_id * 7 + i * 3) % gap <> 0 AND NOT (listing_id % 5 = 0 AND (i + y) % 11 = 0)
  UNION ALL SELECT listing_id, '{_SH}', p, d, n * CASE WHEN p <> 'INSTANT' THEN 1.0 WHEN listing_id % 3 = 0 THEN 1.01 ELSE 1.5 END FROM shares0 WHERE p <> 'TTM' AND listing_id % 11 <> 3
  UNION ALL SELECT listing_id, '{_ENT}', p, d, n * 1.2::DOUBLE FROM shares0 WHERE p NOT IN ('TTM', 'INSTANT') AND listing_id % 4 = 1
  UNION ALL SELECT listing_id, 'ProviderMarketCapitalization', p, d, n * (5.0::DOUBLE + listing_id % 23) * 1.4 FROM shares0 WHERE p = 'INSTANT' AND listing_id % 2 = 0
  UNION ALL SELECT listing_id, '{_DPS}', p, d, 0.2::DOUBLE + listing_id % 4 FROM shares0 WHERE p = 'TTM'
)"""

_BASE = f"""{FACTS},
g AS (
  SELECT *, CASE WHEN p LIKE 'Q_' THEN 'q' WHEN p = 'FY' THEN 'y' ELSE 'o' END AS k FROM f WHERE NOT (concept IN ({", ".join(f"'{c}'" for c in GUARDED)}) AND v < 0)
), one AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY listing_id, concept, k, d ORDER BY {O.PERIOD_RANK.replace("fiscal_period", "p")}) = 1),
q AS (SELECT * FROM one WHERE k = 'q'), y AS (SELECT * FROM one WHERE k = 'y'),
l AS (SELECT * FROM one QUALIFY row_number() OVER (PARTITION BY listing_id, concept ORDER BY d DESC, CASE k WHEN 'y' THEN 1 WHEN 'q' THEN 2 ELSE 3 END) = 1),
qr AS (SELECT *, row_number() OVER o AS rn, date_diff('day', lead(d) OVER o, d) AS gap, count(*) OVER (PARTITION BY listing_id, concept) AS n FROM q WINDOW o AS (PARTITION BY listing_id, concept ORDER BY d DESC)),
qa AS (SELECT listing_id, concept, max(n) AS n, max(d) AS newest, max(gap) FILTER (rn = 1) AS g1, max(gap) FILTER (rn = 2) AS g2, max(gap) FILTER (rn = 3) AS g3 FROM qr GROUP BY ALL),
qc AS (
  SELECT listing_id, concept, CASE WHEN n >= 4 AND g1 BETWEEN 70 AND 110 AND g2 BETWEEN 70 AND 110 AND g3 BETWEEN 70 AND 110 THEN 4 WHEN g1 BETWEEN 150 AND 220 AND (n = 2 OR g2 BETWEEN 150 AND 220) THEN 2 END AS size
  FROM qa WHERE n >= 2 AND newest >= {REF} - 400
), tr AS (SELECT qr.listing_id, qr.concept, qr.d, qr.v, qr.p, CASE size WHEN 4 THEN 'quarterly' ELSE 'semi_annual' END AS cadence FROM qr JOIN qc USING (listing_id, concept) WHERE rn <= size),
ar AS (
  SELECT * FROM tr UNION ALL SELECT listing_id, concept, d, v, p, 'annual' FROM y ANTI JOIN tr USING (listing_id, concept) WHERE d >= {REF} - 480 QUALIFY row_number() OVER (PARTITION BY listing_id, concept ORDER BY d DESC) = 1
), t AS (SELECT listing_id, concept, max(d) AS d, sum(v) AS v, max(cadence) AS p FROM tr GROUP BY ALL), a AS (SELECT listing_id, concept, max(d) AS d, sum(v) AS v, max(cadence) AS p FROM ar GROUP BY ALL),
s AS (SELECT *, year(d) AS yr FROM y QUALIFY row_number() OVER (PARTITION BY listing_id, concept, year(d) ORDER BY d DESC) = 1),
lw AS ({_wide("l", "listing_id")}), tw AS ({_wide("t", "listing_id")}), aw AS ({_wide("a", "listing_id")}), sw AS ({_wide("s", "listing_id, yr")}), yw AS ({_wide("y", "listing_id, d").replace("max(d)", "max(y.d)")}), qw AS ({_wide("q", "listing_id, d").replace("max(d)", "max(q.d)")}),
q1 AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY listing_id, concept ORDER BY d DESC) = 1), y1 AS (SELECT * FROM y QUALIFY row_number() OVER (PARTITION BY listing_id, concept ORDER BY d DESC) = 1),
per AS (SELECT * FROM q1 UNION ALL SELECT * FROM y1 ANTI JOIN q1 USING (listing_id, concept)),
sh0 AS (
  SELECT id.listing_id, CASE WHEN l.p = 'INSTANT' THEN l.v END AS a, CASE WHEN l.p = 'INSTANT' THEN l.d END AS ad, CASE WHEN s.d IS NULL OR e.d >= s.d THEN coalesce(e.v, s.v) ELSE s.v END AS b, CASE WHEN s.d IS NULL OR e.d >= s.d THEN coalesce(e.d, s.d) ELSE s.d END AS bd, m.v / price AS anchor, price, price_date
  FROM (SELECT DISTINCT listing_id FROM g) id LEFT JOIN l ON l.listing_id = id.listing_id AND l.concept = '{_SH}' LEFT JOIN per s ON s.listing_id = id.listing_id AND s.concept = '{_SH}'
  LEFT JOIN per e ON e.listing_id = id.listing_id AND e.concept = '{_ENT}' LEFT JOIN l m ON m.listing_id = id.listing_id AND m.concept = 'ProviderMarketCapitalization' LEFT JOIN prices ON prices.listing_id = id.listing_id
), sh1 AS (
  SELECT *, CASE WHEN a IS NULL THEN b WHEN b IS NULL OR greatest(a, b) / least(a, b) <= 1.02 THEN a
    WHEN anchor > 0 AND least(greatest(a / anchor, anchor / a), greatest(b / anchor, anchor / b)) <= 2 THEN CASE WHEN greatest(b / anchor, anchor / b) <= greatest(a / anchor, anchor / a) THEN b ELSE a END WHEN b / a >= 1.25 THEN b ELSE a END AS n FROM sh0
), sh AS (SELECT listing_id, n, CASE WHEN n = a THEN ad ELSE bd END AS nd, price, price_date, CASE WHEN price > 0 AND n > 0 THEN price * n END AS mcap FROM sh1)
"""


def fr(c: str, days: int = 400, t: str = "lw") -> str:
    return f"CASE WHEN {d(c, t)} >= {REF} - {days} THEN {v(c, t)} END"


def _any(a: str, b: str) -> str:
    return f"coalesce(({a}) + ({b}), {a}, {b})"


def _debt(days: int) -> str:
    return f"coalesce({_any(fr(_STD, days), fr(_LTD, days))}, {fr(_ROLL, days)})"


def _cash(days: int) -> str:
    return f"coalesce({fr(_CSTI, days)}, {_any(fr(_CASH, days), fr(_STI, days))})"


def _valid(tax: str, pre: str) -> str:
    return f"CASE WHEN {pre} > 1.0 AND {tax} / {pre} BETWEEN 0 AND 1 THEN {tax} / {pre} END"


def _over(anchor: str, table: str, expr: str) -> str:
    """By listing: the sum over the dates of a window of an expression over the row of the date; NULL if one is missing."""
    return f"""SELECT w.listing_id, max(w.cadence) AS cadence, CASE WHEN count(x) = count(*) THEN sum(x) END AS v FROM (
      SELECT w.*, {expr} AS x FROM {table} w LEFT JOIN qw ON w.cadence <> 'annual' AND qw.listing_id = w.listing_id AND qw.d = w.d LEFT JOIN yw ON w.cadence = 'annual' AND yw.listing_id = w.listing_id AND yw.d = w.d WHERE w.concept = '{anchor}') w GROUP BY 1"""


_at = lambda c: f"CASE WHEN w.cadence = 'annual' THEN {v(c, 'yw')} ELSE {v(c, 'qw')} END"
_SHARED = f"""{_BASE},
tax AS (SELECT listing_id, yr, {_valid(v(_TAX, 'sw'), v(_PRE, 'sw'))} AS r FROM sw),
tax1 AS (SELECT listing_id, r FROM tax WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY yr DESC) = 1),
dates AS (
  SELECT 'q' AS k, listing_id, d, v_{_SHORT[_AC]} AS ac, p_{_SHORT[_AC]} AS ac_p, {v(_CE, 'qw')} AS ce, p_{_SHORT[_CE]} AS ce_p, {v(_SE, 'qw')} AS se, p_{_SHORT[_SE]} AS se_p, {v('Assets', 'qw')} AS ta, p_{_SHORT['Assets']} AS ta_p, {", ".join(f"{v(c, 'qw')} AS x{i}" for i, c in enumerate((_STD, _LTD, _ROLL, _CASH, _CSTI, _STI, _LC, _GW, _INX, _IN)))} FROM qw
  UNION ALL SELECT 'y', listing_id, d, v_{_SHORT[_AC]}, p_{_SHORT[_AC]}, {v(_CE, 'yw')}, p_{_SHORT[_CE]}, {v(_SE, 'yw')}, p_{_SHORT[_SE]}, {v('Assets', 'yw')}, p_{_SHORT['Assets']}, {", ".join(v(c, 'yw') for c in (_STD, _LTD, _ROLL, _CASH, _CSTI, _STI, _LC, _GW, _INX, _IN))} FROM yw
), bal AS (
  SELECT 'ic' AS what, k, listing_id, d, coalesce(x0 + x1, x2, x0, x1) + coalesce(se, ce) - coalesce(x3, x4) AS v, coalesce(se_p, ce_p) AS p FROM dates
  UNION ALL SELECT 'nwc', k, listing_id, d, ac - coalesce(x4, x3 + coalesce(x5, 0), x5) - CASE WHEN x6 IS NOT NULL THEN greatest(x6 - coalesce(x0, 0), 0) END, ac_p FROM dates
  UNION ALL SELECT 'capital', k, listing_id, d, ta - x6, ta_p FROM dates
  UNION ALL SELECT 'tangible', k, listing_id, d, ce - coalesce(x7, 0) - coalesce(x8, x9, 0), ce_p FROM dates
  UNION ALL SELECT 'assets', k, listing_id, d, ta, ta_p FROM dates UNION ALL SELECT 'ce', k, listing_id, d, ce, ce_p FROM dates
  UNION ALL SELECT 'shares', k, listing_id, d, v, p FROM one WHERE concept = '{_SH}' AND k IN ('q', 'y')
), bal1 AS (SELECT *, row_number() OVER (PARTITION BY what, k, listing_id ORDER BY d DESC) AS rn FROM bal WHERE v IS NOT NULL),
pairs AS (
  SELECT f.what, f.k, f.listing_id, n, f.d, f.v AS now, e.v AS before FROM bal1 f CROSS JOIN (VALUES (1), (5), (10)) c(n)
  JOIN bal1 e ON e.what = f.what AND e.k = f.k AND e.listing_id = f.listing_id AND year(e.d) = year(f.d) - n AND (f.k = 'y' OR e.p = f.p)
  WHERE f.rn = 1 AND f.d >= {REF} - CASE f.k WHEN 'q' THEN 400 ELSE 480 END
  QUALIFY row_number() OVER (PARTITION BY f.what, f.k, f.listing_id, n ORDER BY e.d DESC) = 1
), pair AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY what, listing_id, n ORDER BY k) = 1),
nwcy AS (SELECT *, year(d) AS yr FROM bal1 WHERE what = 'nwc' AND k = 'y' QUALIFY row_number() OVER (PARTITION BY listing_id, year(d) ORDER BY d DESC) = 1),
maint AS (
  SELECT a.listing_id, a.yr, a.d, greatest((a.v - c3.v) / 3, 0) AS v FROM nwcy a JOIN nwcy c1 ON c1.listing_id = a.listing_id AND c1.yr = a.yr - 1 JOIN nwcy c2 ON c2.listing_id = a.listing_id AND c2.yr = a.yr - 2 JOIN nwcy c3 ON c3.listing_id = a.listing_id AND c3.yr = a.yr - 3
), maint1 AS (SELECT m.listing_id, m.v FROM maint m JOIN bal1 n ON n.what = 'nwc' AND n.k = 'y' AND n.rn = 1 AND n.listing_id = m.listing_id AND year(n.d) = m.yr AND n.d >= {REF} - 480),
spend AS (
  SELECT listing_id, d, coalesce(least(abs({v(_CAPEX, 'yw')}), CASE WHEN {v(_CAPEX, 'yw')} IS NULL OR x IS NULL THEN NULL ELSE 1.1 * abs(x) END) + CASE WHEN {v(_CAPEX, 'yw')} IS NULL OR x IS NULL THEN NULL ELSE 0 END, abs({v(_CAPEX, 'yw')}), 1.1 * abs(x)) AS v, x AS da
  FROM (SELECT *, coalesce({v(_DA, 'yw')}, {v(_DACF, 'yw')}) AS x FROM yw) yw WHERE {v(_CAPEX, 'yw')} IS NOT NULL OR x IS NOT NULL
), capt AS (SELECT listing_id, sum(abs(v)) AS v FROM tr WHERE concept = '{_CAPEX}' GROUP BY 1),
rated AS (SELECT yw.listing_id, yw.d, {v(_EBIT, 'yw')} AS ebit, coalesce({v(_NIC, 'yw')}, {v(_NI, 'yw')}) AS ni, {_valid(v(_TAX, 'yw'), v(_PRE, 'yw'))} AS r FROM yw),
rate1 AS (SELECT listing_id, r FROM rated WHERE r IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY d DESC) = 1),
oe AS (
  SELECT r.listing_id, year(r.d) AS yr, r.d, r.ni + coalesce(s.da, 0) - s.v - m.v AS eq, r.ebit * (1 - coalesce(r.r, r1.r, 0.21)) + coalesce(s.da, 0) - s.v - m.v AS ev
  FROM rated r JOIN spend s ON s.listing_id = r.listing_id AND s.d = r.d JOIN maint m ON m.listing_id = r.listing_id AND m.yr = year(r.d) LEFT JOIN rate1 r1 ON r1.listing_id = r.listing_id
), ebd AS ({_over(_EBIT, "ar", f"w.v + coalesce({_at(_DA)}, {_at(_DACF)})")}), gpr AS ({_over(_REV, "ar", f"w.v - coalesce({_at(_COST)}, w.v - {_at(_GP)})")}),
itc AS ({_over(_EBIT, "tr", f"coalesce({_at(_INT)}, {_at(_INT2)})")}),
eps AS (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY d DESC) AS rn FROM y WHERE concept = '{_EPS}'),
grah AS (
  SELECT listing_id, CASE WHEN count(*) FILTER (rn <= 10) = 10 AND max(d) >= {REF} - 480 AND bool_and(v > 0) FILTER (rn <= 3 OR rn BETWEEN 8 AND 10) THEN power(avg(v) FILTER (rn <= 3) / avg(v) FILTER (rn BETWEEN 8 AND 10), 1.0 / 7) - 1 END AS v FROM eps GROUP BY 1
), ocf4 AS (
  SELECT q.listing_id, max(q.d) AS d, sum(q.v - coalesce(c.v, 0)) AS v FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY d DESC) AS rn FROM q WHERE concept = '{_OCF}') q LEFT JOIN q c ON c.listing_id = q.listing_id AND c.concept = '{_CAPEX}' AND c.d = q.d
  WHERE rn <= 4 GROUP BY 1 HAVING count(*) = 4
), div AS (SELECT listing_id, sum(abs(v)) AS v, max(d) AS d, max(cadence) AS cadence FROM ar WHERE concept = '{_DIV}' GROUP BY 1),
paid AS (SELECT DISTINCT listing_id FROM one WHERE concept = '{_DIV}' AND k IN ('q', 'y') AND v <> 0 AND d >= {REF} - 480),
base_w AS (
  SELECT lw.*, {", ".join(f"{v(c, 'tw')} AS t_{s}, {v(c, 'aw')} AS a_{s}, p_a.p_{s} AS k_{s}".replace("p_a.", "aw.") for c, s in _SHORT.items())}, sh.n, sh.nd, sh.price, sh.mcap, tax1.r AS fy_tax,
    {_debt(400)} AS debt4, {_debt(480)} AS debt5, {_cash(400)} AS cash4, {_cash(480)} AS cash5, coalesce(({fr(_STD)}) + ({fr(_LTD)}), {fr(_ROLL)}, {fr(_STD)}, {fr(_LTD)}) AS debt_both,
    greatest({_any(fr(_STD), fr(_LTD))}, {fr(_ROLL)}) AS evidence, {fr("Liabilities")} AS liab, {fr("Assets")} AS ta, coalesce({fr(_GW)}, 0) AS gw, coalesce({fr(_INX)}, 0) AS intang, coalesce({fr(_CE)}, {fr(_SE)}) AS equity,
    CASE WHEN n > 0 AND nd >= {REF} - 400 THEN n END AS sc, ebd.v AS ebd_v, ebd.cadence AS ebd_k, gpr.v AS gp, itc.v AS interest, grah.v AS growth, capt.v AS capex_t, div.v AS divs, div.cadence AS div_k, div.d AS div_d, paid.listing_id IS NOT NULL AS has_paid, maint1.v AS mnt,
    ocf4.v AS fcf4, ocf4.d AS fcf4_d, {", ".join(f"pr_{x}.avg AS avg_{x}" for x in ("assets", "ce", "ic", "capital", "tangible"))}
  FROM lw LEFT JOIN tw USING (listing_id) LEFT JOIN aw USING (listing_id) LEFT JOIN sh USING (listing_id) LEFT JOIN tax1 USING (listing_id) LEFT JOIN ebd USING (listing_id) LEFT JOIN gpr USING (listing_id) LEFT JOIN itc USING (listing_id) LEFT JOIN grah USING (listing_id)
  LEFT JOIN capt USING (listing_id) LEFT JOIN div USING (listing_id) LEFT JOIN paid USING (listing_id) LEFT JOIN maint1 USING (listing_id) LEFT JOIN ocf4 USING (listing_id)
  {" ".join(f"LEFT JOIN (SELECT listing_id, (now + before) / 2 AS avg FROM pair WHERE what = '{x}' AND n = 1) pr_{x} USING (listing_id)" for x in ("assets", "ce", "ic", "capital", "tangible"))}
), w AS (
  SELECT *, t_{_SHORT[_OCF]} - coalesce(t_{_SHORT[_CAPEX]}, 0) AS fcf_t, a_{_SHORT[_OCF]} - coalesce(a_{_SHORT[_CAPEX]}, 0) AS fcf_a, coalesce(t_{_SHORT[_NI]}, t_{_SHORT[_NIC]}) AS ni_t, coalesce(a_{_SHORT[_NI]}, a_{_SHORT[_NIC]}) AS ni_a, coalesce(t_{_SHORT[_NIC]}, t_{_SHORT[_NI]}) AS nic_t,
    coalesce(t_{_SHORT[_DA]}, t_{_SHORT[_DACF]}) AS da_t, coalesce(t_{_SHORT[_EPS]}, (SELECT e.v FROM y1 e WHERE e.listing_id = base_w.listing_id AND e.concept = '{_EPS}' AND e.d >= {REF} - 400)) AS eps_t,
    coalesce({_valid(f"t_{_SHORT[_TAX]}", f"t_{_SHORT[_PRE]}")}, fy_tax, 0.21) AS rate_t, coalesce({_valid(f"a_{_SHORT[_TAX]}", f"a_{_SHORT[_PRE]}")}, fy_tax, 0.21) AS rate_a,
    coalesce(ebd_v, CASE WHEN a_{_SHORT['EBITDA']} >= a_{_SHORT[_EBIT]} THEN a_{_SHORT['EBITDA']} END) AS ebitda, CASE WHEN ebd_v IS NOT NULL THEN ebd_k ELSE k_{_SHORT['EBITDA']} END = 'annual' AS ebitda_annual
  FROM base_w
), z AS (
  SELECT *, CASE WHEN capex_t IS NOT NULL AND da_t IS NOT NULL THEN least(capex_t, 1.1 * da_t) ELSE coalesce(capex_t, 1.1 * da_t) END AS spend_t, CASE WHEN mcap + debt4 - cash4 > 0 THEN mcap + debt4 - cash4 END AS ev4, CASE WHEN mcap + debt5 - cash5 > 0 THEN mcap + debt5 - cash5 END AS ev5,
    coalesce(CASE WHEN mcap > 0 THEN divs / mcap END, CASE WHEN price > 0 THEN abs({fr(_DPS, 400, "w")}) / price END, CASE WHEN divs IS NULL AND {fr(_DPS, 400, "w")} IS NULL AND NOT has_paid AND a_{_SHORT[_OCF]} IS NOT NULL THEN 0 END) AS dy FROM w
)"""
T_ = lambda c: f"t_{_SHORT[c]}"
A_ = lambda c: f"a_{_SHORT[c]}"
V_ = lambda c: f"v_{_SHORT[c]}"
D_ = lambda c: f"d_{_SHORT[c]}"
K_ = lambda c: f"k_{_SHORT[c]}"


def _div(a: str, b: str, more: str = "true") -> str:
    return f"CASE WHEN ({b}) > 0 AND {more} THEN ({a}) / ({b}) END"


def _ev(k: str) -> str:
    return f"CASE WHEN coalesce({k}, false) THEN ev5 ELSE ev4 END"


_NEWER = f"greatest({D_(_AC)}, {D_('Liabilities')}) >= {REF} - 400 AND {D_(_AC)} IS NOT NULL AND {D_('Liabilities')} IS NOT NULL"
_NCAV = f"CASE WHEN {_NEWER} THEN {V_(_AC)} - {V_('Liabilities')} END"
_WC = f"greatest({D_(_AC)}, {D_(_LC)}) >= {REF} - 400 AND {D_(_AC)} IS NOT NULL AND {D_(_LC)} IS NOT NULL"
_lz = lambda c: fr(c, 400, "z")
_EY = _div("eps_t", "price")
_OEQ = f"nic_t + coalesce(da_t, 0) - spend_t - mnt"
_OEV = f"{T_(_EBIT)} * (1 - rate_t) + coalesce(da_t, 0) - spend_t - mnt"
_BBY = f"coalesce({_div(f'-{A_('SalePurchaseOfStock')}', 'mcap')}, {_div(f'-{A_('IssuanceOfCapitalStock')}', 'mcap')}, -((SELECT now / before - 1 FROM pair p WHERE p.what = 'shares' AND p.n = 1 AND p.listing_id = z.listing_id AND now > 0 AND before > 0)))"
_BOOK = f"CASE WHEN z.{D_(_SE)} >= {REF} - 400 THEN z.{V_(_SE)} - gw - intang END"
#: Metrics that are an expression over the wide row of a listing.
PLAIN = {
    "working_capital": f"CASE WHEN {_WC} THEN {V_(_AC)} - {V_(_LC)} END", "current_ratio": f"CASE WHEN {_WC} AND {V_(_LC)} <> 0 THEN {V_(_AC)} / {V_(_LC)} END", "long_term_debt": _lz(_LTD),
    "ncav": _NCAV, "price_to_ncav": _div("mcap", _NCAV),
    "short_term_debt_share": f"CASE WHEN coalesce(({_lz(_STD)}) + ({_lz(_LTD)}), {_lz(_ROLL)}) > 0 AND ({_lz(_STD)}) / coalesce(({_lz(_STD)}) + ({_lz(_LTD)}), {_lz(_ROLL)}) BETWEEN 0 AND 1 THEN ({_lz(_STD)}) / coalesce(({_lz(_STD)}) + ({_lz(_LTD)}), {_lz(_ROLL)}) END",
    "debt_paydown_years": _div("debt_both", "fcf_t", "debt_both > 0"), "fcf_to_debt": _div("fcf_t", "debt_both", "fcf_t > 0"), "cfo_to_ni_ttm": _div(A_(_OCF), "ni_a"),
    "accruals_ratio": _div(f"ni_t - {T_(_OCF)}", "avg_assets"),
    "altman_z": f"CASE WHEN ta > 0 AND liab > 0 THEN 1.2 * (({_lz(_AC)}) - ({_lz(_LC)})) / ta + 1.4 * ({_lz('RetainedEarnings')}) / ta + 3.3 * {A_(_EBIT)} / ta + 0.6 * mcap / liab + {A_(_REV)} / ta END",
    "eps_ttm": "eps_t", "graham_eps_10y_cagr_3y_avg": "growth", "graham_multiplier": f"CASE WHEN eps_t > 0 AND ({_BOOK}) > 0 AND sc > 0 AND price > 0 THEN price / eps_t * (price / (({_BOOK}) / sc)) END", "earnings_yield": _EY,
    "peg_ratio": f"CASE WHEN ({_EY}) > 0 AND growth > 0 THEN 1 / ({_EY}) / (100 * growth) END", "peg_ratio_div_adj": f"CASE WHEN ({_EY}) > 0 AND growth + coalesce(dy, 0) > 0 THEN 1 / ({_EY}) / (100 * (growth + coalesce(dy, 0))) END",
    "interest_coverage": f"""coalesce(CASE WHEN interest > 0 THEN {T_(_EBIT)} / interest END, CASE WHEN {T_(_EBIT)} > 0 AND coalesce(evidence, liab) <= {T_(_EBIT)} THEN 100 END,
      (SELECT CASE WHEN sd >= {REF} - 480 THEN r END FROM (SELECT sw.{V_(_EBIT)} / sw.{V_(_INT)} AS r, sw.{D_(_EBIT)} AS sd FROM sw WHERE sw.listing_id = z.listing_id AND sw.{V_(_INT)} > 0 AND sw.{V_(_EBIT)} IS NOT NULL ORDER BY yr DESC LIMIT 1)))""",
    "market_cap": "mcap", "price_to_book": f"CASE WHEN equity > 0 AND sc > 0 AND price > 0 THEN price / (equity / sc) END", "price_to_tangible_book": f"CASE WHEN equity - gw - intang > 0 AND sc > 0 AND price > 0 THEN price / ((equity - gw - intang) / sc) END",
    "price_to_fcf": f"CASE WHEN fcf4 > 0 AND fcf4_d >= {REF} - 400 THEN mcap / fcf4 END", "net_debt_to_ebitda": _div("CASE WHEN ebitda_annual THEN debt5 - cash5 ELSE debt4 - cash4 END", "ebitda"),
    "ebit_yield_ev": _div(A_(_EBIT), "ev4"), "fcf_yield_ev": _div("fcf_a", "ev4"), "ev_to_ebit": _div(_ev(f"{K_(_EBIT)} = 'annual'"), A_(_EBIT)), "ev_to_ebitda": _div(_ev("ebitda_annual"), "ebitda"), "ev_to_sales": _div(_ev(f"{K_(_REV)} = 'annual'"), A_(_REV)),
    "fcf_to_ebitda": _div("fcf_a", "ebitda"), "sbc_to_revenue": _div(T_("StockBasedCompensation"), T_(_REV)), "sbc_to_fcf": _div(T_("StockBasedCompensation"), "fcf_t"),
    "avg_ic": "avg_ic", "roic_ttm": _div(f"{A_(_EBIT)} * (1 - rate_a)", "avg_ic", f"{A_(_EBIT)} * (1 - rate_a) > 0"), "roce": _div(A_(_EBIT), "avg_capital"), "croic": _div("fcf_a", "avg_ic"),
    "gross_margin_ttm": f"CASE WHEN {A_(_REV)} > 0 AND gp IS NOT NULL THEN greatest(-1, least(1, gp / {A_(_REV)})) END", "operating_margin_ttm": _div(T_(_EBIT), T_(_REV)), "fcf_margin_ttm": _div("fcf_t", T_(_REV)),
    "roe_ttm": _div("nic_t", "avg_ce"), "roa_ttm": _div("ni_t", "avg_assets"), "roetce_ttm": _div("nic_t", "avg_tangible"), "gross_profit_to_assets_ttm": _div("gp", "avg_assets"),
    "net_buyback_yield": _BBY, "dividend_yield_ttm": "dy", "shareholder_yield_ttm": f"dy + ({_BBY})",
    "dividend_payout_ratio_ttm": f"""CASE WHEN divs IS NOT NULL THEN (SELECT CASE WHEN x > 0 THEN divs / x END FROM (SELECT CASE WHEN div_k = 'annual' THEN (SELECT max(v) FROM y WHERE y.concept = '{_NI}' AND y.listing_id = z.listing_id AND y.d = div_d) ELSE ni_t END AS x))
      WHEN ni_a > 0 AND NOT has_paid AND {A_(_OCF)} IS NOT NULL THEN 0 END""",
    "mcapex_ttm": "spend_t", "delta_nwc_maint": "mnt", "oe_equity_ttm": _OEQ, "oe_ev_ttm": _OEV, "oey_equity": _div(_OEQ, "mcap"), "oey_ev": _div(_OEV, "ev4"),
}


def _pair(what: str, n: int, expr: str, k: str | None = None) -> str:
    return f"SELECT listing_id, {expr} AS x FROM {'pair' if k is None else 'pairs'} WHERE what = '{what}' AND n = {n}" + (f" AND k = '{k}'" if k else "")


def _newest_balance(what: str, k: str, days: int) -> str:
    return f"SELECT listing_id, v AS x FROM bal1 WHERE what = '{what}' AND k = '{k}' AND rn = 1 AND d >= {REF} - {days}"


def _strict(series: str, n: int, agg: str) -> str:
    """``series`` gives listing_id, yr, d, v, one row per year."""
    return f"SELECT listing_id, {agg} AS x FROM (SELECT *, max(yr) OVER (PARTITION BY listing_id) AS top, max(d) OVER (PARTITION BY listing_id) AS newest FROM ({series}) WHERE v IS NOT NULL) WHERE yr > top - {n} AND newest >= {REF} - 480 GROUP BY listing_id HAVING count(*) = {n}"


def _chained(series: str, most: int, least: int, agg: str) -> str:
    return f"""SELECT listing_id, {agg} AS x FROM (SELECT *, yr + row_number() OVER (PARTITION BY listing_id ORDER BY yr DESC) AS island, max(yr) OVER (PARTITION BY listing_id) + 1 AS top, max(d) OVER (PARTITION BY listing_id) AS newest, row_number() OVER (PARTITION BY listing_id ORDER BY yr) AS up
      FROM ({series}) WHERE v IS NOT NULL) WHERE island = top AND yr >= top - {most} AND newest >= {REF} - 480 GROUP BY listing_id HAVING count(*) >= {least}"""


def _newest(series: str, n: int, agg: str, exact: bool = True) -> str:
    return f"SELECT listing_id, {agg} AS x FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY listing_id) AS n, max(d) OVER (PARTITION BY listing_id) AS newest FROM ({series}) WHERE v IS NOT NULL) WHERE rn <= {n} AND newest >= {REF} - 480 {f'AND n >= {n}' if exact else ''} GROUP BY listing_id"


_S = lambda expr, date: f"SELECT listing_id, yr, {date} AS d, {expr} AS v FROM sw"
_FCF = _S(f"{V_(_OCF)} - coalesce({V_(_CAPEX)}, 0)", D_(_OCF))
_NIS = _S(f"coalesce({V_(_NI)}, {V_(_NIC)})", f"CASE WHEN {V_(_NI)} IS NOT NULL THEN {D_(_NI)} ELSE {D_(_NIC)} END")
_GM = _S(f"CASE WHEN {V_(_REV)} > 0 THEN coalesce({V_(_GP)}, {V_(_REV)} - {V_(_COST)}) / {V_(_REV)} END", D_(_REV))
_OM = _S(f"CASE WHEN {V_(_REV)} > 0 THEN {V_(_EBIT)} / {V_(_REV)} END", D_(_REV))
_NOPAT = f"SELECT sw.listing_id, sw.yr, {D_(_EBIT)} AS d, {V_(_EBIT)} * (1 - coalesce(tax.r, tax1.r, 0.21)) AS v FROM sw JOIN tax ON tax.listing_id = sw.listing_id AND tax.yr = sw.yr LEFT JOIN tax1 ON tax1.listing_id = sw.listing_id"
_ICY = "SELECT *, year(d) AS yr FROM bal1 WHERE what = 'ic' AND k = 'y' QUALIFY row_number() OVER (PARTITION BY listing_id, year(d) ORDER BY d DESC) = 1"
_ROIC = f"""SELECT n.listing_id, n.yr, n.d, CASE WHEN b > 0 THEN n.v / b END AS v FROM ({_NOPAT}) n JOIN (
  SELECT i.listing_id, i.yr, CASE WHEN i.yr = min(i.yr) OVER (PARTITION BY i.listing_id) THEN i.v ELSE (i.v + e.v) / 2 END AS b FROM ({_ICY}) i LEFT JOIN ({_ICY}) e ON e.listing_id = i.listing_id AND e.yr = i.yr - 1) c ON c.listing_id = n.listing_id AND c.yr = n.yr"""
_CAGR = lambda series: f"SELECT a.listing_id, CASE WHEN a.v > 0 AND b.v > 0 THEN power(a.v / b.v, 0.1) - 1 END AS x FROM (SELECT * FROM ({series}) WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY yr DESC) = 1) a JOIN ({series}) b ON b.listing_id = a.listing_id AND b.yr = a.yr - 10 WHERE a.d >= {REF} - 480"
_OES = lambda c: f"SELECT listing_id, yr, d, {c} AS v FROM oe"
_OEY = f"SELECT listing_id, yr, d, ev AS v FROM oe WHERE ev IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id, yr ORDER BY d DESC) = 1"
_per = lambda sub, by: f"SELECT m.listing_id, CASE WHEN z.{by} > 0 THEN m.x / z.{by} END AS x FROM ({sub}) m JOIN z USING (listing_id)"
#: Metrics that need rows of their own.
GROUPED = {
    "cfo_to_ni_10y_median": _chained(_S(f"CASE WHEN {V_(_OCF)} IS NOT NULL THEN coalesce({V_(_NI)}, {V_(_NIC)}) END", f"CASE WHEN {V_(_NI)} IS NOT NULL THEN {D_(_NI)} ELSE {D_(_NIC)} END").replace(" FROM sw", f", {V_(_OCF)} AS o FROM sw"), 10, 6, "CASE WHEN count(*) FILTER (v > 0) >= ceil(0.6 * count(*)) THEN median(o / v) FILTER (v > 0) END"),
    "fcf_fy_median_5y": _newest(_FCF, 5, "median(v)"), "fcf_neg_years_10y": _strict(_FCF, 10, "count(*) FILTER (v < 0)"), "ni_loss_years_10y": _strict(_NIS, 10, "count(*) FILTER (v < 0)"), "ni_loss_year_share": _chained(_NIS, 10, 6, "count(*) FILTER (v <= 0) / count(*)"),
    "piotroski_f_score": f"""SELECT a.listing_id, CASE WHEN least(a.{V_('Assets')}, b.{V_('Assets')}, c.{V_('Assets')}, a.{V_(_LC)}, b.{V_(_LC)}, a.{V_(_REV)}, b.{V_(_REV)}, a.{V_(_SH)}, b.{V_(_SH)}) > 0 AND a.{V_('Assets')} + b.{V_('Assets')} + c.{V_('Assets')} + a.{V_(_LC)} + b.{V_(_LC)} + a.{V_(_REV)} + b.{V_(_REV)} + a.{V_(_SH)} + b.{V_(_SH)} IS NOT NULL THEN
      CAST(a.{V_(_NI)} / b.{V_('Assets')} > 0 AS INTEGER) + CAST(a.{V_(_OCF)} > 0 AS INTEGER) + CAST(a.{V_(_NI)} / b.{V_('Assets')} > b.{V_(_NI)} / c.{V_('Assets')} AS INTEGER) + CAST(a.{V_(_OCF)} > a.{V_(_NI)} AS INTEGER)
      + CAST((coalesce(a.{V_(_LTD)}, 0) / ((a.{V_('Assets')} + b.{V_('Assets')}) / 2) < coalesce(b.{V_(_LTD)}, 0) / ((b.{V_('Assets')} + c.{V_('Assets')}) / 2)) OR (coalesce(a.{V_(_LTD)}, 0) = 0 AND coalesce(b.{V_(_LTD)}, 0) = 0) AS INTEGER)
      + CAST(a.{V_(_AC)} / a.{V_(_LC)} > b.{V_(_AC)} / b.{V_(_LC)} AS INTEGER) + CAST(a.{V_(_SH)} <= b.{V_(_SH)} AS INTEGER)
      + CAST(CASE WHEN a.{V_(_GP)} IS NOT NULL AND b.{V_(_GP)} IS NOT NULL THEN a.{V_(_GP)} / a.{V_(_REV)} > b.{V_(_GP)} / b.{V_(_REV)} ELSE (a.{V_(_REV)} - a.{V_(_COST)}) / a.{V_(_REV)} > (b.{V_(_REV)} - b.{V_(_COST)}) / b.{V_(_REV)} END AS INTEGER)
      + CAST(a.{V_(_REV)} / b.{V_('Assets')} > b.{V_(_REV)} / c.{V_('Assets')} AS INTEGER) END AS x
      FROM (SELECT * FROM sw WHERE {V_(_NI)} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY yr DESC) = 1) a JOIN sw b ON b.listing_id = a.listing_id AND b.yr = a.yr - 1 JOIN sw c ON c.listing_id = a.listing_id AND c.yr = a.yr - 2 WHERE a.{D_(_NI)} >= {REF} - 480""",
    "eps_streak": "SELECT listing_id, coalesce(min(rn) FILTER (v <= 0), max(rn) + 1) - 1 AS x FROM eps GROUP BY 1", "eps_6y_avg": _newest("SELECT listing_id, d, v FROM eps", 6, "avg(v)"),
    "ic_mqr": _newest_balance("ic", "q", 400), "ic_fy": _newest_balance("ic", "y", 480), "nwc_mqr": _newest_balance("nwc", "q", 400), "nwc_fy": _newest_balance("nwc", "y", 480), "delta_nwc_ttm": _pair("nwc", 1, "now - before", "q"), "delta_nwc_fy": _pair("nwc", 1, "now - before", "y"),
    "share_count_cagr_5y": _pair("shares", 5, "CASE WHEN now > 0 AND before > 0 THEN power(now / before, 0.2) - 1 END"), "share_count_cagr_10y": _pair("shares", 10, "CASE WHEN now > 0 AND before > 0 THEN power(now / before, 0.1) - 1 END"), "shares_10y_pct_change": _pair("shares", 10, "CASE WHEN now > 0 AND before > 0 THEN now / before - 1 END"),
    "roic_10y_median": _strict(_ROIC, 10, "median(v)"), "roic_7y_median": _strict(_ROIC, 7, "median(v)"), "roic_10y_median_adaptive": _chained(_ROIC, 10, 6, "median(v)"), "roic_years_above_12pct": _strict(_ROIC, 10, "count(*) FILTER (v > 0.12)"), "roic_10y_min": _strict(_ROIC, 10, "min(v)"), "roic_7y_min": _strict(_ROIC, 7, "min(v)"),
    "iroic_5y": f"""SELECT listing_id, CASE WHEN di <= 0 OR abs(di) / greatest(abs(ib), 1.0) < 0.01 THEN CASE WHEN dn > 0 THEN 1.0 END ELSE dn / di END AS x FROM (SELECT a.listing_id, a.d, a.v - b.v AS dn, a.i - b.i AS di, b.i AS ib
      FROM (SELECT n.*, c.v AS i FROM ({_NOPAT}) n JOIN ({_ICY}) c ON c.listing_id = n.listing_id AND c.yr = n.yr WHERE n.v IS NOT NULL) a JOIN (SELECT n.*, c.v AS i FROM ({_NOPAT}) n JOIN ({_ICY}) c ON c.listing_id = n.listing_id AND c.yr = n.yr WHERE n.v IS NOT NULL) b ON b.listing_id = a.listing_id AND b.yr = a.yr - 5
      QUALIFY row_number() OVER (PARTITION BY a.listing_id ORDER BY a.yr DESC) = 1) WHERE d >= {REF} - 480""",
    "gm_10y_std": _strict(_GM, 10, "stddev_pop(v)"), "opm_10y_std": _strict(_OM, 10, "stddev_pop(v)"), "opm_10y_min": _strict(_OM, 10, "min(v)"), "opm_7y_min": _strict(_OM, 7, "min(v)"),
    "revenue_cagr_10y": _CAGR(_S(V_(_REV), D_(_REV))), "fcf_per_share_cagr_10y": _CAGR(_S(f"CASE WHEN {V_(_SH)} > 0 THEN ({V_(_OCF)} - coalesce({V_(_CAPEX)}, 0)) / {V_(_SH)} END", D_(_OCF))),
    "owner_earnings_cagr_10y": f"""SELECT listing_id, CASE WHEN new > 0 AND old > 0 THEN power(new / old, 1.0 / (n - 3)) - 1 END AS x FROM (SELECT listing_id, count(*) AS n, avg(v) FILTER (dn <= 3) AS new, avg(v) FILTER (upr <= 3) AS old FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY yr DESC) AS dn, row_number() OVER (PARTITION BY listing_id ORDER BY yr) AS upr FROM (
      SELECT * FROM (SELECT *, yr + row_number() OVER (PARTITION BY listing_id ORDER BY yr DESC) AS island, max(yr) OVER (PARTITION BY listing_id) + 1 AS top, max(d) OVER (PARTITION BY listing_id) AS newest FROM ({_OEY})) WHERE island = top AND yr >= top - 10 AND newest >= {REF} - 480)) GROUP BY 1 HAVING count(*) >= 7)""",
    "mcapex_fy": _newest("SELECT * FROM spend", 1, "avg(v)"), "mcapex_5y": _newest("SELECT * FROM spend", 5, "avg(v)"), "oe_equity_5y_avg": _newest(_OES("eq"), 5, "avg(v)"), "oe_ev_5y_avg": _newest(_OES("ev"), 5, "avg(v)"), "oe_ev_fy_median_5y": _newest(_OES("ev"), 5, "median(v)"), "worst_oe_ev_fy_10y": _strict(_OEY, 10, "min(v)"),
    "oey_equity_5y": _per(_newest(_OES("eq"), 5, "avg(v)"), "mcap"), "oey_ev_norm": _per(_newest(_OES("ev"), 5, "median(v)"), "ev4"),
    "roc_greenblatt_5y_avg": f"""SELECT listing_id, avg(v) AS x FROM (SELECT yw.listing_id, {V_(_EBIT)} / ({V_('PropertyPlantAndEquipmentNet')} + {V_(_AC)} - {V_(_LC)}) AS v FROM yw WHERE {V_('PropertyPlantAndEquipmentNet')} + {V_(_AC)} - {V_(_LC)} > 0 AND {V_(_EBIT)} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY yw.listing_id ORDER BY yw.d DESC) <= 5)
      JOIN lw USING (listing_id) WHERE {D_(_EBIT)} >= {REF} - 480 AND {D_(_AC)} >= {REF} - 480 AND {D_(_LC)} >= {REF} - 480 GROUP BY 1""",
    "roe_greenblatt_5y_avg": "",
}
_OLD = lambda c: f"SELECT listing_id, year(d) AS yr, d, v FROM y WHERE concept = '{c}' QUALIFY row_number() OVER (PARTITION BY listing_id, year(d) ORDER BY d) = 1"
GROUPED["roe_greenblatt_5y_avg"] = _newest(f"SELECT n.listing_id, n.yr, n.d, CASE WHEN a.v + b.v <> 0 THEN n.v / ((a.v + b.v) / 2) END AS v FROM ({_OLD(_NIC)}) n JOIN ({_OLD(_CE)}) a ON a.listing_id = n.listing_id AND a.yr = n.yr JOIN ({_OLD(_CE)}) b ON b.listing_id = n.listing_id AND b.yr = n.yr - 1", 5, "avg(v)", exact=False)


def metric_sql(ids: list[str]) -> str:
    """listing_id, metric_id and value of some metrics on the made-up facts."""
    plain = [i for i in ids if i in PLAIN]
    parts = [f"SELECT listing_id, '{i}' AS metric_id, CAST({PLAIN[i]} AS DOUBLE) AS x FROM z" for i in plain]
    parts += [f"SELECT listing_id, '{i}' AS metric_id, CAST(x AS DOUBLE) AS x FROM ({GROUPED[i]})" for i in ids if i in GROUPED]
    return f"{_SHARED} SELECT listing_id, metric_id, round(x, 6) + 0.0::DOUBLE AS value FROM ({' UNION ALL '.join(parts)}) WHERE x IS NOT NULL"
