"""Nested statements to facts: the entries of flat payload tables, unpivoted by a table of concepts and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import is_subunit, iso_date, resolved_currency, to_number
from factloom.operators.fx import convert

#: Fields of each statement that hold a concept; of several the first that is a number counts (fixed values).
FIELDS = {
    "Financials.Balance_Sheet": {
        "AssetsCurrent": ["totalCurrentAssets"], "LiabilitiesCurrent": ["totalCurrentLiabilities"], "Assets": ["totalAssets"], "Liabilities": ["totalLiabilities", "totalLiab"],
        "StockholdersEquity": ["totalStockholderEquity", "totalShareholderEquity"], "CommonStockholdersEquity": ["commonStockTotalEquity"],
        "PreferredStock": ["preferredStockTotalEquity", "preferredStockRedeemable", "preferredStock"], "Goodwill": ["goodWill"], "IntangibleAssetsNet": ["intangibleAssets"], "NetTangibleAssets": ["netTangibleAssets"],
        "NoncontrollingInterestInConsolidatedEntity": ["noncontrollingInterestInConsolidatedEntity"], "RetainedEarnings": ["retainedEarnings", "retainedEarningsTotalEquity"],
        "CashAndShortTermInvestments": ["cashAndShortTermInvestments"], "CashAndCashEquivalents": ["cash", "cashAndEquivalents"], "ShortTermInvestments": ["shortTermInvestments"],
        "ShortTermDebt": ["shortTermDebt", "shortLongTermDebt"], "LongTermDebtNoncurrent": ["longTermDebtNoncurrent", "longTermDebtTotal", "longTermDebt"],
        "LongTermDebt": ["longTermDebtTotal", "longTermDebt", "longTermDebtNoncurrent"], "TotalDebtFromBalanceSheet": ["shortLongTermDebtTotal"],
        "PropertyPlantAndEquipmentNet": ["propertyPlantAndEquipmentNet", "propertyPlantEquipment", "netPropertyPlantAndEquipment", "propertyPlantAndEquipment"],
        "CommonStockSharesOutstanding": ["shareIssued", "commonStockSharesOutstanding"], "EntityCommonStockSharesOutstanding": ["shareIssued", "commonStockSharesOutstanding"],
    },
    "Financials.Income_Statement": {
        "EBITDA": ["ebitda"], "GrossProfit": ["grossProfit"], "CostOfRevenue": ["costOfRevenue"], "DepreciationDepletionAndAmortization": ["depreciationAndAmortization", "reconciledDepreciation"],
        "IncomeTaxExpense": ["incomeTaxExpense", "taxProvision"], "InterestExpense": ["interestExpense"], "NetIncomeLoss": ["netIncome", "netIncomeFromContinuingOps"],
        "NetIncomeLossAvailableToCommonStockholdersBasic": ["netIncomeApplicableToCommonShares"], "PreferredStockDividendsAndOtherAdjustments": ["preferredStockAndOtherAdjustments"],
        "OperatingIncomeLoss": ["operatingIncome", "ebit"], "IncomeBeforeIncomeTaxes": ["incomeBeforeTax"], "Revenues": ["totalRevenue", "revenue"],
        "EarningsPerShareDiluted": ["epsDiluted", "epsDilluted"], "EarningsPerShareBasic": ["eps", "epsBasic"],
        "WeightedAverageNumberOfDilutedSharesOutstanding": ["weightedAverageShsOutDil", "weightedAverageShsOutDiluted"], "WeightedAverageNumberOfSharesOutstandingBasic": ["weightedAverageShsOut", "weightedAverageShsOutBasic"],
    },
    "Financials.Cash_Flow": {
        "NetCashProvidedByUsedInOperatingActivities": ["totalCashFromOperatingActivities"], "CapitalExpenditures": ["capitalExpenditures", "capex"], "DepreciationFromCashFlow": ["depreciation"],
        "CommonStockDividendsPaid": ["dividendsPaid"], "StockBasedCompensation": ["stockBasedCompensation"], "SalePurchaseOfStock": ["salePurchaseOfStock"], "IssuanceOfCapitalStock": ["issuanceOfCapitalStock"],
    },
    "Earnings": {"EarningsPerShare": ["epsActual"]},
    "outstandingShares": {"CommonStockSharesOutstanding": ["shares"]},
}
#: Concepts that count shares, and those per share (fixed values).
SHARE_COUNTS = ("CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding", "WeightedAverageNumberOfDilutedSharesOutstanding", "WeightedAverageNumberOfSharesOutstandingBasic")
PER_SHARE = ("EarningsPerShare", "EarningsPerShareDiluted", "EarningsPerShareBasic", "CommonStockDividendsPerShareCashPaid")


def unit_kind(concept: Column) -> Column:
    return F.when(concept.isin(*PER_SHARE), "per_share").when(concept.isin(*SHARE_COUNTS), "count").otherwise("monetary")


def _number(*fields: str) -> Column:
    found = [F.col("numbers")[f.lower()] for f in fields]
    return F.coalesce(*found) if len(found) > 1 else found[0]


def _values(section: str) -> Column:
    """Structs (concept, value) of an entry, reported values before those derived from others of the entry."""
    reported = {c: _number(*fs) for c, fs in FIELDS[section].items()}
    n = lambda f: _number(f)
    at_least_0 = lambda c: F.when(c >= 0, c)
    if section == "Financials.Balance_Sheet":
        owed = _number("totalLiabilities", "totalLiab")
        reported["LongTermDebt"] = F.coalesce(reported["LongTermDebt"], at_least_0(owed - n("totalCurrentLiabilities")))
        reported["AssetsCurrent"] = F.coalesce(reported["AssetsCurrent"], at_least_0(n("totalAssets") - n("nonCurrentAssetsTotal")))
        reported["LiabilitiesCurrent"] = F.coalesce(reported["LiabilitiesCurrent"], at_least_0(owed - n("nonCurrentLiabilitiesTotal")))
        reported["PropertyPlantAndEquipmentNet"] = F.coalesce(reported["PropertyPlantAndEquipmentNet"], at_least_0(n("propertyPlantAndEquipmentGross") - n("accumulatedDepreciation")))
        # Of two cash fields, the one that adds up to the provider's own total within a percent; else the first.
        implied = n("cashAndShortTermInvestments") - F.coalesce(n("shortTermInvestments"), F.lit(0.0))
        fits = lambda c: F.when(F.abs(c - implied) <= 0.01 * F.abs(implied), c)
        reported["CashAndCashEquivalents"] = F.coalesce(fits(n("cash")), fits(n("cashAndEquivalents")), reported["CashAndCashEquivalents"])
    elif section == "Financials.Income_Statement":
        pretax = n("incomeBeforeTax") + n("interestExpense") - F.coalesce(n("interestIncome"), F.lit(0.0))
        reported["OperatingIncomeLoss"] = F.coalesce(reported["OperatingIncomeLoss"], pretax, n("totalRevenue") - n("totalOperatingExpenses"))
        net = n("netInterestIncome")
        reported["InterestExpenseFromNetInterestIncome"] = F.when(reported["InterestExpense"].isNull() & (net < 0), -net)
    elif section == "Financials.Cash_Flow":
        operating, spent, free = (reported["NetCashProvidedByUsedInOperatingActivities"], reported["CapitalExpenditures"], n("freeCashFlow"))
        reported["CapitalExpenditures"] = F.coalesce(spent, operating - free)
        reported["NetCashProvidedByUsedInOperatingActivities"] = F.coalesce(operating, free + spent)
    elif section == "outstandingShares":
        reported["CommonStockSharesOutstanding"] = F.coalesce(reported["CommonStockSharesOutstanding"], n("sharesMln") * 1e6)
    positive = lambda c, v: F.when(v > 0, v) if c in SHARE_COUNTS else v
    return F.array(*(F.struct(F.lit(c).alias("concept"), positive(c, v).alias("value")) for c, v in reported.items()))


def _snapshots(payload: DataFrame, key: str) -> DataFrame:
    """Facts that a payload states about itself at its own date: share count, dividend per share, market value."""
    f = lambda name: F.col("__payload")[name]
    shares = F.coalesce(to_number(f("sharesstats.sharesoutstanding")), to_number(f("sharesstats.sharesfloat")))
    recorded = F.coalesce(f("highlights.currency_symbol"), f("general.currencycode"))
    scale = F.when(is_subunit(recorded), 100.0).otherwise(1.0)
    cap, dividend = to_number(f("highlights.marketcapitalization")), to_number(f("highlights.dividendshare"))
    cell = lambda c, period, v, code: F.struct(F.lit(c).alias("concept"), F.lit(period).alias("fiscal_period"), v.alias("value"), code.alias("currency"))
    cells = F.array(
        cell("CommonStockSharesOutstanding", "INSTANT", F.when(shares > 0, shares), F.lit(None).cast("string")),
        cell("ProviderMarketCapitalization", "INSTANT", F.when(cap > 0, cap), resolved_currency(recorded)),
        cell("CommonStockDividendsPerShareCashPaid", "TTM", dividend / scale, resolved_currency(recorded)),
    )
    rows = payload.select(key, iso_date(f("general.updatedat")).alias("end_date"), F.inline(cells)).filter("value IS NOT NULL AND end_date IS NOT NULL")
    rows = rows.withColumn("unit_kind", unit_kind(F.col("concept"))).filter("unit_kind = 'count' OR currency IS NOT NULL")
    return rows.select(key, "concept", "fiscal_period", "end_date", "unit_kind", "value", F.lit(None).cast("date").alias("filed"), "currency")


def facts_from_entries(rows: DataFrame, key: str) -> DataFrame:
    """Facts (``key``, concept, fiscal_period, end_date, unit_kind, value, filed, currency) of the rows of ``nested.flatten``.

    Yearly entries are fiscal years, others quarters by the month of their end.  The end date is the entry's date, else its map
    key (a bare year of a share count ends with that year); entries without one give no facts.  The currency is the entry's, else
    the statement's, else the payload's; amounts in hundredths are divided once.  Values that are no numbers are missing, as are
    share counts of 0 or less.  Earnings reported after the payload's own date, and zeros without a statement of the quarter, are
    placeholders and left out.  Of several facts of one natural key the last in the payload counts, of share counts the smallest.
    Numbers stay in their row until the unpivot; the payload's own fields join by key."""
    payload = rows.filter("table_name = 'payloads'").select(key, F.col("fields").alias("__payload"))
    # Every field is read as a number once.
    entries = rows.filter("table_name = 'entries'").join(payload, key).withColumn("numbers", F.transform_values("fields", lambda _, v: to_number(v)))
    text = F.when(F.map_contains_key("fields", F.lit("date")), F.col("fields")["date"]).otherwise(F.col("map_key"))
    text = F.when(F.col("section").startswith("outstandingShares"), F.coalesce(F.col("fields")["dateformatted"], text)).otherwise(text)
    date = F.coalesce(iso_date(text), F.when(F.col("section").startswith("outstandingShares") & text.rlike("^[0-9]{4}$"), F.try_to_date(F.concat(text, F.lit("-12-31")), "yyyy-MM-dd")))
    statement = F.lower(F.regexp_replace("section", r"\.[^.]*$", ""))
    values = F.array()
    for section in reversed(FIELDS):
        values = F.when(F.col("section").startswith(f"{section}."), _values(section)).otherwise(values.cast("array<struct<concept:string,value:double>>"))
    recorded = F.coalesce(F.col("fields")["currency_symbol"], F.col("__payload")[F.concat(statement, F.lit(".currency_symbol"))], F.col("__payload")["general.currencycode"])
    facts = entries.select(
        key, date.alias("end_date"), F.coalesce(iso_date(F.col("fields")["filing_date"]), iso_date(F.col("fields")["reportdate"])).alias("filed"), "section",
        F.when(F.col("section").rlike(r"\.(yearly|Annual|annual)$"), "FY").otherwise(F.concat(F.lit("Q"), F.quarter(date).cast("string"))).alias("fiscal_period"),
        (iso_date(F.col("fields")["reportdate"]) > iso_date(F.col("__payload")["general.updatedat"])).alias("early"),
        resolved_currency(recorded).alias("code"), is_subunit(recorded).alias("sub"), "row_key", F.col("ordinal"), F.inline(values),
    ).filter("value IS NOT NULL AND end_date IS NOT NULL")
    history = F.col("section") == "Earnings.History"
    # A quarter with a reported net income: one row per date.
    stated = facts.filter("section = 'Financials.Income_Statement.quarterly' AND concept IN ('NetIncomeLoss', 'EarningsPerShareDiluted', 'EarningsPerShareBasic')").select(key, F.col("end_date").alias("__stated")).distinct()
    zero = facts.filter(history & (F.col("value") == 0) & ~F.coalesce("early", F.lit(False)))
    zero = zero.join(stated, (zero[key] == stated[key]) & (zero["end_date"] == stated["__stated"]), "left_semi")
    facts = facts.filter(~history | (~F.coalesce("early", F.lit(False)) & (F.col("value") != 0))).unionByName(zero)
    kind = unit_kind(F.col("concept"))
    facts = facts.select(
        key, "concept", "fiscal_period", "end_date", kind.alias("unit_kind"), F.when(F.col("sub") & (kind != "count"), F.col("value") / 100).otherwise(F.col("value")).alias("value"),
        "filed", F.when(kind != "count", F.col("code")).alias("currency"), "ordinal", "row_key",
    )
    order = F.struct(F.when(F.col("unit_kind") == "count", -F.abs("value")).alias("a"), F.col("ordinal"), F.col("row_key"))
    keys = [key, "concept", "fiscal_period", "end_date"]
    out = facts.groupBy(*keys).agg(F.max_by(F.struct("unit_kind", "value", "filed", "currency"), order).alias("r")).select(*keys, "r.*")
    return out.unionByName(_snapshots(payload, key))


def with_derived_facts(facts: DataFrame, key: str) -> DataFrame:
    """Facts plus those that follow from others of their period, where they are missing; common equity is always derived.

    Earnings per share from diluted, then basic; intangibles without goodwill from intangibles, else from equity less tangible assets
    and goodwill; equity from assets less liabilities (0 or more), else common equity; income for common from net income less
    preferred dividends; common equity from equity less preferred stock and minorities.  Amounts of different currencies give
    nothing.  A period of one key holds one row per concept, so its map is bounded by the number of concepts."""
    by = [key, "fiscal_period", "end_date"]
    wide = facts.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("concept", F.struct("value", "filed", "currency").alias("f")))).alias("m"))
    f = lambda c: F.col("m")[c]
    v = lambda c: f(c)["value"]
    same = lambda a, b: f(b).isNull() | f(a)["currency"].eqNullSafe(f(b)["currency"])
    zero = lambda c: F.coalesce(v(c), F.lit(0.0))
    less = lambda base, *others: F.when(sum((same(base, o).cast("int") for o in others), F.lit(0)) == len(others), v(base) - sum((zero(o) for o in others), F.lit(0.0)))
    made = lambda c, value, base, force=False: F.when((F.lit(force) | f(c).isNull()) & value.isNotNull(), F.struct(F.lit(c).alias("concept"), value.alias("value"), f(base)["filed"].alias("filed"), f(base)["currency"].alias("currency")))
    equity = F.when(f("Assets").isNotNull() & f("Liabilities").isNotNull() & same("Assets", "Liabilities") & (v("Assets") >= v("Liabilities")), v("Assets") - v("Liabilities"))
    own = F.coalesce(v("StockholdersEquity"), equity, v("CommonStockholdersEquity"))
    base = F.when(f("StockholdersEquity").isNotNull(), F.lit("StockholdersEquity")).when(equity.isNotNull(), F.lit("Assets")).otherwise(F.lit("CommonStockholdersEquity"))
    at = F.col("m")[base]
    matches = lambda c: f(c).isNull() | at["currency"].eqNullSafe(f(c)["currency"])
    common = F.when(matches("PreferredStock") & matches("NoncontrollingInterestInConsolidatedEntity"), own - zero("PreferredStock") - zero("NoncontrollingInterestInConsolidatedEntity"))
    tangible = F.when(f("NetTangibleAssets").isNotNull() & f("Assets").isNotNull() & f("Liabilities").isNotNull() & same("Assets", "Liabilities") & same("Assets", "NetTangibleAssets") & same("Assets", "Goodwill"), v("Assets") - v("Liabilities") - v("NetTangibleAssets") - zero("Goodwill"))
    cells = [
        made("EarningsPerShare", v("EarningsPerShareDiluted"), "EarningsPerShareDiluted"),
        F.when(f("EarningsPerShareDiluted").isNull(), made("EarningsPerShare", v("EarningsPerShareBasic"), "EarningsPerShareBasic")),
        made("IntangibleAssetsNetExcludingGoodwill", v("IntangibleAssetsNet"), "IntangibleAssetsNet"),
        F.when(f("IntangibleAssetsNet").isNull(), made("IntangibleAssetsNetExcludingGoodwill", F.when(tangible >= 0, tangible), "Assets")),
        F.when(f("StockholdersEquity").isNull() & own.isNotNull(), F.struct(F.lit("StockholdersEquity").alias("concept"), own.alias("value"), at["filed"].alias("filed"), at["currency"].alias("currency"))),
        made("NetIncomeLossAvailableToCommonStockholdersBasic", less("NetIncomeLoss", "PreferredStockDividendsAndOtherAdjustments"), "NetIncomeLoss"),
        F.when(common.isNotNull(), F.struct(F.lit("CommonStockholdersEquity").alias("concept"), common.alias("value"), at["filed"].alias("filed"), at["currency"].alias("currency"))),
        made("CommonStockSharesOutstanding", v("EntityCommonStockSharesOutstanding"), "EntityCommonStockSharesOutstanding"),
    ]
    new = wide.select(*by, F.explode(F.array_compact(F.array(*cells))).alias("c")).select(key, "c.concept", "fiscal_period", "end_date", unit_kind(F.col("c.concept")).alias("unit_kind"), "c.value", "c.filed", "c.currency")
    kept = facts.join(new.filter("concept = 'CommonStockholdersEquity'").select(*by, "concept"), [*by, "concept"], "left_anti").select(*facts.columns)
    return kept.unionByName(new.select(*facts.columns))


def in_target_currency(facts: DataFrame, key: str, targets: DataFrame, rates: DataFrame) -> DataFrame:
    """Facts in the currency of their key (``targets``: key, target) by the rate as of their end date; money without a rate or without
    a currency is left out, counts stay as they are."""
    rows = facts.join(targets.select(key, "target"), key)
    money = F.col("unit_kind").isin("monetary", "per_share")
    done = convert(rows.filter(money), "value", "currency", "end_date", "target", rates).filter("converted IS NOT NULL")
    done = done.withColumn("value", F.col("converted")).withColumn("currency", F.col("target")).select(*facts.columns)
    return done.unionByName(rows.filter(~money).select(*facts.columns))


def with_implied_eps(facts: DataFrame, key: str, days: int = 120) -> DataFrame:
    """Facts plus earnings per share where none is reported: net income over the share count nearest in time (at most ``days``
    away; ties: the earlier).  Reported values stay.  Share counts are few per key, so their list joins as one row."""
    shares = facts.filter("concept = 'CommonStockSharesOutstanding' AND value > 0").groupBy(key).agg(F.array_sort(F.collect_set(F.struct("end_date", "value"))).alias("__shares"))
    income = facts.filter("concept = 'NetIncomeLoss'").join(facts.filter("concept = 'EarningsPerShare'").select(key, "fiscal_period", "end_date"), [key, "fiscal_period", "end_date"], "left_anti")
    near = F.transform("__shares", lambda s: F.struct(F.abs(F.datediff(s["end_date"], F.col("end_date"))).alias("away"), s["end_date"].alias("d"), s["value"].alias("v")))
    income = income.join(shares, key).withColumn("__n", F.array_min(near)).filter(F.col("__n.away") <= days)
    implied = income.select(key, F.lit("EarningsPerShare").alias("concept"), "fiscal_period", "end_date", F.lit("per_share").alias("unit_kind"), (F.col("value") / F.col("__n.v")).alias("value"), "filed", "currency")
    return facts.unionByName(implied)


def unit_flips(df: DataFrame, series: list[str], at: str, value: str, low: float = 40.0, high: float = 140.0) -> DataFrame:
    """``df`` with ``scale`` (1 or 0.01): stretches of a series recorded in hundredths among whole units.

    A new stretch begins where neighbours differ by a factor between ``low`` and ``high``; stretches whose median lies above the
    geometric mean of the least and greatest median are in hundredths.  One stretch alone tells nothing (scale 1).  Rows with
    NULL, 0 or NaN begin no stretch.  ``series`` and ``at`` should be unique."""
    w = Window.partitionBy(*series).orderBy(at)
    v = F.abs(F.when(~F.isnan(value) & (F.col(value) != 0), F.col(value)))
    rows = df.withColumn("__v", v).withColumn("__p", F.last("__v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    jump = F.greatest(F.col("__v") / F.col("__p"), F.col("__p") / F.col("__v")).between(low, high)
    rows = rows.withColumn("__s", F.sum(F.coalesce(jump, F.lit(False)).cast("int")).over(w)).withColumn("__m", F.percentile("__v", F.lit(0.5)).over(Window.partitionBy(*series, "__s")))
    whole = Window.partitionBy(*series)
    edge = F.sqrt(F.min("__m").over(whole) * F.max("__m").over(whole))
    scale = F.when((F.max("__s").over(whole) > 0) & (F.col("__m") > edge), 0.01).otherwise(1.0)
    return rows.withColumn("scale", scale).drop("__v", "__p", "__s", "__m")
