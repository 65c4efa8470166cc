"""The registry of metrics: id, unit kind and expression, computed together over one wide row per listing.

Stages: the arrays of each concept; windows and newest values; composites (debt, cash, flows, invested capital); metrics.
Each stage is a projection with the columns that the chosen metrics ask for, so the whole computation has the exchanges that bring a
listing's facts together and nothing is read or planned that no metric needs.
User metrics are added with ``register``; they see the same columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.metrics import series as M
from factloom.operators.facts import MAX_AGE, MAX_AGE_FY, period_rank

#: Concepts the metrics read (fixed values).
CONCEPTS = (
    "Assets", "AssetsCurrent", "CapitalExpenditures", "CashAndCashEquivalents", "CashAndShortTermInvestments", "CommonStockDividendsPaid",
    "CommonStockDividendsPerShareCashPaid", "CommonStockSharesOutstanding", "CommonStockholdersEquity", "CostOfRevenue",
    "DepreciationDepletionAndAmortization", "DepreciationFromCashFlow", "EBITDA", "EarningsPerShare", "EntityCommonStockSharesOutstanding",
    "Goodwill", "GrossProfit", "IncomeBeforeIncomeTaxes", "IncomeTaxExpense", "IntangibleAssetsNet", "IntangibleAssetsNetExcludingGoodwill",
    "InterestExpense", "InterestExpenseFromNetInterestIncome", "IssuanceOfCapitalStock", "Liabilities", "LiabilitiesCurrent", "LongTermDebt",
    "NetCashProvidedByUsedInOperatingActivities", "NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "OperatingIncomeLoss",
    "PropertyPlantAndEquipmentNet", "ProviderMarketCapitalization", "RetainedEarnings", "Revenues", "SalePurchaseOfStock", "ShortTermDebt",
    "ShortTermInvestments", "StockBasedCompensation", "StockholdersEquity", "TotalDebtFromBalanceSheet",
)
#: Concepts whose negative values are dropped, never turned (fixed values).
GUARDED = ("DepreciationDepletionAndAmortization", "DepreciationFromCashFlow", "InterestExpense", "InterestExpenseFromNetInterestIncome")

OCF, CAPEX, NI, NIC, EBIT, REV = "NetCashProvidedByUsedInOperatingActivities", "CapitalExpenditures", "NetIncomeLoss", "NetIncomeLossAvailableToCommonStockholdersBasic", "OperatingIncomeLoss", "Revenues"
DA, DACF, STD, LTD, ROLLUP = "DepreciationDepletionAndAmortization", "DepreciationFromCashFlow", "ShortTermDebt", "LongTermDebt", "TotalDebtFromBalanceSheet"
CASH, STI, CASHSTI, SE, CE = "CashAndCashEquivalents", "ShortTermInvestments", "CashAndShortTermInvestments", "StockholdersEquity", "CommonStockholdersEquity"
SHARES, ENTITY, EPS = "CommonStockSharesOutstanding", "EntityCommonStockSharesOutstanding", "EarningsPerShare"


def fact_arrays(facts: DataFrame) -> DataFrame:
    """One row per listing: ``q`` and ``y`` (quarterly and fiscal-year facts of each concept, newest first, one per end date) and ``l``
    (the newest fact of each concept of any period), as maps by concept.

    A listing holds at most as many entries as there are concepts, periods and days, whatever its share of the rows."""
    ok = F.col("value").isNotNull() & ~F.isnan("value") & F.col("end_date").isNotNull() & F.col("concept").isin(*CONCEPTS)
    rows = facts.filter(ok & ~(F.col("concept").isin(*GUARDED) & (F.col("value") < 0)))
    kind = F.when(F.col("fiscal_period").rlike("^Q[1-4]$"), "q").when(F.col("fiscal_period") == "FY", "y").otherwise("o")
    newest = F.struct(F.coalesce("filed", F.lit("0001-01-01").cast("date")), -period_rank(), "value")
    rows = rows.groupBy("listing_id", "concept", kind.alias("kind"), "end_date").agg(F.max_by(F.struct("value", "fiscal_period", "filed"), newest).alias("r"))
    fact = F.struct(F.col("end_date").alias("d"), F.col("r.value").alias("v"), F.col("r.fiscal_period").alias("p"), F.col("kind"), F.struct(F.coalesce("r.filed", F.lit("0001-01-01").cast("date")).alias("f"), (-F.coalesce(F.array_position(F.array(F.lit("y"), F.lit("q"), F.lit("o")), F.col("kind")), F.lit(9))).alias("k")).alias("o"))
    rows = rows.groupBy("listing_id", "concept").agg(F.sort_array(F.collect_list(fact), False).alias("a"))
    part = lambda k: F.transform(F.filter("a", lambda x: x["kind"] == k), lambda x: F.struct(x["d"].alias("d"), x["v"].alias("v"), x["p"].alias("p")))
    newest_fact = F.get(F.sort_array(F.transform("a", lambda x: F.struct(x["d"].alias("d"), x["o"].alias("o"), x["v"].alias("v"), x["p"].alias("p"))), False), F.lit(0))
    rows = rows.select("listing_id", "concept", part("q").alias("q"), part("y").alias("y"), F.struct(newest_fact["v"].alias("v"), newest_fact["d"].alias("d"), newest_fact["p"].alias("p")).alias("l"))
    entries = lambda c: F.map_from_entries(F.collect_list(F.struct("concept", c))).alias(c)
    return rows.groupBy("listing_id").agg(entries("q"), entries("y"), entries("l"))


#: Names of columns of the wide row that were asked for since the set was last emptied.
_asked: set[str] = set()


def col(name: str) -> Column:
    """A column of the wide row; only columns asked for are computed."""
    _asked.add(name)
    return F.col(name)


def _c(prefix: str) -> Callable[[str], Column]:
    return lambda concept: col(f"{prefix}_{concept}")


Q, Y, L, T, A, S = (_c(p) for p in "qyltas")


def _less(a: Column, b: Column) -> Column:
    """a minus b, where a missing b counts as 0."""
    return M.let(F.struct(a.alias("a"), b.alias("b")), lambda p: M.val(p["a"]["v"] - F.coalesce(p["b"]["v"], F.lit(0.0)), p["a"]["d"]))


def _plus(a: Column, b: Column, need: str) -> Column:
    """Sum of two values: need both, or any."""
    if need == "both":
        return M.both(a, b, lambda x, y: x + y)
    return M.let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.coalesce(M.both(p["a"], p["b"], lambda x, y: x + y), p["a"], p["b"]))


def _bare(x: Column) -> Column:
    return M.let(x, lambda p: M.val(p["v"], p["d"]))


def _first(arr: Column) -> Column:
    return F.get(arr, F.lit(0))


def composites(ref: Column) -> dict[str, Callable[[], Column]]:
    """The composites by name: what several metrics share, built only where asked for."""
    fresh = lambda c, days=MAX_AGE: _bare(M.fresh(L(c), ref, days))
    rate = lambda tax, pre: F.when((pre > 1.0) & (tax / pre).between(0.0, 1.0), tax / pre)

    def any_side(days: int) -> Column:
        return F.coalesce(_plus(fresh(STD, days), fresh(LTD, days), "any"), fresh(ROLLUP, days))

    def cash(days: int) -> Column:
        return F.coalesce(fresh(CASHSTI, days), _plus(fresh(CASH, days), fresh(STI, days), "any"))

    def ebitda() -> Column:
        ebit, vendor = A(EBIT), A("EBITDA")
        source = lambda c: F.when(ebit["cadence"] == "annual", Y(c)).otherwise(Q(c))
        added = F.transform(ebit["rows"], lambda r: F.coalesce(M.at(source(DA), r["d"]), M.at(source(DACF), r["d"])))
        built = F.struct((ebit["v"] + M.sum_if_whole(added)).alias("v"), ebit["d"].alias("d"), ebit["cadence"].alias("cadence"))
        given = F.struct(vendor["v"].alias("v"), vendor["d"].alias("d"), vendor["cadence"].alias("cadence"))
        return M.let(built, lambda x: F.when(x["v"].isNotNull(), x).otherwise(F.when(vendor["v"] >= ebit["v"], given)))

    def gross_profit() -> Column:
        rev = A(REV)
        source = lambda c: F.when(rev["cadence"] == "annual", Y(c)).otherwise(Q(c))
        costs = F.transform(rev["rows"], lambda r: F.coalesce(M.at(source("CostOfRevenue"), r["d"]), r["v"] - M.at(source("GrossProfit"), r["d"])))
        return M.val(rev["v"] - M.sum_if_whole(costs), rev["d"])

    def invested(arr: Callable[[str], Column]) -> Column:
        def of(x: Column) -> Column:
            std, ltd, roll, se, ce, cash, both = (M.at(arr(c), x["d"]) for c in (STD, LTD, ROLLUP, SE, CE, CASH, CASHSTI))
            return F.coalesce(std + ltd, roll, std, ltd) + F.coalesce(se, ce) - F.coalesce(cash, both)

        return _rows_of(M.either(arr(SE), arr(CE), "d"), of)

    def working(arr: Callable[[str], Column]) -> Column:
        def of(x: Column) -> Column:
            held = F.coalesce(M.at(arr(CASHSTI), x["d"]), M.at(arr(CASH), x["d"]) + F.coalesce(M.at(arr(STI), x["d"]), F.lit(0.0)), M.at(arr(STI), x["d"]))
            owed = M.at(arr("LiabilitiesCurrent"), x["d"])
            return x["v"] - held - F.when(owed.isNotNull(), F.greatest(owed - F.coalesce(M.at(arr(STD), x["d"]), F.lit(0.0)), F.lit(0.0)))

        return _rows_of(arr("AssetsCurrent"), of)

    def tangible(arr: Callable[[str], Column]) -> Column:
        def of(x: Column) -> Column:
            other = F.coalesce(M.at(arr("IntangibleAssetsNetExcludingGoodwill"), x["d"]), M.at(arr("IntangibleAssetsNet"), x["d"]), F.lit(0.0))
            return x["v"] - F.coalesce(M.at(arr("Goodwill"), x["d"]), F.lit(0.0)) - other

        return _rows_of(arr(CE), of)

    out = {
        "debt_any": lambda: any_side(MAX_AGE),
        "debt_any_fy": lambda: any_side(MAX_AGE_FY),
        "debt_both": lambda: F.coalesce(_plus(fresh(STD), fresh(LTD), "both"), fresh(ROLLUP), fresh(STD), fresh(LTD)),
        "debt_evidence": lambda: M.val(F.greatest(_plus(fresh(STD), fresh(LTD), "any")["v"], fresh(ROLLUP)["v"]), F.greatest(fresh(STD)["d"], fresh(LTD)["d"], fresh(ROLLUP)["d"])),
        "cash_any": lambda: cash(MAX_AGE),
        "cash_any_fy": lambda: cash(MAX_AGE_FY),
        "equity_common": lambda: F.coalesce(fresh(CE), fresh(SE)),
        "intangibles": lambda: fresh("IntangibleAssetsNetExcludingGoodwill"),
        "goodwill": lambda: fresh("Goodwill"),
        "liabilities": lambda: fresh("Liabilities"),
        "mcap": lambda: M.val(col("price") * col("shares_v"), col("price_date"), (col("price") > 0) & (col("shares_v") > 0)),
        "px": lambda: M.val(col("price"), col("price_date"), col("price") > 0),
        "eps_t": lambda: F.coalesce(_bare(T(EPS)), M.fresh(_bare(_first(Y(EPS))), ref)),
        "da_t": lambda: F.coalesce(_bare(T(DA)), _bare(T(DACF))),
        "ebitda": ebitda,
        "ebitda_annual": lambda: F.coalesce(col("ebitda")["cadence"] == "annual", F.lit(False)),
        "gross_profit": gross_profit,
        "s_tax": lambda: M.combined(S("IncomeTaxExpense"), S("IncomeBeforeIncomeTaxes"), f=rate),
        "tax_rate": lambda: F.coalesce(rate(T("IncomeTaxExpense")["v"], T("IncomeBeforeIncomeTaxes")["v"]), _first(col("s_tax"))["v"], F.lit(0.21)),
        "tax_rate_annual": lambda: F.coalesce(rate(A("IncomeTaxExpense")["v"], A("IncomeBeforeIncomeTaxes")["v"]), _first(col("s_tax"))["v"], F.lit(0.21)),
        "s_fcf": lambda: M.combined(S(OCF), S(CAPEX), f=lambda o, c: o - F.coalesce(c, F.lit(0.0))),
        "s_ni": lambda: M.either(S(NI), S(NIC), "y"),
    }
    out |= {name: lambda build=build: build(ref) for name, build in _SHARED.items()}
    for n, W in (("t", T), ("a", A)):
        out[f"fcf_{n}"] = lambda W=W: _less(_bare(W(OCF)), _bare(W(CAPEX)))
        out[f"ni_{n}"] = lambda W=W: F.coalesce(_bare(W(NI)), _bare(W(NIC)))
        out[f"nic_{n}"] = lambda W=W: F.coalesce(_bare(W(NIC)), _bare(W(NI)))
    for n, arr in (("q", Q), ("y", Y)):
        out[f"ic_{n}"] = lambda arr=arr: invested(arr)
        out[f"nwc_{n}"] = lambda arr=arr: working(arr)
        out[f"tangible_{n}"] = lambda arr=arr: tangible(arr)
        out[f"capital_{n}"] = lambda arr=arr: _rows_of(arr("Assets"), lambda x: x["v"] - M.at(arr("LiabilitiesCurrent"), x["d"]))
    return out


def _rows_of(base: Column, value: Callable[[Column], Column]) -> Column:
    rows = F.transform(base, lambda x: F.struct(x["d"].alias("d"), value(x).alias("v"), x["p"].alias("p")))
    return F.filter(rows, lambda x: x["v"].isNotNull())


def _share_count() -> Column:
    """Struct v, d: the snapshot of common shares against the freshest periodic count; close ones agree, else the market
    capitalization at the price decides by the nearer ratio, else a far larger periodic count wins."""
    snap = F.when(L(SHARES)["p"] == "INSTANT", L(SHARES))
    first = lambda c: F.coalesce(F.get(Q(c), F.lit(0)), F.get(Y(c), F.lit(0)))
    e, s = first(ENTITY), first(SHARES)
    periodic = F.when(s.isNull() | (e["d"] >= s["d"]), F.coalesce(e, s)).otherwise(s)
    a, b = snap["v"], periodic["v"]
    far = F.greatest(a, b) / F.least(a, b)
    anchor = L("ProviderMarketCapitalization")["v"] / col("price")
    off = lambda x: F.greatest(x / anchor, anchor / x)
    chosen = F.when(a.isNull(), b).when(b.isNull() | (far <= 1.02), a).when((anchor > 0) & (F.least(off(a), off(b)) <= 2.0), F.when(off(b) <= off(a), b).otherwise(a)).when(b / a >= 1.25, b).otherwise(a)
    return M.let(chosen, lambda c: F.struct(c.alias("v"), F.when(c == a, snap["d"]).otherwise(periodic["d"]).alias("d")))


#: Parts of several metrics that the catalogue adds to the composites.
_SHARED: dict[str, Callable[[Column], Column]] = {}


def shared(name: str, build: Callable[[Column], Column]) -> Callable[..., Column]:
    """Makes ``build(reference_date)`` a column of the wide row, computed once however many metrics ask for it."""
    _SHARED[name] = build
    return lambda *_: col(name)


_REGISTRY: dict[str, tuple[str, Callable[[Column], Column]]] = {}


def register(metric_id: str, unit_kind: str, build: Callable[[Column], Column]) -> None:
    """Adds a metric: ``build(reference_date)`` gives a value (struct v, d) over the columns of the wide row."""
    _REGISTRY[metric_id] = (unit_kind, build)


def metric(metric_id: str, unit_kind: str) -> Callable:
    return lambda build: (register(metric_id, unit_kind, build), build)[1]


#: Metrics of the catalogue, which ask for their columns by ``col``.
_BUILT_IN: set[str] = set()


def metric_ids() -> list[str]:
    return list(_REGISTRY)


def _stages(names: set[str], ref: Column) -> list[dict[str, Column]]:
    """The columns that ``names`` need, in the order of the projections that make them: windows and series, share count, composites."""
    made = composites(ref)
    built: dict[str, Column] = {}
    needs: dict[str, set[str]] = {}
    known, frontier = set(), set(names)
    while frontier:
        known |= frontier
        asked: set[str] = set()
        for n in sorted(frontier):
            _asked.clear()
            if n in made:
                built[n] = made[n]()
                needs[n] = set(_asked)
            elif n in ("shares_v", "shares_d") and "shares" not in built:
                built["shares"] = _share_count()
            asked |= _asked
        frontier = asked - known
    concepts = {n[2:] for n in known if n[:2] in ("q_", "y_", "l_", "t_", "a_", "s_") and n[2:] in CONCEPTS}
    base: dict[str, Column] = {}
    empty = "array<struct<d:date,v:double,p:string>>"
    for c in sorted(concepts):
        kinds = {n[0] for n in known if n[2:] == c and n[1] == "_"}
        for k in "qy":
            if kinds & ({"t", "a", "s", k} if k == "y" else {"t", "a", k}):
                base[f"{k}_{c}"] = F.coalesce(F.col(k)[c], F.array().cast(empty))
        if "l" in kinds:
            base[f"l_{c}"] = F.col("l")[c]
    second: dict[str, Column] = {}
    for c in sorted(concepts):
        kinds = {n[0] for n in known if n[2:] == c and n[1] == "_"}
        for k in kinds & {"t", "a"}:
            second[f"{k}_{c}"] = M.window(F.col(f"q_{c}"), F.col(f"y_{c}"), ref, k == "a")
        if "s" in kinds:
            second[f"s_{c}"] = M.yearly(F.col(f"y_{c}"))
    if "shares" in built:
        second["shares"] = built.pop("shares")
    # A composite comes after those it asks for.
    order: list[dict[str, Column]] = [base, second]
    left = dict(built)
    ready = set(base) | set(second) | {"price", "price_date", "shares_v", "shares_d"}
    while left:
        step = {n: c for n, c in left.items() if not (needs[n] & set(made)) - ready}
        if not step:
            raise ValueError(f"composites need each other: {sorted(left)}")
        order.append(step)
        ready |= set(step)
        left = {n: c for n, c in left.items() if n not in step}
    return order


def wide_rows(facts: DataFrame, market: DataFrame | None, reference: Column, names: set[str]) -> DataFrame:
    """The wide row of each listing with the columns ``names``.  ``market`` has listing_id, price and price_date (at most one row per listing)."""
    stages = _stages(names, reference)
    concepts = sorted({n[2:] for n in stages[0]})
    df = fact_arrays(facts.filter(F.col("concept").isin(*concepts)) if concepts else facts)
    if market is None:
        df = df.select("*", F.lit(None).cast("double").alias("price"), F.lit(None).cast("date").alias("price_date"))
    else:
        df = df.join(market.select("listing_id", "price", "price_date"), "listing_id", "left")
    for i, stage in enumerate(stages):
        kept = [c for c in df.columns if i or c not in ("q", "y", "l")]
        df = df.select(*kept, *(c.alias(n) for n, c in stage.items()))
        if "shares" in stage:
            df = df.select("*", F.col("shares.v").alias("shares_v"), F.col("shares.d").alias("shares_d"))
    return df


def compute_metrics(facts: DataFrame, reference: Column, market: DataFrame | None = None, ids: list[str] | None = None) -> DataFrame:
    """Long table of metrics: listing_id, metric_id, unit_kind, value, as_of; metrics that can't be computed give no row.

    ``facts`` has listing_id, concept, fiscal_period, end_date, value, filed, in one currency per listing (see ``fx.convert``).
    Only the concepts, windows and composites that the chosen metrics ask for are read and computed."""
    import factloom.metrics.catalogue  # noqa: F401  (fills the registry)

    chosen = ids or metric_ids()
    if unknown := [i for i in chosen if i not in _REGISTRY]:
        raise KeyError(f"unknown metrics: {unknown}")
    _asked.clear()
    values = [F.struct(F.lit(i).alias("metric_id"), F.lit(_REGISTRY[i][0]).alias("unit_kind"), _REGISTRY[i][1](reference).alias("x")) for i in chosen]
    asked = set(_asked)
    for i in chosen:
        # Metrics of users may name columns by themselves.
        asked |= {n for c in CONCEPTS for n in (f"{k}_{c}" for k in "qyltas") if n in str(_REGISTRY[i][1](reference))} if i not in _BUILT_IN else set()
    wide = wide_rows(facts, market, reference, asked)
    long = wide.select("listing_id", F.explode(F.array(*values)).alias("m")).select("listing_id", "m.metric_id", "m.unit_kind", F.col("m.x.v").alias("value"), F.col("m.x.d").alias("as_of"))
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def explain_metric(facts: DataFrame, reference: Column, listing_id: int, metric_id: str, market: DataFrame | None = None) -> DataFrame:
    """Why a listing has the value it has: the metric itself and the newest facts of every concept it asks for.

    ``part`` is "metric" or "input", ``name`` the metric or concept; a metric without a value, or a concept without facts, has a row
    with NULLs.  Nothing but the facts of the listing is read."""
    import factloom.metrics.catalogue  # noqa: F401

    own = facts.filter(F.col("listing_id") == listing_id)
    _asked.clear()
    _REGISTRY[metric_id][1](reference)
    stages = _stages(set(_asked), reference)
    concepts = sorted({n[2:] for n in stages[0]})
    spark = facts.sparkSession
    names = spark.createDataFrame([("metric", metric_id)] + [("input", c) for c in concepts], "part string, name string")
    value = compute_metrics(own, reference, market, [metric_id]).select(F.lit("metric").alias("part"), F.col("metric_id").alias("name"), "value", F.col("as_of").alias("end_date"), F.lit(None).cast("string").alias("fiscal_period"))
    newest = own.filter(F.col("concept").isin(*concepts)).groupBy("concept").agg(F.max(F.struct("end_date", "value", "fiscal_period")).alias("r"))
    inputs = newest.select(F.lit("input").alias("part"), F.col("concept").alias("name"), "r.value", "r.end_date", "r.fiscal_period")
    return names.join(value.unionByName(inputs), ["part", "name"], "left")
