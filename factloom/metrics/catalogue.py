"""The metrics.  Each is an expression over the wide row of ``registry``; guards are part of it, and a missing input gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from factloom.metrics import series as M
from factloom.metrics.registry import _BUILT_IN, _REGISTRY, CE, DACF, EBIT, EPS, LTD, NI, NIC, OCF, REV, SE, SHARES, STD, A, L, Q, S, T, Y, col, metric, register, shared
from factloom.operators.facts import MAX_AGE, MAX_AGE_FY

C = col
positive = lambda a, b: b > 0
both_positive = lambda a, b: (a > 0) & (b > 0)


def bare(x: Column) -> Column:
    return M.let(x, lambda p: M.val(p["v"], p["d"]))


def newer_fresh(x: Column, ref: Column) -> Column:
    """Only the newer leg is tested for age: the date of the pair."""
    return M.fresh(x, ref)


def scaled(x: Column, k: Column) -> Column:
    return M.let(x, lambda p: M.val(p["v"] * k, p["d"]))


# Balance sheet


@metric("working_capital", "monetary")
def _(ref):
    return newer_fresh(M.both(L("AssetsCurrent"), L("LiabilitiesCurrent"), lambda a, b: a - b), ref)


@metric("current_ratio", "ratio")
def _(ref):
    return newer_fresh(M.ratio(L("AssetsCurrent"), L("LiabilitiesCurrent")), ref)


@metric("long_term_debt", "monetary")
def _(ref):
    return M.fresh(bare(L(LTD)), ref)


def _ncav_(ref):
    return newer_fresh(M.both(L("AssetsCurrent"), L("Liabilities"), lambda a, b: a - b), ref)


_ncav = shared("x_ncav", _ncav_)


register("ncav", "monetary", _ncav)
register("price_to_ncav", "multiple", lambda ref: M.ratio(C("mcap"), _ncav(ref), positive))


@metric("short_term_debt_share", "percent")
def _(ref):
    std = M.fresh(bare(L(STD)), ref)
    ltd = M.fresh(bare(L(LTD)), ref)
    whole = F.coalesce(M.both(std, ltd, lambda a, b: a + b), M.fresh(bare(L("TotalDebtFromBalanceSheet")), ref))
    return M.ratio(std, whole, lambda a, b: (b > 0) & (a / b).between(0, 1))


@metric("debt_paydown_years", "multiple")
def _(ref):
    return M.ratio(C("debt_both"), C("fcf_t"), both_positive)


@metric("fcf_to_debt", "ratio")
def _(ref):
    return M.ratio(C("fcf_t"), C("debt_both"), both_positive)


# Cash and profit over twelve months


@metric("cfo_to_ni_ttm", "ratio")
def _(ref):
    return M.ratio(A(OCF), C("ni_a"), positive)


@metric("cfo_to_ni_10y_median", "ratio")
def _(ref):
    joint = M.chain(M.combined(S(OCF), C("s_ni"), f=lambda o, n: F.when(o.isNotNull() & n.isNotNull(), n)), 10, 6, ref)
    return M.summary(joint, lambda j: M.let(M.combined(j, S(OCF), f=lambda n, o: F.when(n > 0, o / n)), lambda r: F.when(F.size(r) >= F.ceil(0.6 * F.size(j)), M.median_of(r))))


@metric("fcf_fy_median_5y", "monetary")
def _(ref):
    rows = M.newest_n(C("s_fcf"), 5, ref)
    return M.summary(rows, M.median_of)


def _count(ref, series, n, holds):
    rows = M.strict(series, n, ref)
    return M.summary(rows, lambda r: M.count_of(r, holds).cast("double"))


register("fcf_neg_years_10y", "count", lambda ref: _count(ref, C("s_fcf"), 10, lambda v: v < 0))
register("ni_loss_years_10y", "count", lambda ref: _count(ref, C("s_ni"), 10, lambda v: v < 0))


@metric("ni_loss_year_share", "percent")
def _(ref):
    rows = M.chain(C("s_ni"), 10, 6, ref)
    return M.summary(rows, lambda r: M.count_of(r, lambda v: v <= 0) / F.size(r))


def _average(q: Column, y: Column, ref: Column) -> Column:
    return M.year_pair(q, y, ref, lambda a, b: (a + b) / 2)


def avg_assets_(ref):
    return _average(Q("Assets"), Y("Assets"), ref)


avg_assets = shared("x_avg_assets", avg_assets_)


@metric("accruals_ratio", "ratio")
def _(ref):
    return M.ratio(M.both(C("ni_t"), bare(T(OCF)), lambda n, o: n - o), avg_assets(ref), positive)


@metric("altman_z", "other")
def _(ref):
    ta, tl = M.fresh(bare(L("Assets")), ref), C("liabilities")
    over = lambda x, k: scaled(M.ratio(x, ta, positive), F.lit(k))
    wc = M.both(M.fresh(bare(L("AssetsCurrent")), ref), M.fresh(bare(L("LiabilitiesCurrent")), ref), lambda a, b: a - b)
    # The price's date is no date of the score.
    cap = M.val(0.6 * C("mcap")["v"] / tl["v"], tl["d"], tl["v"] > 0)
    parts = [over(wc, 1.2), over(M.fresh(bare(L("RetainedEarnings")), ref), 1.4), over(bare(A(EBIT)), 3.3), cap, over(bare(A(REV)), 1.0)]
    out = parts[0]
    for p in parts[1:]:
        out = M.both(out, p, lambda a, b: a + b)
    return out


@metric("piotroski_f_score", "count")
def _(ref):
    """Nine signs of the newest year of net income against the year before; without all inputs there is no score."""
    ni, a, rev = S(NI), S("Assets"), S(REV)
    top = F.get(ni, F.lit(0))
    g = lambda s, k: M.in_year(s, top["y"] - k)
    ca, cl, shares, ocf, ltd = S("AssetsCurrent"), S("LiabilitiesCurrent"), S(SHARES), S(OCF), S(LTD)
    gross, cost = S("GrossProfit"), S("CostOfRevenue")
    debt = lambda k: F.coalesce(g(ltd, k), F.lit(0.0))
    # One basis for both years: reported gross profit, else revenue less cost.
    reported = g(gross, 0).isNotNull() & g(gross, 1).isNotNull()
    margin = lambda k: F.when(reported, g(gross, k)).otherwise(g(rev, k) - g(cost, k)) / g(rev, k)
    roa = lambda k: g(ni, k) / g(a, k + 1)
    leverage = lambda k: debt(k) / ((g(a, k) + g(a, k + 1)) / 2)
    signs = [
        roa(0) > 0, g(ocf, 0) > 0, roa(0) > roa(1), g(ocf, 0) > g(ni, 0), (leverage(0) < leverage(1)) | ((debt(0) == 0) & (debt(1) == 0)),
        g(ca, 0) / g(cl, 0) > g(ca, 1) / g(cl, 1), g(shares, 0) <= g(shares, 1), margin(0) > margin(1), g(rev, 0) / g(a, 1) > g(rev, 1) / g(a, 2),
    ]
    above = [g(a, 0), g(a, 1), g(a, 2), g(cl, 0), g(cl, 1), g(rev, 0), g(rev, 1), g(shares, 0), g(shares, 1)]
    ok = F.forall(F.array(*above), lambda x: F.coalesce(x > 0, F.lit(False))) & (top["d"] >= F.date_sub(ref, MAX_AGE_FY))
    # A missing input makes its sign NULL and so the sum.  Ratios are asked only where their denominators are above 0.
    return F.when(ok, M.val(sum((s.cast("int") for s in signs), F.lit(0)).cast("double"), top["d"]))


# Earnings per share


@metric("eps_streak", "count")
def _(ref):
    broken = F.array_position(F.transform(Y(EPS), lambda x: x["v"] > 0), F.lit(False))
    return M.val(F.when(F.size(Y(EPS)) > 0, F.when(broken > 0, broken - 1).otherwise(F.size(Y(EPS)))).cast("double"), F.get(Y(EPS), F.lit(0))["d"])


register("eps_ttm", "per_share", lambda ref: C("eps_t"))


@metric("eps_6y_avg", "per_share")
def _(ref):
    rows = M.newest_n(Y(EPS), 6, ref)
    return M.summary(rows, M.mean_of)


def _ends_cagr(rows: Column, n: Column) -> Column:
    """Growth between the means of the first and last three of n rows; both above 0."""
    new, old = M.mean_of(F.slice(rows, 1, 3)), M.mean_of(F.slice(rows, F.greatest(n - 2, F.lit(1)), F.lit(3)))
    return F.when((new > 0) & (old > 0), F.pow(new / old, 1.0 / (n - 3)) - 1)


def _graham_(ref):
    rows = M.newest_n(Y(EPS), 10, ref)
    ends = lambda r: F.concat(F.slice(r, 1, 3), F.slice(r, 8, 3))
    return M.summary(rows, lambda r: F.when(F.forall(ends(r), lambda x: x["v"] > 0), _ends_cagr(r, F.lit(10))))


_graham = shared("x_graham", _graham_)


register("graham_eps_10y_cagr_3y_avg", "percent", _graham)


def share_count_(ref):
    return M.val(C("shares_v"), C("shares_d"), (C("shares_v") > 0) & (C("shares_d") >= F.date_sub(ref, MAX_AGE)))


share_count = shared("x_shares", share_count_)


@metric("graham_multiplier", "multiple")
def _(ref):
    book = M.val(L(SE)["v"] - F.coalesce(C("goodwill")["v"], F.lit(0.0)) - F.coalesce(C("intangibles")["v"], F.lit(0.0)), L(SE)["d"], L(SE)["d"] >= F.date_sub(ref, MAX_AGE))
    per_share = M.ratio(book, share_count(ref), both_positive)
    return M.both(M.ratio(C("px"), C("eps_t"), positive), M.ratio(C("px"), per_share, positive), lambda a, b: a * b)


def _earnings_yield_(ref):
    return M.ratio(C("eps_t"), C("px"), positive)


_earnings_yield = shared("x_earnings_yield", _earnings_yield_)


register("earnings_yield", "percent", _earnings_yield)


def _peg(ref, adjust):
    growth = _graham(ref)
    if adjust:
        growth = M.val(growth["v"] + F.coalesce(_dividend_yield(ref)["v"], F.lit(0.0)), growth["d"])
    return M.both(_earnings_yield(ref), growth, lambda e, g: 1 / e / (100 * g), both_positive)


register("peg_ratio", "ratio", lambda ref: _peg(ref, False))
register("peg_ratio_div_adj", "ratio", lambda ref: _peg(ref, True))


@metric("interest_coverage", "ratio")
def _(ref):
    w = T(EBIT)
    derived = "InterestExpenseFromNetInterestIncome"
    source = lambda c: F.when(w["cadence"] == "annual", Y(c)).otherwise(Q(c))
    values = F.transform(w["rows"], lambda r: F.coalesce(M.at(source("InterestExpense"), r["d"]), M.at(source(derived), r["d"])))
    aligned = M.let(M.sum_if_whole(values), lambda i: M.val(w["v"] / F.when(i > 0, i), w["d"]))
    yearly = M.combined(S(EBIT), S("InterestExpense"), f=lambda e, i: F.when(i > 0, e / i))
    fy = M.fresh(bare(F.get(yearly, F.lit(0))), ref, MAX_AGE_FY)
    evidence = F.coalesce(C("debt_evidence")["v"], C("liabilities")["v"])
    capped = F.when((w["v"] > 0) & (evidence <= w["v"]), M.val(F.lit(100.0), w["d"]))
    return F.coalesce(aligned, capped, fy)


# Market value


register("market_cap", "monetary", lambda ref: C("mcap"))


def _per_book(ref, tangible):
    take = (F.coalesce(C("goodwill")["v"], F.lit(0.0)) + F.coalesce(C("intangibles")["v"], F.lit(0.0))) if tangible else F.lit(0.0)
    book = M.val(C("equity_common")["v"] - take, C("equity_common")["d"])
    return M.ratio(C("px"), M.ratio(book, share_count(ref), both_positive), positive)


register("price_to_book", "multiple", lambda ref: _per_book(ref, False))
register("price_to_tangible_book", "multiple", lambda ref: _per_book(ref, True))


@metric("price_to_fcf", "multiple")
def _(ref):
    # The four newest quarters with no test of gaps, unlike every window of a year.
    rows = F.slice(Q(OCF), 1, 4)
    fcf = F.when(F.size(rows) == 4, M.total(rows) - F.aggregate(rows, F.lit(0.0), lambda s, r: s + F.coalesce(M.at(Q("CapitalExpenditures"), r["d"]), F.lit(0.0))))
    d = F.get(rows, F.lit(0))["d"]
    return M.ratio(C("mcap"), M.val(fcf, d, d >= F.date_sub(ref, MAX_AGE)), positive)


def _ev(debt: str, cash: str) -> Column:
    ev = C("mcap")["v"] + C(debt)["v"] - C(cash)["v"]
    return M.val(ev, C("mcap")["d"], ev > 0)


ev_fresh = shared("x_ev", lambda ref: _ev("debt_any", "cash_any"))
ev_wide = shared("x_ev_fy", lambda ref: _ev("debt_any_fy", "cash_any_fy"))


def enterprise_value(wide_if_annual: Column | None = None):
    return ev_fresh() if wide_if_annual is None else F.when(wide_if_annual, ev_wide()).otherwise(ev_fresh())


@metric("net_debt_to_ebitda", "multiple")
def _(ref):
    debt = F.when(C("ebitda_annual"), C("debt_any_fy")).otherwise(C("debt_any"))
    cash = F.when(C("ebitda_annual"), C("cash_any_fy")).otherwise(C("cash_any"))
    return M.ratio(M.both(debt, cash, lambda a, b: a - b), bare(C("ebitda")), positive)


def annual(w: Column) -> Column:
    return F.coalesce(w["cadence"] == "annual", F.lit(False))


register("ebit_yield_ev", "percent", lambda ref: M.ratio(bare(A(EBIT)), enterprise_value(), positive))
register("fcf_yield_ev", "percent", lambda ref: M.ratio(C("fcf_a"), enterprise_value(), positive))
register("ev_to_ebit", "multiple", lambda ref: M.ratio(enterprise_value(annual(A(EBIT))), bare(A(EBIT)), positive))
register("ev_to_ebitda", "multiple", lambda ref: M.ratio(enterprise_value(C("ebitda_annual")), bare(C("ebitda")), positive))
register("ev_to_sales", "multiple", lambda ref: M.ratio(enterprise_value(annual(A(REV))), bare(A(REV)), positive))
register("fcf_to_ebitda", "ratio", lambda ref: M.ratio(C("fcf_a"), bare(C("ebitda")), positive))
register("sbc_to_revenue", "percent", lambda ref: M.ratio(bare(T("StockBasedCompensation")), bare(T(REV)), positive))
register("sbc_to_fcf", "percent", lambda ref: M.ratio(bare(T("StockBasedCompensation")), C("fcf_t"), positive))


# Invested capital


def _newest(arr: Column, ref: Column, days: int) -> Column:
    return M.fresh(bare(F.get(arr, F.lit(0))), ref, days)


def avg_ic_(ref):
    return _average(C("ic_q"), C("ic_y"), ref)


avg_ic = shared("x_avg_ic", avg_ic_)


register("ic_mqr", "monetary", lambda ref: _newest(C("ic_q"), ref, MAX_AGE))
register("ic_fy", "monetary", lambda ref: _newest(C("ic_y"), ref, MAX_AGE_FY))
register("avg_ic", "monetary", avg_ic)
register("roic_ttm", "percent", lambda ref: M.ratio(scaled(bare(A(EBIT)), 1 - C("tax_rate_annual")), avg_ic(ref), both_positive))
register("roce", "percent", lambda ref: M.ratio(bare(A(EBIT)), _average(C("capital_q"), C("capital_y"), ref), positive))
register("croic", "percent", lambda ref: M.ratio(C("fcf_a"), avg_ic(ref), positive))


def newest_tax():
    return F.coalesce(F.get(C("s_tax"), F.lit(0))["v"], F.lit(0.21))


def nopat_():
    return M.combined(S(EBIT), C("s_tax"), f=lambda e, t: e * (1 - F.coalesce(t, newest_tax())))


nopat = shared("x_nopat", lambda ref: nopat_())


ic_years = shared("x_ic_years", lambda ref: M.yearly(C("ic_y")))


def roic_series_():
    def means(ic: Column) -> Column:
        oldest = F.element_at(ic, -1)["y"]
        mean = lambda x: F.when(x["y"] == oldest, x["v"]).otherwise((x["v"] + M.in_year(ic, x["y"] - 1)) / 2)
        return F.when(F.size(ic) > 0, F.transform(ic, lambda x: F.struct(x["y"].alias("y"), x["d"].alias("d"), mean(x).alias("v"))))

    return M.combined(nopat(), M.let(ic_years(), means), f=lambda n, b: F.when(b > 0, n / b))


roic_series = shared("x_roic", lambda ref: roic_series_())


def _strict(n, summary, series=roic_series):
    def build(ref):
        rows = M.strict(series(), n, ref)
        return M.summary(rows, summary)

    return build


register("roic_10y_median", "percent", _strict(10, M.median_of))
register("roic_7y_median", "percent", _strict(7, M.median_of))
register("roic_years_above_12pct", "count", _strict(10, lambda r: M.count_of(r, lambda v: v > 0.12).cast("double")))
register("roic_10y_min", "percent", _strict(10, M.least_of))
register("roic_7y_min", "percent", _strict(7, M.least_of))


@metric("roic_10y_median_adaptive", "percent")
def _(ref):
    rows = M.chain(roic_series(), 10, 6, ref)
    return M.summary(rows, M.median_of)


@metric("iroic_5y", "percent")
def _(ref):
    ic = ic_years()
    rows = M.combined(nopat(), ic, f=lambda a, b: F.when(b.isNotNull() & a.isNotNull(), a))

    def growth(p: Column) -> Column:
        top = F.get(F.filter(p, lambda x: M.in_year(p, x["y"] - 5).isNotNull()), F.lit(0))
        parts = M.let(top, lambda t: F.struct(t["d"].alias("d"), (t["v"] - M.in_year(p, t["y"] - 5)).alias("dn"), (M.in_year(ic, t["y"]) - M.in_year(ic, t["y"] - 5)).alias("di"), M.in_year(ic, t["y"] - 5).alias("then")))
        small = lambda q: (q["di"] <= 0) | (F.abs(q["di"]) / F.greatest(F.abs(q["then"]), F.lit(1.0)) < 0.01)
        return M.let(parts, lambda q: M.val(F.when(small(q), F.when(q["dn"] > 0, 1.0)).otherwise(F.try_divide(q["dn"], q["di"])), q["d"], q["d"] >= F.date_sub(ref, MAX_AGE_FY)))

    return M.let(rows, growth)


# Margins


def gross_margins_():
    return M.combined(S(REV), S("GrossProfit"), S("CostOfRevenue"), f=lambda r, g, c: F.when(r > 0, F.coalesce(g, r - c) / r))


gross_margins = shared("x_gross_margins", lambda ref: gross_margins_())


def operating_margins_():
    return M.combined(S(REV), S(EBIT), f=lambda r, e: F.when(r > 0, e / r))


operating_margins = shared("x_operating_margins", lambda ref: operating_margins_())


register("gm_10y_std", "percent", _strict(10, M.spread_of, gross_margins))
register("opm_10y_std", "percent", _strict(10, M.spread_of, operating_margins))
register("opm_10y_min", "percent", _strict(10, M.least_of, operating_margins))
register("opm_7y_min", "percent", _strict(7, M.least_of, operating_margins))


@metric("gross_margin_ttm", "percent")
def _(ref):
    x = M.ratio(C("gross_profit"), bare(A(REV)), positive)
    return M.val(F.when(x["v"].isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x["v"]))), x["d"])


register("operating_margin_ttm", "percent", lambda ref: M.ratio(bare(T(EBIT)), bare(T(REV)), positive))
register("fcf_margin_ttm", "percent", lambda ref: M.ratio(C("fcf_t"), bare(T(REV)), positive))
register("roe_ttm", "percent", lambda ref: M.ratio(C("nic_t"), _average(Q(CE), Y(CE), ref), positive))
register("roa_ttm", "percent", lambda ref: M.ratio(C("ni_t"), avg_assets(ref), positive))
register("roetce_ttm", "percent", lambda ref: M.ratio(C("nic_t"), _average(C("tangible_q"), C("tangible_y"), ref), positive))
register("gross_profit_to_assets_ttm", "percent", lambda ref: M.ratio(C("gross_profit"), avg_assets(ref), positive))


# Shares and payouts


def _growth(years, root):
    def build(ref):
        change = lambda a, b: F.when((a > 0) & (b > 0), F.pow(a / b, F.lit(1.0 / years)) - 1 if root else a / b - 1)
        return M.year_pair(Q(SHARES), Y(SHARES), ref, change, years)

    return build


register("share_count_cagr_5y", "percent", _growth(5, True))
register("share_count_cagr_10y", "percent", _growth(10, True))
register("shares_10y_pct_change", "percent", _growth(10, False))


def _buyback_yield_(ref):
    by = lambda x: M.both(bare(x), C("mcap"), lambda a, m: -a / m, positive)
    change = _growth(1, False)(ref)
    return F.coalesce(by(A("SalePurchaseOfStock")), by(A("IssuanceOfCapitalStock")), scaled(change, F.lit(-1.0)))


_buyback_yield = shared("x_buyback", _buyback_yield_)


register("net_buyback_yield", "percent", _buyback_yield)


def _dividends_():
    w = A("CommonStockDividendsPaid")
    return M.val(F.aggregate(w["rows"], F.lit(0.0), lambda s, x: s + F.abs(x["v"])), w["d"])


_dividends = shared("x_dividends", lambda ref: _dividends_())


def _no_dividend_(ref):
    """Evidence of none: no fresh dividend row other than 0, while cash flows are reported."""
    rows = F.concat(Q("CommonStockDividendsPaid"), Y("CommonStockDividendsPaid"))
    paid = F.exists(rows, lambda x: (x["v"] != 0) & (x["d"] >= F.date_sub(ref, MAX_AGE_FY)))
    return M.val(F.lit(0.0), A(OCF)["d"], ~paid & A(OCF).isNotNull())


_no_dividend = shared("x_no_dividend", _no_dividend_)


def _dividend_yield_(ref):
    dps = M.fresh(bare(L("CommonStockDividendsPerShareCashPaid")), ref)
    dps = M.let(dps, lambda p: M.val(F.abs(p["v"]), p["d"]))
    # Evidence of no dividend counts only where none is recorded.
    return F.coalesce(M.ratio(_dividends(), C("mcap"), positive), M.ratio(dps, C("px"), positive), F.when(A("CommonStockDividendsPaid").isNull() & dps.isNull(), _no_dividend(ref)))


_dividend_yield = shared("x_dividend_yield", _dividend_yield_)


register("dividend_yield_ttm", "percent", _dividend_yield)
register("shareholder_yield_ttm", "percent", lambda ref: M.both(_dividend_yield(ref), _buyback_yield(ref), lambda a, b: a + b))


@metric("dividend_payout_ratio_ttm", "percent")
def _(ref):
    w = A("CommonStockDividendsPaid")
    pinned = M.val(M.at(Y(NI), w["d"]), w["d"])
    income = F.when(annual(w), pinned).otherwise(C("ni_t"))
    return F.coalesce(M.ratio(_dividends(), income, positive), F.when(C("ni_a")["v"] > 0, _no_dividend(ref)))


def _cagr(series, years):
    def build(ref):
        rows = series()
        top = F.get(rows, F.lit(0))
        old = M.in_year(rows, top["y"] - years)
        return M.val(F.when((top["v"] > 0) & (old > 0), F.pow(top["v"] / old, F.lit(1.0 / years)) - 1), top["d"], top["d"] >= F.date_sub(ref, MAX_AGE_FY))

    return build


register("revenue_cagr_10y", "percent", _cagr(lambda: S(REV), 10))
register("fcf_per_share_cagr_10y", "percent", _cagr(lambda: M.combined(C("s_fcf"), S(SHARES), f=lambda f, s: F.when(s > 0, f / s)), 10))


# Maintenance capital, working capital, owner earnings

DA, CAPEX = "DepreciationDepletionAndAmortization", "CapitalExpenditures"


def least_spend(capex: Column, da: Column) -> Column:
    """The lesser of capital expenditure and 1.1 times depreciation, or the one there is."""
    return F.coalesce(F.when(capex.isNotNull() & da.isNotNull(), F.least(F.abs(capex), 1.1 * F.abs(da))), F.abs(capex), 1.1 * F.abs(da))


def da_rows_():
    """Depreciation of fiscal years by end date; that of cash flows fills holes."""
    return M.either(Y(DA), Y(DACF), "d")


da_rows = shared("x_da_rows", lambda ref: da_rows_())


def mcapex_series_():
    """Structs (d, v) of all end dates with a spend or a depreciation."""

    def rows(p: Column) -> Column:
        dates = F.sort_array(F.array_union(F.transform(p["c"], lambda x: x["d"]), F.transform(p["a"], lambda x: x["d"])), False)
        return F.transform(dates, lambda d: F.struct(d.alias("d"), least_spend(M.at(p["c"], d), M.at(p["a"], d)).alias("v")))

    return M.let(F.struct(Y(CAPEX).alias("c"), da_rows().alias("a")), rows)


mcapex_series = shared("x_spend", lambda ref: mcapex_series_())


def spent(w: Column) -> Column:
    """Sum of the amounts of a window, whatever their signs."""
    return M.let(w, lambda p: M.val(F.aggregate(p["rows"], F.lit(0.0), lambda s, x: s + F.abs(x["v"])), p["d"]))


def mcapex_ttm_():
    both = F.struct(spent(T(CAPEX)).alias("c"), C("da_t").alias("a"))
    return M.let(both, lambda p: M.val(least_spend(p["c"]["v"], p["a"]["v"]), F.greatest(p["c"]["d"], p["a"]["d"])))


mcapex_ttm = shared("x_spend_ttm", lambda ref: mcapex_ttm_())


@metric("mcapex_fy", "monetary")
def _(ref):
    rows = M.newest_n(mcapex_series(), 1, ref)
    return M.summary(rows, M.mean_of)


@metric("mcapex_5y", "monetary")
def _(ref):
    rows = M.newest_n(mcapex_series(), 5, ref)
    return M.summary(rows, M.mean_of)


register("mcapex_ttm", "monetary", lambda ref: mcapex_ttm())
register("nwc_mqr", "monetary", lambda ref: _newest(C("nwc_q"), ref, MAX_AGE))
register("nwc_fy", "monetary", lambda ref: _newest(C("nwc_y"), ref, MAX_AGE_FY))
_NONE = lambda: F.array().cast("array<struct<d:date,v:double,p:string>>")
register("delta_nwc_ttm", "monetary", lambda ref: M.year_pair(C("nwc_q"), _NONE(), ref, lambda a, b: a - b))
register("delta_nwc_fy", "monetary", lambda ref: M.year_pair(_NONE(), C("nwc_y"), ref, lambda a, b: a - b))


def maintenance_():
    """By year: a third of the working capital gained in three unbroken years, at least 0."""

    def three(nwc: Column) -> Column:
        def of(x: Column) -> Column:
            before = [M.in_year(nwc, x["y"] - k) for k in (1, 2, 3)]
            whole = before[0].isNotNull() & before[1].isNotNull() & before[2].isNotNull()
            return F.when(whole, F.greatest((x["v"] - before[2]) / 3, F.lit(0.0)))

        return F.filter(F.transform(nwc, lambda x: F.struct(x["y"].alias("y"), x["d"].alias("d"), of(x).alias("v"))), lambda x: x["v"].isNotNull())

    return M.let(M.yearly(C("nwc_y")), three)


maintenance = shared("x_maintenance", lambda ref: maintenance_())


def newest_maintenance_(ref):
    """That of the newest year of working capital; none where its chain is broken."""
    newest = _newest(C("nwc_y"), ref, MAX_AGE_FY)
    return M.let(F.struct(newest.alias("n"), maintenance().alias("m")), lambda p: M.val(M.in_year(p["m"], F.year(p["n"]["d"])), p["n"]["d"]))


newest_maintenance = shared("x_newest_maintenance", newest_maintenance_)


register("delta_nwc_maint", "monetary", newest_maintenance)


def _owner_ttm(base, ref):
    parts = F.struct(base.alias("b"), C("da_t").alias("a"), mcapex_ttm().alias("m"), newest_maintenance(ref).alias("n"))
    return M.let(parts, lambda p: M.val(p["b"]["v"] + F.coalesce(p["a"]["v"], F.lit(0.0)) - p["m"]["v"] - p["n"]["v"], F.greatest(p["b"]["d"], p["a"]["d"], p["m"]["d"], p["n"]["d"])))


def owner_points(base):
    """Structs (y, d, v) by end date: the base plus depreciation less the spend of the date and the maintenance of its year."""

    def rows(p: Column) -> Column:
        value = lambda x: x["v"] + F.coalesce(M.at(p["a"], x["d"]), F.lit(0.0)) - M.at(p["m"], x["d"]) - M.in_year(p["n"], F.year(x["d"]))
        made = F.transform(p["b"], lambda x: F.struct(F.year(x["d"]).alias("y"), x["d"].alias("d"), value(x).alias("v")))
        return F.filter(made, lambda x: x["v"].isNotNull())

    return M.let(F.struct(base.alias("b"), da_rows().alias("a"), mcapex_series().alias("m"), maintenance().alias("n")), rows)


def nopat_points():
    """Operating income after tax by end date: the tax of the date, else the newest valid one, else 21 percent."""

    def rows(p: Column) -> Column:
        rate = lambda d: M.let(F.struct(M.at(p["t"], d).alias("t"), M.at(p["p"], d).alias("p")), lambda r: F.when((r["p"] > 1.0) & (r["t"] / r["p"]).between(0.0, 1.0), r["t"] / r["p"]))
        valid = F.filter(F.transform(p["t"], lambda x: rate(x["d"])), lambda r: r.isNotNull())
        return F.transform(p["e"], lambda x: F.struct(x["d"].alias("d"), (x["v"] * (1 - F.coalesce(rate(x["d"]), F.get(valid, F.lit(0)), F.lit(0.21)))).alias("v")))

    return M.let(F.struct(Y(EBIT).alias("e"), Y("IncomeTaxExpense").alias("t"), Y("IncomeBeforeIncomeTaxes").alias("p")), rows)


def newest_of_years(points):
    """Of several points of a calendar year the newest."""
    return M.let(points, lambda p: F.filter(p, lambda x, i: F.coalesce(F.year(F.when(i > 0, F.get(p, i - 1))["d"]) != x["y"], F.lit(True))))


def equity_ttm_(ref):
    return _owner_ttm(C("nic_t"), ref)


equity_ttm = shared("x_equity_ttm", equity_ttm_)


def enterprise_ttm_(ref):
    return _owner_ttm(scaled(bare(T(EBIT)), 1 - C("tax_rate")), ref)


enterprise_ttm = shared("x_enterprise_ttm", enterprise_ttm_)


def _five(series, summary):
    def build(ref):
        rows = M.newest_n(series(), 5, ref)
        return M.summary(rows, summary)

    return build


equity_series = shared("x_equity_points", lambda ref: owner_points(M.either(Y(NIC), Y(NI), "d")))
enterprise_series = shared("x_enterprise_points", lambda ref: owner_points(nopat_points()))
equity_5y, enterprise_5y, enterprise_median = shared("x_equity_5y", _five(equity_series, M.mean_of)), shared("x_enterprise_5y", _five(enterprise_series, M.mean_of)), shared("x_enterprise_median", _five(enterprise_series, M.median_of))
register("oe_equity_ttm", "monetary", equity_ttm)
register("oe_equity_5y_avg", "monetary", equity_5y)
register("oey_equity", "percent", lambda ref: M.ratio(equity_ttm(ref), C("mcap"), positive))
register("oey_equity_5y", "percent", lambda ref: M.ratio(equity_5y(ref), C("mcap"), positive))
register("oey_ev", "percent", lambda ref: M.ratio(enterprise_ttm(ref), enterprise_value(), positive))
register("oey_ev_norm", "percent", lambda ref: M.ratio(enterprise_median(ref), enterprise_value(), positive))
register("oe_ev_ttm", "monetary", enterprise_ttm)
register("oe_ev_5y_avg", "monetary", enterprise_5y)
register("oe_ev_fy_median_5y", "monetary", enterprise_median)
register("worst_oe_ev_fy_10y", "monetary", _strict(10, M.least_of, lambda: newest_of_years(enterprise_series())))


@metric("owner_earnings_cagr_10y", "percent")
def _(ref):
    rows = M.chain(newest_of_years(enterprise_series()), 10, 7, ref)
    return M.summary(rows, lambda r: _ends_cagr(r, F.size(r)))


@metric("roc_greenblatt_5y_avg", "percent")
def _(ref):
    parts = F.struct(Y(EBIT).alias("e"), Y("PropertyPlantAndEquipmentNet").alias("p"), Y("AssetsCurrent").alias("a"), Y("LiabilitiesCurrent").alias("l"))

    def ratios(p: Column) -> Column:
        capital = lambda d: M.at(p["p"], d) + M.at(p["a"], d) - M.at(p["l"], d)
        return F.filter(F.transform(p["e"], lambda x: F.struct(x["d"].alias("d"), M.let(capital(x["d"]), lambda c: F.when(c > 0, x["v"] / c)).alias("v"))), lambda x: x["v"].isNotNull())

    recent = lambda c: L(c)["d"] >= F.date_sub(ref, MAX_AGE_FY)
    rows = F.slice(M.let(parts, ratios), 1, 5)
    return M.val(M.mean_of(rows), F.get(Y(EBIT), F.lit(0))["d"], recent(EBIT) & recent("AssetsCurrent") & recent("LiabilitiesCurrent"))


@metric("roe_greenblatt_5y_avg", "percent")
def _(ref):
    # Of several fiscal-year rows in a calendar year, the oldest counts here.
    equity = M.shifted(M.yearly(Y(CE), newest=False), lambda a, b: F.when((a + b) != 0, (a + b) / 2))
    rows = M.newest_n(M.combined(M.yearly(Y("NetIncomeLossAvailableToCommonStockholdersBasic"), newest=False), equity, f=lambda n, e: n / e), 5, ref, exact=False)
    return M.summary(rows, M.mean_of)

_BUILT_IN.update(_REGISTRY)
