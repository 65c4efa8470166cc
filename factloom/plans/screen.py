"""Screens: an AND of criteria and K-of-N groups, compiled to one Column per group."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.operators.fx import rates_for
from factloom.operators.materialize import broadcast_if_small, materialize
from factloom.operators.ranking import RankedMetric, Ranking

_OPERATORS = {"<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "==": lambda a, b: a == b}


@dataclass(frozen=True)
class Term:
    """A constant or a metric; ``multiplier`` counts on the right side only."""

    metric: str | None = None
    value: float | None = None
    multiplier: float = 1.0
    currency: str | None = None

    def column(self) -> Column:
        return F.col(self.metric) if self.metric else F.lit(float(self.value))


@dataclass(frozen=True)
class Criterion:
    name: str
    left: Term
    operator: str
    right: Term
    #: The name of its columns in a row of ``align``; None where numbers are compared as they are.
    aligned: str | None = None

    def compared(self) -> Column:
        """True, False, or NULL where a side is missing or cannot be brought to the units of the other."""
        left, right = self.left.column(), self.right.column()
        if self.aligned:
            # The first metric is the anchor; the other side comes into its currency.
            rate = F.col(f"{self.aligned}rate")
            left, right = (left, right * rate) if self.left.metric else (left * rate, right)
        ok = left.isNotNull() & right.isNotNull() & ~F.isnan(left) & ~F.isnan(right)
        return F.when(ok, _OPERATORS[self.operator](left, right * self.right.multiplier))


@dataclass(frozen=True)
class Group:
    name: str
    members: tuple[Criterion, ...]
    at_least: int

    def passed(self) -> Column:
        return sum((F.coalesce(m.compared(), F.lit(False)).cast("int") for m in self.members), F.lit(0)) >= self.at_least

    def verdict(self) -> Column:
        """passed; else comparison_failed if a member truly compared and lost, else na_blocked."""
        lost = F.lit(False)
        for m in self.members:
            lost = lost | F.coalesce(~m.compared(), F.lit(False))
        return F.when(self.passed(), "passed").when(lost, "comparison_failed").otherwise("na_blocked")

    def missing(self) -> Column:
        """Metrics of the group without a value, each once, in the order of the screen."""
        names = [t.metric for m in self.members for t in (m.left, m.right) if t.metric]
        return F.array_distinct(F.array_compact(F.array(*(F.when(F.col(n).isNull() | F.isnan(n), n) for n in names))))

    def reported(self) -> Column:
        """The left value of the first member that passes."""
        return F.coalesce(*(F.when(F.coalesce(m.compared(), F.lit(False)), m.left.column()) for m in self.members))


@dataclass(frozen=True)
class Screen:
    groups: tuple[Group, ...]
    ranking: Ranking | None = None

    def metric_ids(self) -> list[str]:
        used = [t.metric for g in self.groups for m in g.members for t in (m.left, m.right) if t.metric]
        used += [m.metric_id for m in self.ranking.metrics] + [t for t, _ in self.ranking.tie_breakers] if self.ranking else []
        return list(dict.fromkeys(used))


def _term(data: dict) -> Term:
    if bool(data.get("metric")) == ("value" in data):
        raise ValueError(f"a term is a metric or a value: {data}")
    return Term(data.get("metric"), data.get("value"), float(data.get("multiplier", 1.0)), data.get("currency"))


def _criterion(data: dict) -> Criterion:
    if data.get("operator") not in _OPERATORS:
        raise ValueError(f"unknown operator: {data.get('operator')}")
    return Criterion(str(data.get("name") or ""), _term(data["left"]), data["operator"], _term(data["right"]))


def _fraction(x: float) -> float:
    return float(x) / 100 if float(x) > 1 else float(x)


def parse_screen(data: dict) -> Screen:
    """A screen from its parsed YAML: ``criteria`` (each a criterion, or ``any_of`` with ``at_least``) and optional ``ranking``."""
    groups = []
    for entry in data["criteria"]:
        members = tuple(map(_criterion, entry["any_of"])) if "any_of" in entry else (_criterion(entry),)
        k = int(entry.get("at_least", 1))
        if not 1 <= k <= len(members):
            raise ValueError(f"at_least must lie between 1 and {len(members)}")
        groups.append(Group(str(entry.get("name") or members[0].name), members, k))
    if len({g.name for g in groups}) < len(groups):
        raise ValueError("names of criteria must differ")
    r = data.get("ranking")
    ranking = r and Ranking(
        [RankedMetric(m.get("metric") or m["metric_id"], float(m.get("weight") or 0), m.get("direction", "higher") == "higher", m.get("cap")) for m in r.get("metrics", [])],
        [(t.get("metric") or t["metric_id"], t.get("direction", "ascending") == "ascending") for t in r.get("tie_breakers", [])],
        int(r.get("min_sector_peers") or 10), *(_fraction((r.get("winsorize") or {}).get(f"{k}_percentile", d)) for k, d in (("lower", 0.05), ("upper", 0.95))),
    )
    return Screen(tuple(groups), ranking or None)


def load_screen(path: str) -> Screen:
    """A screen from a YAML file."""
    import yaml

    with open(path) as f:
        return parse_screen(yaml.safe_load(f))


def screen_input(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """Long metrics (listing_id, metric_id, value, as_of) to a row per listing: the newest value of each metric; one shuffle of partial maxima."""
    rows = metrics.filter(F.col("metric_id").isin(*ids)).groupBy("listing_id", "metric_id").agg(F.max_by("value", F.struct("as_of", "value")).alias("value"))
    return rows.groupBy("listing_id").pivot("metric_id", ids).agg(F.first("value"))


def run_screen(wide: DataFrame, screen: Screen) -> DataFrame:
    """The listings that pass every group, with the reported value of each group (``g0``, ``g1``, ...)."""
    passed = F.lit(True)
    for g in screen.groups:
        passed = passed & g.passed()
    return wide.filter(passed).select("*", *(g.reported().alias(f"g{i}") for i, g in enumerate(screen.groups)))


def screen_details(wide: DataFrame, screen: Screen) -> DataFrame:
    """A row per listing and group: verdict and missing metrics."""
    details = F.array(*(F.struct(F.lit(g.name).alias("criterion"), g.verdict().alias("verdict"), g.missing().alias("missing")) for g in screen.groups))
    return wide.select("listing_id", F.explode(details).alias("d")).select("listing_id", "d.*")


def fallout(wide: DataFrame, screen: Screen) -> DataFrame:
    """How many listings each group stops, and how many of those for want of data."""
    return screen_details(wide, screen).groupBy("criterion").agg(
        F.count_if(F.col("verdict") != "passed").alias("failed"), F.count_if(F.col("verdict") == "na_blocked").alias("na_blocked"), F.count_if(F.col("verdict") == "comparison_failed").alias("compared_and_lost")
    )


_MONEY = ("monetary", "per_share")


def aligned_input(metrics: DataFrame, ids: list[str]) -> DataFrame:
    """A row per listing: the newest value of each metric, with its unit kind, currency and date (``<id>__kind``, ``__ccy``, ``__at``)."""
    row = F.struct("as_of", "value", "unit_kind", "currency")
    wide = metrics.filter(F.col("metric_id").isin(*ids)).groupBy("listing_id").agg(*(F.max(F.when(F.col("metric_id") == i, row)).alias(f"__{i}") for i in ids))
    parts = (("value", ""), ("unit_kind", "__kind"), ("currency", "__ccy"), ("as_of", "__at"))
    return wide.select("listing_id", *(F.col(f"__{i}")[field].alias(f"{i}{tail}") for i in ids for field, tail in parts))


def align(wide: DataFrame, screen: Screen, rates: DataFrame) -> tuple[DataFrame, Screen]:
    """The rows of ``aligned_input`` with a rate per criterion, and the screen that compares by them.

    The first metric of a criterion is its anchor.  Money is compared in the anchor's currency: another metric is converted as of
    its own date, a constant with a currency as of the anchor's; a constant without one is taken to be in it.  Kinds must match,
    ratios and percents are one.  Where that fails ``<c>issue`` says why: unit_mismatch, currency_missing or fx_missing, and the
    criterion compares nothing.  Rates are looked up once per combination of currencies and date."""
    groups, keys, plain = [], [], wide
    same_kind = lambda c: F.when(F.col(c).isin("ratio", "percent"), "ratio").otherwise(F.col(c))
    n = 0
    for g in screen.groups:
        members = []
        for m in g.members:
            anchor = m.left if m.left.metric else m.right
            other = m.right if anchor is m.left else m.left
            if not anchor.metric:
                members.append(m)
                continue
            c, a = f"__c{n}_", anchor.metric
            n += 1
            money = F.col(f"{a}__kind").isin(*_MONEY)
            none = F.lit(None).cast("string")
            if other.metric:
                b = other.metric
                both = money & F.col(f"{b}__kind").isin(*_MONEY)
                issue = F.when(F.col(a).isNull() | F.col(b).isNull(), none).when(both & (F.col(f"{a}__ccy").isNull() | F.col(f"{b}__ccy").isNull()), "currency_missing").when(~both & (same_kind(f"{a}__kind") != same_kind(f"{b}__kind")), "unit_mismatch")
                key = F.when(both, F.struct(F.col(f"{b}__ccy").alias("base"), F.col(f"{a}__ccy").alias("quote"), F.col(f"{b}__at").alias("on_date")))
            elif other.currency:
                issue = F.when(F.col(a).isNull(), none).when(~money, "unit_mismatch").when(F.col(f"{a}__ccy").isNull(), "currency_missing")
                key = F.when(money, F.struct(F.lit(other.currency).alias("base"), F.col(f"{a}__ccy").alias("quote"), F.col(f"{a}__at").alias("on_date")))
            else:
                issue, key = none, F.lit(None).cast("struct<base:string,quote:string,on_date:date>")
            plain = plain.withColumn(f"{c}issue", issue).withColumn(f"{c}key", F.when(F.col(f"{c}issue").isNull(), key))
            keys.append(c)
            members.append(replace(m, aligned=c))
        groups.append(replace(g, members=tuple(members)))
    if not keys:
        return wide, screen
    asked = plain.select(F.explode(F.array_compact(F.array(*(F.col(f"{c}key") for c in keys)))).alias("k")).select("k.*").distinct()
    found = materialize(rates_for(asked, rates).select(F.struct("base", "quote", "on_date").alias("__k"), F.col("rate").alias("__rate")), "screen-rates")
    for c in keys:
        plain = plain.join(broadcast_if_small(found), F.col(f"{c}key") == F.col("__k"), "left").withColumn(f"{c}issue", F.coalesce(f"{c}issue", F.when(F.col(f"{c}key").isNotNull() & F.col("__rate").isNull(), "fx_missing")))
        plain = plain.withColumn(f"{c}rate", F.when(F.col(f"{c}issue").isNull(), F.when(F.col(f"{c}key").isNull(), 1.0).otherwise(F.col("__rate")))).drop("__k", "__rate", f"{c}key")
    return plain, replace(screen, groups=tuple(groups))


def rank_inputs(passers: DataFrame, ranking: Ranking, rates: DataFrame, currency: str | None = None) -> DataFrame:
    """``passers`` (rows of ``aligned_input``) with comparable values of the ranking's metrics.

    A metric of several unit kinds among the passers is dropped (NULL), as is money in several currencies unless a ``currency`` to
    compare in is given; then values are converted as of their own dates, and are NULL without a rate."""
    ids = [m.metric_id for m in ranking.metrics]
    seen = [F.struct(F.count_distinct(f"{i}__kind").alias("kinds"), F.count_distinct(f"{i}__ccy").alias("ccys")).alias(f"__n_{i}") for i in ids]
    out = passers.join(F.broadcast(passers.agg(*seen)), F.lit(True))
    for i in ids:
        money = F.col(f"{i}__kind").isin(*_MONEY)
        several = money & (F.col(f"__n_{i}.ccys") > 1)
        usable = F.when((F.col(f"__n_{i}.kinds") <= 1) & (~several | F.lit(currency is not None)), F.col(i))
        if currency is not None:
            keys = passers.select(F.col(f"{i}__ccy").alias("base"), F.lit(currency).alias("quote"), F.col(f"{i}__at").alias("on_date"))
            found = rates_for(keys, rates).select(F.col("base").alias("__b"), F.col("on_date").alias("__d"), F.col("rate").alias("__rate"))
            out = out.join(found, (F.col(f"{i}__ccy") == F.col("__b")) & (F.col(f"{i}__at") == F.col("__d")), "left")
            usable = F.when(several, usable * F.col("__rate")).otherwise(usable)
        out = out.withColumn(i, usable).drop("__b", "__d", "__rate")
    return out.drop(*(f"__n_{i}" for i in ids))
