"""Sector-relative ranking: capped, winsorized midranks, weighted into a score."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class RankedMetric:
    metric_id: str
    weight: float = 1.0
    higher_is_better: bool = True
    cap: float | None = None


@dataclass(frozen=True)
class Ranking:
    metrics: list[RankedMetric]
    tie_breakers: list[tuple[str, bool]] = field(default_factory=list)  # metric and whether ascending
    min_sector_peers: int = 10
    lower: float = 0.05
    upper: float = 0.95


def score(passers: DataFrame, ranking: Ranking, sector: str = "sector", label: str = "symbol") -> DataFrame:
    """``passers`` (a wide row each: label, sector, a column per metric) with ``score``, ``rank`` and a score per metric.

    Peers are the passers of the sector, if there are enough, else all passers.  Of the peers that have the metric, values are
    capped, winsorized at linear-interpolated percentiles, and ranked by midrank: (less + half the equal) / n, times 100, turned
    for metrics where low is good.  A missing value scores 50 at full weight.  The score is the weighted mean (0 without weight).
    Ranks are unique: score descending, tie breakers with NULL last, then the label.

    Passers are those of one screen, a few hundred or thousand of a universe; windows over all of them run in one task only for
    passers of small sectors' fallback group.
    """
    by_sector = Window.partitionBy("__sector")
    peers = passers.withColumn("__sector", F.when(F.trim(sector) != "", F.trim(sector)))
    peers = peers.withColumn("__own", F.col("__sector").isNotNull() & (F.count("*").over(by_sector) >= ranking.min_sector_peers))
    scores = []
    for i, m in enumerate(ranking.metrics):
        raw = F.col(m.metric_id)
        value = F.when(raw.isNotNull() & ~F.isnan(raw), F.least(raw, F.lit(m.cap)) if m.cap is not None else raw)
        # All rows are peers of the fallback group; only rows of large sectors are ranked inside their own.
        out = None
        for name, group in (("s", ["__sector"]), ("a", [])):
            whole = Window.partitionBy(*group)
            peers = peers.withColumn(f"__v{i}", value)
            lo, hi = (F.percentile(f"__v{i}", F.lit(q)).over(whole) for q in (ranking.lower, ranking.upper))
            peers = peers.withColumn(f"__w{name}{i}", F.when(F.col(f"__v{i}").isNotNull(), F.greatest(lo, F.least(hi, F.col(f"__v{i}")))))
            w = f"__w{name}{i}"
            below = F.count(w).over(Window.partitionBy(*group).orderBy(F.col(w).asc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow))
            equal = F.count(w).over(Window.partitionBy(*group, w))
            p = (below - equal + 0.5 * equal) / F.count(w).over(whole)
            one = F.when(F.col(w).isNotNull(), (p if m.higher_is_better else 1 - p) * 100.0)
            out = one if out is None else F.when(F.col("__own"), out).otherwise(one)
        name = f"score_{m.metric_id}"
        peers = peers.withColumn(name, F.coalesce(out, F.lit(50.0)))
        scores.append((name, m.weight))
    weight = sum(w for _, w in scores)
    whole = sum((F.col(n) * w for n, w in scores), F.lit(0.0)) / weight if weight else F.lit(0.0)
    order = [F.desc("score"), *((F.asc_nulls_last(t) if up else F.desc_nulls_last(t)) for t, up in ranking.tie_breakers), F.asc(label)]
    peers = peers.withColumn("score", whole)
    peers = peers.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return peers.select(*passers.columns, *(n for n, _ in scores), "score", "rank")
