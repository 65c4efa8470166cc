"""Problems 2, 3, 4, 8, 9 and 10 on the project's tables."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions.units import SUBUNIT_CODES
from factloom.llm import checks
from factloom.llm.components import components, links_by_shared_value
from factloom.llm.leakage import leaked_items
from factloom.llm.nearest import join_nearest
from factloom.llm.packing import count_tokens, pack
from factloom.llm.quantiles import bucket_counts, merge_counts, percentiles
from factloom.llm.truncation import truncated_texts
from factloom.operators.latest import latest_by
from factloom.operators.materialize import broadcast_if_small, materialize
from factloom.sources.tables import read_table

_OUTER = r"(?U)^\s+|\s+$"


def _trimmed(c: str) -> Column:
    return F.upper(F.regexp_replace(F.col(c), _OUTER, ""))


def major_currency(c: str) -> Column:
    code = _trimmed(c)
    out = F.when(F.lit(False), code)
    for sub, major in SUBUNIT_CODES.items():
        out = out.when(code == sub, major)
    return out.otherwise(code)


#: Days between a fact and its rate.
RATE_TOLERANCE_DAYS = 7


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    facts = read_table(spark, d, "financial_facts").select("fact_id", major_currency("currency").alias("entity"), F.unix_date("end_date").cast("long").alias("day"))
    facts = facts.filter(F.col("entity").isNotNull() & (F.col("entity") != "USD"))
    rates = read_table(spark, d, "fx_rates").select(_trimmed("base_currency").alias("base_currency"), _trimmed("quote_currency").alias("quote_currency"), "rate_date", "rate", "updated_at")
    rates = rates.filter((F.col("base_currency") == "USD") != (F.col("quote_currency") == "USD"))
    rates = latest_by(rates, ["base_currency", "quote_currency", "rate_date"], ["updated_at"])
    own = F.col("quote_currency") == "USD"
    rates = rates.withColumn("entity", F.when(own, F.col("base_currency")).otherwise(F.col("quote_currency"))).withColumn("priority", F.when(own, 0).otherwise(1)).withColumn("rate_day", F.unix_date("rate_date"))
    joined = join_nearest(facts, rates, "entity", "day", "rate_day", RATE_TOLERANCE_DAYS, ["base_currency", "quote_currency", "rate_date"], "priority")
    return joined.select("fact_id", "base_currency", "quote_currency", F.date_format("rate_date", "yyyy-MM-dd").alias("rate_date"))


def evidence_values() -> dict[str, Column]:
    """Identifiers of the right shape that are no fillers."""
    code = lambda c: F.regexp_replace(F.upper(F.col(c)), r"(?U)[\s-]", "")
    isin, lei, ticker = code("isin"), code("lei"), _trimmed("primary_ticker")
    one = r"(.)\1*"
    return {
        "isin": F.when(isin.rlike("^[A-Z]{2}[A-Z0-9]{9}[0-9]$") & ~F.substring(isin, 3, 9).rlike(f"^{one}$"), isin),
        "lei": F.when(lei.rlike("^[A-Z0-9]{20}$") & ~F.substring(lei, 1, 18).rlike(f"^{one}$") & ~F.substring(lei, 5, 14).rlike(f"^{one}$"), lei),
        "ticker": F.when(
            ticker.rlike(r"^[A-Z0-9][A-Z0-9&.\-]*\.[A-Z0-9]+$") & ~ticker.rlike(r"^([A-Z0-9])\1+\.") & ~ticker.rlike(r"^0\.") & ~ticker.rlike(r"^(NONE|UNKNOWN|NULL|NAN|TBD|TEST)\."), ticker
        ),
    }


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    links = links_by_shared_value(read_table(spark, d, "listing_evidence"), "listing_id", evidence_values())
    return components(links, "a", "b").select(F.col("node").alias("listing_id"), F.col("component").alias("group_id"))


#: Greatest relative error of the percentiles, and values that stand for a missing one (fixed value).
PERCENTILE_ERROR = 0.01
FILLER_VALUES = (-999999.0,)


def sketches(spark: SparkSession, d: str, groups: list[str]) -> DataFrame:
    """Bucket counts of ``groups`` (of metric_id, sector and as_of).  A row delivered again counts once.

    One exchange drops what was delivered again (on the map side too), one adds up the buckets; the sectors meet the values between
    them where the values are, by broadcast if the sectors are small for sure."""
    sectors = latest_by(read_table(spark, d, "securities").select(F.col("security_id").alias("listing_id"), "sector", "updated_at"), ["listing_id"], ["updated_at"])
    sectors = materialize(sectors.select("listing_id", F.initcap(F.regexp_replace("sector", _OUTER, "")).alias("sector")), "sectors")
    values = read_table(spark, d, "metrics").select("listing_id", "metric_id", "as_of", "value").filter(F.col("value").isNotNull() & ~F.col("value").isin(*FILLER_VALUES))
    values = values.distinct().join(broadcast_if_small(sectors), "listing_id", "left")
    return bucket_counts(values, groups, F.col("value"), PERCENTILE_ERROR)


def p4_daily_sketches(spark: SparkSession, d: str) -> DataFrame:
    """The sketch of each metric, sector and day: what is kept to be combined later."""
    return sketches(spark, d, ["metric_id", "sector", "as_of"]).withColumn("as_of", F.date_format("as_of", "yyyy-MM-dd"))


def _percentiles(counts: DataFrame) -> DataFrame:
    out = percentiles(counts, ["metric_id", "sector"], {"p50": 0.5, "p90": 0.9, "p99": 0.99}, PERCENTILE_ERROR)
    fix = lambda c: F.when(F.abs(c) >= 1000, F.round(c, 1)).otherwise(F.round(c, 6)).alias(c)
    return out.select("metric_id", "sector", "n", fix("p50"), fix("p90"), fix("p99"), F.lit(PERCENTILE_ERROR).alias("relative_error"))


def p4_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all days.  Buckets are added up over the days as over partitions, before the exchange."""
    return _percentiles(sketches(spark, d, ["metric_id", "sector"]))


def p4_percentiles_of_days(spark: SparkSession, d: str) -> DataFrame:
    """The same from the sketches of single days, combined."""
    return _percentiles(merge_counts(sketches(spark, d, ["metric_id", "sector", "as_of"]), ["metric_id", "sector"]))


CONTAINER_TOKENS = 2048


def p8_packing(spark: SparkSession, d: str, ranks_path: str | None = None) -> DataFrame:
    path = ranks_path or os.environ.get("FACTLOOM_TOKEN_RANKS", "/opt/tokenizers/byte_bpe_50k.tiktoken")
    sizes = materialize(count_tokens(read_table(spark, d, "documents"), ["doc_id"], "text", path), "token-counts")
    return pack(sizes, ["doc_id"], "n_tokens", CONTAINER_TOKENS)


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers by how full they are, in steps of a tenth."""
    filled = p8_packing(spark, d).groupBy("container_id").agg(F.sum("piece_size").alias("used"), F.count("*").alias("pieces"))
    return filled.groupBy(F.floor(F.col("used") * 10 / CONTAINER_TOKENS).alias("tenth")).agg(F.count("*").alias("containers"), F.sum("pieces").alias("pieces"), F.sum("used").alias("tokens"))


def p8_invariants(spark: SparkSession, d: str) -> DataFrame:
    """One row that says whether the packing is right: containers over their capacity, documents whose pieces don't cover them,
    documents split without need, and whether nine tenths of the space is used (the last container of a group may be empty)."""
    pieces = materialize(p8_packing(spark, d), "pieces")
    full = pieces.groupBy("container_id").agg(F.sum("piece_size").alias("used"))
    full = full.agg(F.count_if(F.col("used") > CONTAINER_TOKENS).alias("overfull_containers"), (F.sum("used") >= 0.9 * CONTAINER_TOKENS * (F.count("*") - 1)).alias("nearly_full"))
    docs = pieces.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("piece_size").alias("size"), F.max(F.col("piece_start") + F.col("piece_size")).alias("end"), F.max("piece_no").alias("last"))
    docs = docs.agg(
        F.count("*").alias("documents"), F.count_if((F.col("size") != F.col("end")) | (F.col("n") != F.col("last") + 1)).alias("documents_not_covered"),
        F.count_if(F.col("n") > F.greatest(F.lit(1), F.ceil(F.col("size") / CONTAINER_TOKENS))).alias("needless_splits"),
    )
    # Two tables of one row each.
    return docs.join(F.broadcast(full), F.lit(True)).select("documents", "overfull_containers", "documents_not_covered", "needless_splits", "nearly_full")


def p9_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_items(read_table(spark, d, "documents"), "doc_id", "text", read_table(spark, d, "eval_items"), "item_id", "text")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return p9_leaks(spark, d).filter("kind = 'passage'").select("doc_id", "item_id")


def p10_judged(spark: SparkSession, d: str) -> DataFrame:
    return truncated_texts(read_table(spark, d, "documents"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return p10_judged(spark, d).filter("is_cut").select("doc_id").distinct()


def p10_by_source(spark: SparkSession, d: str) -> DataFrame:
    return p10_judged(spark, d).groupBy("source").agg(F.count("*").alias("documents"), F.count_if("is_cut").alias("cut"), F.round(F.count_if("is_cut") / F.count("*"), 6).alias("cut_share"))


QUERIES = {f.__name__: f for f in (p2_found, p3_found, p4_percentiles, p4_percentiles_of_days, p4_daily_sketches, p8_packing, p8_fill, p8_invariants, p9_found, p9_leaks, p10_found, p10_judged, p10_by_source)}

_P2_SQL = """
WITH f AS (
  SELECT fact_id, end_date, CASE upper(trim(currency)) WHEN 'GBX' THEN 'GBP' WHEN 'GBP0.01' THEN 'GBP' WHEN 'ZAC' THEN 'ZAR' WHEN 'ILA' THEN 'ILS' ELSE upper(trim(currency)) END AS e FROM financial_facts WHERE currency IS NOT NULL
), r AS (
  SELECT DISTINCT base_currency, quote_currency, rate_date, CASE WHEN quote_currency = 'USD' THEN base_currency ELSE quote_currency END AS e, CASE WHEN quote_currency = 'USD' THEN 0 ELSE 1 END AS priority
  FROM fx_rates WHERE (base_currency = 'USD') <> (quote_currency = 'USD')
), k AS (
  SELECT k.e, k.end_date, base_currency, quote_currency, rate_date FROM (SELECT DISTINCT e, end_date FROM f) k JOIN r ON r.e = k.e AND r.rate_date BETWEEN k.end_date - 7 AND k.end_date + 7
  QUALIFY row_number() OVER (PARTITION BY k.e, k.end_date ORDER BY abs(date_diff('day', k.end_date, rate_date)), rate_date, priority) = 1
)
SELECT fact_id, base_currency, quote_currency, strftime(rate_date, '%Y-%m-%d') AS rate_date FROM f JOIN k USING (e, end_date)
"""
_P3_SQL = r"""
WITH RECURSIVE v AS (
  SELECT listing_id, 'i' AS kind, regexp_replace(upper(isin), '[\s-]', '', 'g') AS value FROM listing_evidence
  UNION SELECT listing_id, 'l', regexp_replace(upper(lei), '[\s-]', '', 'g') FROM listing_evidence
  UNION SELECT listing_id, 't', regexp_replace(upper(primary_ticker), '^\s+|\s+$', '', 'g') FROM listing_evidence
), ok AS (
  SELECT * FROM v WHERE CASE kind
    WHEN 'i' THEN regexp_full_match(value, '[A-Z]{2}[A-Z0-9]{9}[0-9]') AND replace(value[3:11], value[3], '') <> ''
    WHEN 'l' THEN regexp_full_match(value, '[A-Z0-9]{20}') AND replace(value[1:18], value[1], '') <> '' AND replace(value[5:18], value[5], '') <> ''
    ELSE regexp_full_match(value, '[A-Z0-9][A-Z0-9&.-]*\.[A-Z0-9]+') AND (value[2] = '.' OR replace(split_part(value, '.', 1), value[1], '') <> '') END
), edges AS (SELECT DISTINCT a.listing_id AS x, b.listing_id AS y FROM ok a JOIN ok b USING (kind, value)),
reach AS (SELECT x, y FROM edges UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x)
SELECT x AS listing_id, min(y) AS group_id FROM reach GROUP BY x HAVING count(*) > 1
"""
_G = (1 + PERCENTILE_ERROR) / (1 - PERCENTILE_ERROR)
_SKETCH_SQL = f"""
WITH s AS (
  SELECT security_id AS listing_id, array_to_string(list_transform(string_split(lower(trim(sector)), ' '), lambda x: upper(x[1]) || x[2:]), ' ') AS sector
  FROM securities QUALIFY row_number() OVER (PARTITION BY security_id ORDER BY updated_at DESC) = 1
), m AS (
  SELECT DISTINCT listing_id, metric_id, as_of, value FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) AND NOT isinf(value) AND value <> -999999.0
), b AS (
  SELECT metric_id, sector, as_of, CAST(sign(value) AS INTEGER) AS sign, CASE WHEN value = 0 THEN 0 ELSE CAST(ceil(ln(abs(value)) / ln({_G!r})) AS BIGINT) END AS bucket, count(*) AS n
  FROM m LEFT JOIN s USING (listing_id) GROUP BY ALL
)
"""
_PCT = ", ".join(f"min_by(v, upto) FILTER (upto > floor({q} * (total - 1))) AS {n}" for n, q in (("p50", 0.5), ("p90", 0.9), ("p99", 0.99)))
_P4_SQL = f"""{_SKETCH_SQL}, c AS (SELECT metric_id, sector, sign, bucket, CAST(sum(n) AS BIGINT) AS n FROM b GROUP BY ALL),
r AS (
  SELECT *, sum(n) OVER (PARTITION BY metric_id, sector ORDER BY sign, sign * bucket) AS upto, sum(n) OVER (PARTITION BY metric_id, sector) AS total,
    CASE WHEN sign = 0 THEN 0.0 ELSE sign * 2 * power({_G!r}, bucket) / ({_G!r} + 1) END AS v
  FROM (SELECT metric_id, sector, sign, bucket, n FROM c)
), p AS (SELECT metric_id, sector, CAST(max(total) AS BIGINT) AS n, {_PCT} FROM r GROUP BY 1, 2)
SELECT metric_id, sector, n, {", ".join(f"CASE WHEN abs({x}) >= 1000 THEN round({x}, 1) ELSE round({x}, 6) END AS {x}" for x in ("p50", "p90", "p99"))}, CAST({PERCENTILE_ERROR} AS DOUBLE) AS relative_error FROM p
"""
SQL = {"p2_found": _P2_SQL, "p3_found": _P3_SQL, "p4_daily_sketches": _SKETCH_SQL + "SELECT * REPLACE (strftime(as_of, '%Y-%m-%d') AS as_of) FROM b", "p4_percentiles": _P4_SQL, "p4_percentiles_of_days": _P4_SQL}
SQL |= {"p8_invariants": checks.P8_INVARIANTS, "p9_found": checks.P9_FOUND, "p10_found": checks.P10_FOUND, "p10_by_source": checks.P10_BY_SOURCE}
