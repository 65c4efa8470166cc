"""Listings to issuers: classification by peers and grouping by identifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.functions.scalars import shaped_isin, shaped_lei, trimmed
from factloom.operators.materialize import discard, materialize

#: Home categories of depositary receipts, and venues of the United States that are no quote tiers (fixed values).
DEPOSITARY = ("ADR", "ADR PRIMARY", "ADR SECONDARY", "ADR PREFERRED", "BDR")
PRIMARY_US_VENUES = ("NASDAQ", "NYSE", "AMEX", "NYSE ARCA", "BATS")


def classify(evidence: DataFrame) -> DataFrame:
    """``listing_id``, ``status``, ``rule``: R1 depositary receipts are secondary; R2 a listing is primary if its own symbol is the
    primary ticker, else secondary; R3 one without ticker is primary if any other listing of its ISIN names it, and secondary if
    they only name others; R4 unknown.

    The first rule that holds counts.  ``evidence`` has one row per listing: listing_id, provider_symbol, primary_ticker,
    home_category, isin.  A listing that R3 asks about has no ticker, so it never is its own peer."""
    rows = evidence.select("listing_id", F.upper(trimmed("provider_symbol")).alias("symbol"), F.upper(trimmed("primary_ticker")).alias("ticker"), F.upper(trimmed("home_category")).alias("home"), shaped_isin("isin").alias("isin"))
    named = rows.filter("isin IS NOT NULL AND ticker IS NOT NULL").select("isin", F.col("ticker").alias("symbol")).distinct()
    peers = named.select("isin").distinct().withColumn("has_peers", F.lit(True))
    rows = rows.join(peers, "isin", "left").join(named.withColumn("is_named", F.lit(True)), ["isin", "symbol"], "left")
    rule = F.when(F.col("home").isin(*DEPOSITARY), "R1").when(F.col("ticker").isNotNull(), "R2").when(F.col("has_peers"), "R3").otherwise("R4")
    own = F.when(F.col("rule") == "R2", F.col("ticker") == F.col("symbol")).otherwise(F.coalesce("is_named", F.lit(False)))
    status = F.when(F.col("rule") == "R1", "secondary").when(F.col("rule") == "R4", "unknown").when(own, "primary").otherwise("secondary")
    return rows.withColumn("rule", rule).select("listing_id", status.alias("status"), "rule")


def rescue_sole_listings(classified: DataFrame, evidence: DataFrame) -> DataFrame:
    """``classified`` with receipts on a venue proper that are the only line of their company turned to unknown (rule "rescue").

    A receipt stays secondary if a listing that isn't secondary shares its ISIN or its LEI.  Survivors are taken before any
    rescue.  ``evidence`` has one row per listing: listing_id, isin, lei, venue_tier."""
    rows = classified.join(evidence.select("listing_id", shaped_isin("isin").alias("isin"), shaped_lei("lei").alias("lei"), F.upper(trimmed("venue_tier")).alias("venue")), "listing_id", "left")
    alive = rows.filter("status <> 'secondary'")
    by_isin = alive.select("isin").dropna().distinct().withColumn("i", F.lit(True))
    by_lei = alive.select("lei").dropna().distinct().withColumn("l", F.lit(True))
    rows = rows.join(by_isin, "isin", "left").join(by_lei, "lei", "left")
    sole = (F.col("rule") == "R1") & F.col("venue").isin(*PRIMARY_US_VENUES) & F.col("i").isNull() & F.col("l").isNull()
    sole = F.coalesce(sole, F.lit(False))
    return rows.select("listing_id", F.when(sole, "unknown").otherwise(F.col("status")).alias("status"), F.when(sole, "rescue").otherwise(F.col("rule")).alias("rule"))


def newest_identities(evidence: DataFrame, order: str) -> DataFrame:
    """One row per listing with its newest ISIN and LEI of the right shape."""
    return fill_missing(evidence.select("listing_id", shaped_isin("isin").alias("isin"), shaped_lei("lei").alias("lei"), order), ["listing_id"], ["isin", "lei"], order)


def group_issuers(identities: DataFrame) -> DataFrame:
    """``listing_id`` and ``issuer_group`` (the least listing): listings of one LEI belong together, and listings of one ISIN unless
    that would join two LEIs.

    ``identities`` has one row per listing (see ``newest_identities``), so groups by LEI are single keys, and an ISIN joins at
    most one of them with listings that have none: two aggregations and joins, no iteration.  The order of rows doesn't matter."""
    rows = materialize(identities.select(F.col("listing_id").cast("long").alias("listing_id"), shaped_isin("isin").alias("isin"), shaped_lei("lei").alias("lei")), "identities")
    isins = rows.filter("isin IS NOT NULL").groupBy("isin").agg(F.min("lei").alias("a"), F.max("lei").alias("b"))
    joined = rows.join(isins, "isin", "left")
    key = F.when(F.col("lei").isNotNull(), F.concat(F.lit("L"), F.col("lei"))).when((F.col("a") == F.col("b")), F.concat(F.lit("L"), F.col("a")))
    key = F.coalesce(key, F.when(F.col("isin").isNotNull() & F.col("a").isNull(), F.concat(F.lit("I"), F.col("isin"))), F.concat(F.lit("N"), F.col("listing_id").cast("string")))
    keyed = joined.select("listing_id", key.alias("key"))
    least = keyed.groupBy("key").agg(F.min("listing_id").alias("issuer_group"))
    return keyed.join(least, "key").select("listing_id", "issuer_group")


def claim_representatives(members: DataFrame) -> DataFrame:
    """``issuer_group`` and ``representative``: in the order of the groups each takes its least issuer that no earlier one took (NULL
    if none is left).  ``members`` has issuer_group and issuer_id.

    Every group asks for its least issuer; of several the first group gets it and the others ask for their next one, until
    no one is turned down.  As all issuers prefer earlier groups, this ends where taking turns would; rounds are as many as the
    longest chain of refusals, and groups without a shared issuer are settled in the first."""
    left = materialize(members.select("issuer_group", "issuer_id").dropna().distinct(), "claims")
    while True:
        asked = left.groupBy("issuer_group").agg(F.min("issuer_id").alias("issuer_id"))
        lost = asked.join(asked.groupBy("issuer_id").agg(F.min("issuer_group").alias("winner")), "issuer_id").filter("issuer_group <> winner").select("issuer_group", "issuer_id")
        lost = materialize(lost, "refused")
        if lost.isEmpty():
            break
        fewer = materialize(left.join(lost, ["issuer_group", "issuer_id"], "left_anti"), "claims")
        discard(left)
        left = fewer
    groups = members.select("issuer_group").distinct()
    return groups.join(left.groupBy("issuer_group").agg(F.min("issuer_id").alias("representative")), "issuer_group", "left")


def fill_missing(rows: DataFrame, keys: list[str], columns: list[str], order: str) -> DataFrame:
    """One row per key with the newest value of each column that isn't NULL; rows complete each other."""
    newest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(order, c))).alias(c)
    return rows.groupBy(*keys).agg(*map(newest, columns))
