"""Writing tables: upserts by key and replacement of slices, as whole-table plans over Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Old rows with those of ``new`` in place of rows of the same keys; of several new rows the greatest by ``order`` (else by all columns).

    Both sides are combined on the map side and meet in one shuffle.  NULL is a key of its own; columns are matched by name."""
    rest = [c for c in old.columns if c not in keys]
    tagged = old.withColumn("__new", F.lit(0)).unionByName(new.select(*old.columns).withColumn("__new", F.lit(1)))
    rank = F.struct("__new", *(order or []), *rest)
    return tagged.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("r")).select(*(F.col(c) if c in keys else F.col(f"r.{c}").alias(c) for c in old.columns))


def replace_slices(old: DataFrame, new: DataFrame, slices: list[str], keys: list[str]) -> DataFrame:
    """Old rows outside the slices that ``new`` holds, and the new rows, one per key."""
    kept = old.join(new.select(*slices).distinct(), slices, "left_anti")
    return kept.select(*old.columns).unionByName(new.select(*old.columns).dropDuplicates(keys))


def refuse_mass_removal(old: DataFrame, new: DataFrame, keys: list[str], least: int = 20, share: float = 0.5) -> None:
    """Raises if ``new`` lacks at least ``least`` of the old keys and more than ``share`` of them; two counts, nothing else comes back."""
    before = old.select(*keys).distinct()
    n, gone = before.count(), before.join(new.select(*keys).distinct(), keys, "left_anti").count()
    if gone >= least and gone > share * n:
        raise ValueError(f"{gone} of {n} keys are missing from the delivery")


def write_partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """Overwrites only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def changed_payloads(raw: DataFrame, done: DataFrame, key: str = "provider_listing_id", digest: str = "payload_hash") -> DataFrame:
    """Payloads never normalized or changed since: those whose key and hash aren't among ``done``."""
    return raw.join(done.select(key, digest).distinct(), [key, digest], "left_anti")
