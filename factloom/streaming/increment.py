"""Raw payloads to facts as they arrive: the batch operators, called per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from factloom.operators.latest import latest_by
from factloom.operators.materialize import discard, materialize
from factloom.operators.nested import FlatTable, flatten
from factloom.operators.normalize import facts_from_entries
from factloom.operators.upsert import replace_slices, write_partitioned

_NATURAL = ["concept", "fiscal_period", "end_date"]


def facts_stream(payloads: DataFrame, tables: list[FlatTable], key: str, text: str, fetched: str, target: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Starts the stream: of each key in a micro-batch, the latest payload replaces the key's facts in the Parquet table ``target``.

    The table is partitioned by a hash of the key in ``buckets``; a micro-batch rewrites only the buckets of its keys.  Running a
    micro-batch again gives the same table, so a restart after a failure is harmless.  Broken payloads replace nothing.  All
    data there are at the start are taken, then the query ends (trigger availableNow)."""
    spark = payloads.sparkSession
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket")

    def write(batch: DataFrame, _: int) -> None:
        newest = latest_by(batch.select(key, text, fetched), [key], [fetched])
        facts = facts_from_entries(flatten(newest, text, [key], tables), key).select("*", bucket)
        facts = materialize(facts, "increment")
        if touched := [r.bucket for r in facts.select("bucket").distinct().collect()]:  # at most ``buckets``
            old = _existing(spark, target, facts).filter(F.col("bucket").isin(touched))
            merged = materialize(replace_slices(old, facts, [key], [key, *_NATURAL]), "merged")
            write_partitioned(merged, target, ["bucket"])
            discard(merged)
        discard(facts)

    return payloads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _existing(spark: SparkSession, target: str, like: DataFrame) -> DataFrame:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    there = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(like.schema).parquet(target) if there else like.limit(0)
