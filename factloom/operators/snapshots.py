"""What changed between consecutive full snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.latest import latest_by


def snapshot_changes(df: DataFrame, snapshot: str, keys: dict[str, Column], fields: dict[str, Column], delivered: str) -> DataFrame:
    """Records added, removed or changed between each snapshot and the next one.

    Every row becomes signed cells: one per field with its value, and one that marks the presence of its key; +1 where its
    snapshot is the later one of a pair and -1 where it is the earlier.  Cells are summed by pair, key, field and value; what
    is left nonzero classifies the record.  Rows delivered again combine on the map side; one exchange by key then brings the
    snapshots of a record together (as many rows as there are snapshots), and cells are made, summed and read there.

    ``keys`` and ``fields`` name normalized expressions.  Within a snapshot the row with the latest ``delivered`` counts (ties:
    the greatest values, so the result doesn't depend on the order of the rows).  Rows without a snapshot date or with a NULL
    key belong to no record and are left out; NULL field values equal each other.  A snapshot date without rows doesn't exist.
    Returns ``snapshot`` (the later), the keys, ``change_kind`` and ``changed_fields`` (sorted; NULL unless changed).
    """
    cells = {name: F.coalesce(F.concat(F.lit("="), value.cast("string")), F.lit("null")) for name, value in fields.items()}
    rows = df.select(F.col(snapshot).alias("__at"), F.col(delivered).alias("__delivered"), *(e.alias(k) for k, e in keys.items()), *(e.alias(f"__f_{n}") for n, e in cells.items()))
    rows = rows.filter(F.col("__at").isNotNull()).dropna(subset=list(keys))
    rows = latest_by(rows, ["__at", *keys], ["__delivered"])
    rows = rows.repartition(*keys)
    # As many rows as there are snapshot dates.
    dates = df.select(F.col(snapshot).alias("__at")).filter(F.col("__at").isNotNull()).distinct()
    dates = dates.withColumn("__next", F.lead("__at").over(Window.orderBy("__at"))).withColumn("__first", F.row_number().over(Window.orderBy("__at")) == 1)
    signed = rows.join(F.broadcast(dates), "__at").select(
        *keys,
        F.explode(F.array(F.struct(F.when(~F.col("__first"), F.col("__at")).alias("at"), F.lit(1).alias("sign")), F.struct(F.col("__next").alias("at"), F.lit(-1).alias("sign")))).alias("__s"),
        F.array(F.struct(F.lit("").alias("field"), F.lit("").alias("value")), *(F.struct(F.lit(n).alias("field"), F.col(f"__f_{n}").alias("value")) for n in fields)).alias("__cells"),
    )
    signed = signed.filter(F.col("__s.at").isNotNull()).select(F.col("__s.at").alias(snapshot), *keys, F.col("__s.sign").alias("__sign"), F.explode("__cells").alias("__cell"))
    sums = signed.groupBy(snapshot, *keys, "__cell").agg(F.sum("__sign").alias("__n")).filter(F.col("__n") != 0)
    presence = F.max(F.when(F.col("__cell.field") == "", F.col("__n")))
    out = sums.groupBy(snapshot, *keys).agg(presence.alias("__p"), F.array_sort(F.collect_set(F.when(F.col("__cell.field") != "", F.col("__cell.field")))).alias("__fields"))
    kind = F.when(F.col("__p") > 0, "added").when(F.col("__p") < 0, "removed").otherwise("changed")
    return out.select(snapshot, *keys, kind.alias("change_kind"), F.when(F.col("__p").isNull(), F.col("__fields")).alias("changed_fields"))
