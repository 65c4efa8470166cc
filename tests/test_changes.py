from datetime import date, datetime

from pyspark.sql import functions as F

from factloom.operators.latest import latest_by
from factloom.operators.snapshots import snapshot_changes
from factloom.operators.spikes import implausible_values


def test_snapshot_changes(spark):
    a, b, c = date(2026, 1, 31), date(2026, 2, 28), date(2026, 3, 31)
    t = datetime(2026, 1, 1)
    late = datetime(2026, 6, 1)
    rows = [
        (a, "X", "v", 1, t), (a, "x ", "w", 1, late), (b, "X", "w", 1, t), (b, "X", "w", 1, t), (c, "X", "w", 2, t),
        (a, "Y", None, 1, t), (b, "Y", None, 1, t),
        (b, "Z", None, 1, t), (c, "Z", "null", 1, t),
        (None, "Q", "v", 1, t), (a, None, "v", 1, t),
    ]
    df = spark.createDataFrame(rows, "at date, k string, f string, g long, delivered timestamp")
    out = snapshot_changes(df, "at", {"k": F.upper(F.trim("k"))}, {"f": F.col("f"), "g": F.col("g")}, "delivered")
    assert sorted((r["at"], r.k, r.change_kind, r.changed_fields) for r in out.collect()) == [
        (b, "Z", "added", None), (c, "X", "changed", ["g"]), (c, "Y", "removed", None), (c, "Z", "changed", ["f"]),
    ]
    assert snapshot_changes(df.limit(0), "at", {"k": F.col("k")}, {"f": F.col("f")}, "delivered").count() == 0


def test_latest_by(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, 2, "b"), (1, 2, "c"), (None, 1, "d"), (None, None, "e")], "k long, o long, v string")
    assert sorted(((r.k, r.v) for r in latest_by(df, ["k"], ["o"]).collect()), key=str) == [(1, "c"), (None, "d")]


def _found(spark, values, **kw):
    rows = [(i, "s", date(2020, 1, 1).replace(year=2000 + i // 12, month=1 + i % 12) if v != "x" else None, None if v == "x" else v, i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id long, s string, at date, v double, o long").withColumn("t", F.lit("t"))
    yes, no = F.lit(True), F.lit(False)
    out = implausible_values(df, "id", ["s", "t"], "at", "v", ["o"], may_be_negative=kw.get("neg", yes), upper_bound=kw.get("top", F.lit(None).cast("double")), may_be_stuck=kw.get("stick", yes))
    del no
    return sorted((r.id, r.reason) for r in out.collect())


BASE = [100.0, 102.0, 99.0, 101.0, 103.0, 98.0, 100.5, 101.5, 99.5, 100.2, 102.2, 98.8, 100.1, 101.1]


def test_spikes(spark):
    v = list(BASE)
    v[4] = 250.0
    assert _found(spark, v) == [(4, "spike")]
    v[5] = 240.0
    assert _found(spark, v) == [(4, "spike"), (5, "spike")]
    v[6] = 245.0  # three dates are a level
    assert _found(spark, v) == []
    assert _found(spark, [*BASE[:10], -100.0, *BASE[10:]]) == [(10, "spike")]
    assert _found(spark, [*BASE, 500.0]) == []  # it can't be seen to return
    assert _found(spark, BASE[:5] + [500.0] + BASE[:4]) == []  # too few rows
    assert _found(spark, [b * (3 if i > 6 else 1) for i, b in enumerate(BASE)]) == []  # a lasting change


def test_stuck_and_impossible(spark):
    v = [*BASE[:5], *[7.0] * 6, *BASE[5:]]
    assert _found(spark, v) == [(i, "stuck") for i in range(5, 11)]
    assert _found(spark, [*BASE[:5], *[7.0] * 5, *BASE[5:]], stick=F.lit(True)) == []
    assert _found(spark, v, stick=F.lit(False)) == []
    assert _found(spark, [-1.0, 0.0, 2.0, float("nan"), "x"], neg=F.lit(False), top=F.lit(1.0)) == [(0, "impossible"), (2, "impossible")]
    assert _found(spark, [-1.0, None], neg=F.lit(None).cast("boolean")) in ([], [(0, "impossible")])


def test_series_without_a_long_key(spark):
    values = [100.0 + i % 7 for i in range(30)] + [50.0] * 8
    values[10] = 900.0
    rows = [(k, i, f"{2000 + i}-06-30", v) for k in (None, 5) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, id long, d string, v double").select("*", F.col("d").cast("date").alias("at"))
    df = df.withColumn("id", F.col("id") + F.when(F.col("k").isNull(), 1000).otherwise(0))
    df = df.withColumn("v0", F.lit("a"))
    out = implausible_values(df, "id", ["k", "v0"], "at", "v", ["id"], may_be_negative=F.lit(True), upper_bound=F.lit(None).cast("double"), may_be_stuck=F.lit(True))
    got = {(r.id, r.reason) for r in out.collect()}
    assert {(10, "spike"), (30, "stuck")} <= got
    assert {(i - 1000, r) for i, r in got if i >= 1000} == {(i, r) for i, r in got if i < 1000}


def test_long_series_are_judged_alike(spark):
    """A series of many rows, most of them repeats of two dates, and short ones: either way gives the same."""
    values = [100.0 + i % 7 for i in range(30)] + [50.0] * 8
    values[10] = 900.0
    rows = [(k * 10_000 + i, k, date(2000 + i, 6, 30), v) for k in (1, 2) for i, v in enumerate(values)]
    rows += [(20_000 + 100 + j, 2, date(2010, 6, 30), 900.0 if j % 2 else 103.0) for j in range(300)] + [(20_000 + 500 + j, 2, date(2012, 6, 30), -5.0) for j in range(50)] + [(1, None, date(2001, 1, 1), 1.0), (2, 1, None, -3.0)]
    df = spark.createDataFrame(rows, "id long, k long, at date, v double").withColumn("s", F.lit("a"))
    one = lambda n: sorted((r.id, r.reason) for r in implausible_values(df, "id", ["k", "s"], "at", "v", ["id"], may_be_negative=F.lit(False), upper_bound=F.lit(None).cast("double"), may_be_stuck=F.lit(True), long_series=n).collect())
    whole = one(10**6)
    assert whole == one(100) == one(0) and {(10_010, "spike"), (20_101, "spike"), (20_500, "impossible"), (2, "impossible")} <= set(whole) and (20_100, "spike") not in whole
