"""Matching records by nearest time: a stateful join that buffers both sides per entity.

``NearestState`` is the state of one entity.  It takes both sides in order of time, holds back a left row until the watermark
has passed its tolerance horizon, then emits it with the nearest right row and evicts right rows no pending row can reach.
``nearest_in_time`` replays tables through it; ``stream_nearest`` runs it on streams with Spark's own state and watermark.
"""

from __future__ import annotations

import pickle
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from factloom.operators.materialize import broadcast_if_small, materialize



class NearestState:
    """Buffers of one entity.  Times are integers; ``priority`` orders right rows of one time, the least first."""

    def __init__(self, tolerance: int) -> None:
        self.tolerance = tolerance
        self.pending: list[tuple] = []  # (time, row), by time
        self.right: list[tuple] = []  # (time, priority, row), by time

    def add_right(self, time: int, priority: int, row: tuple) -> None:
        key = (time, priority)
        at = bisect_left(self.right, key, key=lambda r: r[:2])
        if at == len(self.right) or self.right[at][:2] != key:
            self.right.insert(at, (time, priority, row))

    def add_left(self, time: int, row: object) -> None:
        if self.pending and time < self.pending[-1][0]:
            self.pending.insert(bisect_left(self.pending, time, key=lambda p: p[0]), (time, row))
        else:
            self.pending.append((time, row))

    def advance(self, watermark: int | None) -> Iterator[tuple[int, object, tuple]]:
        """Left rows whose horizon the watermark has passed (all, if it is None), each with its nearest right row; those
        without one in reach give nothing.  Ties go to the earlier time, then to the lesser priority."""
        done = 0
        for time, row in self.pending:
            if watermark is not None and time + self.tolerance >= watermark:
                break
            done += 1
            at = bisect_left(self.right, time, key=lambda r: r[0])
            best = None
            if at < len(self.right):  # the first of the least time at or after
                best = (self.right[at][0] - time, 1, self.right[at])
            if at:
                before = self.right[bisect_left(self.right, self.right[at - 1][0], key=lambda r: r[0])]
                if best is None or time - before[0] <= best[0]:
                    best = (time - before[0], 0, before)
            if best and best[0] <= self.tolerance:
                yield time, row, best[2][2]
        del self.pending[:done]
        if watermark is not None:
            oldest = min(self.pending[0][0] if self.pending else watermark, watermark)
            del self.right[: bisect_left(self.right, oldest - self.tolerance, key=lambda r: r[0])]


def nearest_in_time(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, tolerance: int, payload: list[str], priority: str, slice_width: int | None = None) -> DataFrame:
    """The nearest right row of each different (entity, time) of the left side: ``entity``, ``left_time`` and ``payload``.

    Times are integers of any unit (days, microseconds).  The state is cut by entity and slices of time, so that a hot entity is spread
    over tasks; right rows go to every slice they can reach (two, as slices are wider than the tolerance).  The left side is
    reduced to its different keys on the map side before it is sorted.  Right rows of one entity, time and priority should be unique; of several one counts (the least by payload).

    NULL entities or times match nothing.  Left keys without a partner in reach give no row.
    """
    width = max(slice_width or 0, 4 * tolerance + 1)
    slot = lambda c: F.floor(c / F.lit(width))
    lefts = left.select(F.col(entity).alias("e"), F.col(left_time).cast("long").alias("t")).dropna().distinct()
    kinds = T.StructType([right.schema[p] for p in payload])
    rights = right.select(F.col(entity).alias("e"), F.col(right_time).cast("long").alias("t"), F.col(priority).cast("long").alias("p"), F.struct(*payload).alias("r")).dropna(subset=["e", "t"])
    rights = rights.groupBy("e", "t", "p").agg(F.min("r").alias("r"))
    both = lefts.select("e", slot(F.col("t")).alias("slice"), "t", F.lit(None).cast("long").alias("p"), F.lit(None).cast(kinds).alias("r"), F.lit(True).alias("is_left")).unionByName(
        rights.select("e", F.explode(F.sequence(slot(F.col("t") - tolerance), slot(F.col("t") + tolerance))).alias("slice"), "t", F.coalesce("p", F.lit(0)).alias("p"), "r", F.lit(False).alias("is_left"))
    )
    ordered = both.repartition("e", "slice").sortWithinPartitions("e", "slice", "t", "is_left", "p")
    names = [f.name for f in kinds.fields]
    out = T.StructType([T.StructField(entity, left.schema[entity].dataType), T.StructField(left_time, T.LongType()), *kinds.fields])

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, at = NearestState(tolerance), None
        for batch in batches:
            rows: list[tuple] = []
            values = list(zip(*(batch["r"][n] for n in names), strict=True)) if isinstance(batch["r"], pd.DataFrame) else [tuple((r or {}).get(n) for n in names) for r in batch["r"]]
            for e, s, t, p, is_left, value in zip(batch["e"], batch["slice"], batch["t"], batch["p"], batch["is_left"], values, strict=True):
                if at != (e, s):
                    if at:
                        rows += [(at[0], time, *found) for time, _, found in state.advance(None)]
                    state, at = NearestState(tolerance), (e, s)
                if is_left:
                    state.add_left(t, None)
                else:
                    state.add_right(t, int(p), value)
                rows += [(e, time, *found) for time, _, found in state.advance(t)]
            yield pd.DataFrame(rows, columns=out.names)
        if at:
            yield pd.DataFrame([(at[0], time, *found) for time, _, found in state.advance(None)], columns=out.names)

    return ordered.mapInPandas(replay, out)


def join_nearest(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, tolerance: int, payload: list[str], priority: str) -> DataFrame:
    """Left rows with the ``payload`` of their nearest right row; left rows without one are left out.

    The matches of the different keys are written once.  They come back to the rows by broadcast if their size in memory is
    small for sure, else by a shuffled join, whose hot keys adaptive execution splits.  Names of ``payload`` must not
    occur on the left."""
    matches = materialize(nearest_in_time(left, right, entity, left_time, right_time, tolerance, payload, priority), "nearest")
    return left.join(broadcast_if_small(matches), [entity, left_time])


def stream_nearest(left: DataFrame, right: DataFrame, entity: str, left_time: str, right_time: str, delay: str, tolerance_seconds: int, row: list[str], payload: list[str], priority: str, slice_seconds: int = 0) -> DataFrame:
    """The same join of two streams: each left row comes out once, when the watermark has passed its time by the tolerance.

    Times are timestamps.  ``row`` and ``payload`` name the columns taken from the sides.  State is kept per entity and
    slice of time (at least four tolerances wide) by ``applyInPandasWithState``, so a hot entity is spread over tasks and no state
    outlives its slice; right rows go to every slice they can reach.  A timeout in event time emits rows when their entity has no new data.  Rows later than
    ``delay`` behind the watermark are dropped, as in every watermarked query.
    """
    us = lambda c: F.unix_micros(c)
    lt, rt = T.StructType([left.schema[c] for c in row]), T.StructType([right.schema[c] for c in payload])
    lefts = left.select(F.col(entity).alias("e"), F.col(left_time).alias("ts"), us(F.col(left_time)).alias("t"), F.lit(0).cast("long").alias("p"), F.lit(True).alias("is_left"), *(F.col(c).alias(f"l_{c}") for c in row), *(F.lit(None).cast(right.schema[c].dataType).alias(f"r_{c}") for c in payload))
    rights = right.select(F.col(entity).alias("e"), F.col(right_time).alias("ts"), us(F.col(right_time)).alias("t"), F.col(priority).cast("long").alias("p"), F.lit(False).alias("is_left"), *(F.lit(None).cast(left.schema[c].dataType).alias(f"l_{c}") for c in row), *(F.col(c).alias(f"r_{c}") for c in payload))
    tolerance = tolerance_seconds * 1_000_000
    width = max(slice_seconds * 1_000_000, 4 * tolerance + 1)
    slot = lambda c: F.floor(c / F.lit(width))
    lefts = lefts.withColumn("slice", slot(F.col("t")))
    rights = rights.withColumn("slice", F.explode(F.sequence(slot(F.col("t") - tolerance), slot(F.col("t") + tolerance))))
    both = lefts.withWatermark("ts", delay).unionByName(rights.withWatermark("ts", delay))
    out = T.StructType([T.StructField(entity, left.schema[entity].dataType), *lt.fields, *rt.fields])

    def step(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = pickle.loads(group.get[0]) if group.exists else NearestState(tolerance)
        for batch in batches:
            ls, rs = (list(zip(*(batch[f"{s}_{c}"] for c in cs), strict=True)) for s, cs in (("l", row), ("r", payload)))
            for t, p, is_left, a, b in zip(batch["t"], batch["p"], batch["is_left"], ls, rs, strict=True):
                if is_left:
                    state.add_left(t, a)
                else:
                    state.add_right(t, int(p), b)
        watermark = group.getCurrentWatermarkMs() * 1000
        rows = [(key[0], *a, *b) for _, a, b in state.advance(watermark)]
        if state.pending or state.right:
            group.update((pickle.dumps(state),))
            horizon = (state.pending[0][0] + tolerance if state.pending else state.right[-1][0] + 2 * tolerance) // 1000 + 1
            group.setTimeoutTimestamp(max(horizon, group.getCurrentWatermarkMs() + 1))
        else:
            group.remove()
        yield pd.DataFrame(rows, columns=out.names)

    return both.groupBy("e", "slice").applyInPandasWithState(step, out, T.StructType([T.StructField("state", T.BinaryType())]), "append", GroupStateTimeout.EventTimeTimeout)
