"""Consolidating pairwise matches into groups: union-find within partitions, spanning forests, hierarchical merges."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.operators.materialize import discard, materialize

#: Edges one task takes into memory.
EDGES_PER_TASK = 1_000_000


def spanning_forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union-find over edges: every node but the least of its component, and that least node."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))
    n = len(a)
    for x, y in zip(ends[:n].tolist(), ends[n:].tolist(), strict=True):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x < y:
            parent[y] = x
        elif y < x:
            parent[x] = y
    roots = np.array(parent, dtype=np.int64)
    while True:  # roots are least, so parents only get smaller
        up = roots[roots]
        if (up == roots).all():
            break
        roots = up
    keep = roots != np.arange(len(nodes))
    return nodes[keep], nodes[roots[keep]]


def _forests(edges: DataFrame, parts: int, by: tuple[str, ...]) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frames = [(f["a"].to_numpy(), f["b"].to_numpy()) for f in batches]
        if frames:
            a, b = spanning_forest(*(np.concatenate(x) for x in zip(*frames, strict=True)))
            yield pd.DataFrame({"a": a, "b": b})

    return edges.repartition(parts, *by).mapInPandas(run, "a long, b long")


def _contracted(edges: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Merges about every fourth node or more into a neighbour, whatever the shape of the graph: a coin is thrown for each node
    and level, and nodes of one side follow their least neighbour of the other.  Returns who follows whom, and the edges left."""
    coin = lambda c: F.pmod(F.xxhash64(F.lit(level), c), F.lit(2)) == 0
    ends = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    moves = materialize(ends.filter(coin("a") & ~coin("b")).groupBy("a").agg(F.min("b").alias("to")), "moves")
    kept = edges
    for end in ("a", "b"):
        kept = kept.join(moves.select(F.col("a").alias(end), "to"), end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return moves, kept.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(edges: DataFrame, a: str, b: str, edges_per_task: int = EDGES_PER_TASK) -> DataFrame:
    """``node`` and ``component`` (the least node linked to it) for every node of an edge that links two different nodes.

    Edges are cut into partitions of about ``edges_per_task``; union-find keeps only the spanning forest of each.  As long as the
    forests together are more than one task takes, they are merged: part of their nodes is contracted into neighbours, so that
    edges of different partitions meet, and the next level starts over with what is left, at least a quarter of the nodes fewer
    (on average).  The last level is one partition.  Labels then go back down the levels, a join each; work and shuffle form a
    geometric series.  Every level is written to the shared folder.  NULL ends link nothing; loops and repeated edges change nothing.
    """
    pairs = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).dropna().filter("a <> b")
    # Partial distinct on the map side: a hot pair is sent once per task.
    current = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    moved: list[DataFrame] = []
    while True:
        count = current.count()
        parts = max(1, math.ceil(count / edges_per_task))
        forest = materialize(_forests(current, parts, ("a", "b")), "forest")
        discard(current)
        if parts == 1:
            break
        moves, left = _contracted(forest, len(moved))
        moved.append(moves)
        current = materialize(left, "edges")
        discard(forest)
    roots = forest.select("b").distinct()
    found = forest.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("component")))
    if not moved:
        return found
    for moves in reversed(moved):
        # A node that is followed but in no edge of the level above is the whole component there.
        followed = moves.join(found.withColumnRenamed("node", "to"), "to", "left").select(F.col("a").alias("node"), F.coalesce("component", "to").alias("component"))
        alone = moves.select(F.col("to").alias("node")).distinct().join(found, "node", "left_anti").select("node", F.col("node").alias("component"))
        found = materialize(found.unionByName(followed).unionByName(alone), "labels")
    least = found.groupBy("component").agg(F.min("node").alias("least"))
    return found.join(least, "component").select("node", F.col("least").alias("component"))


def links_by_shared_value(df: DataFrame, node: str, values: dict[str, F.Column]) -> DataFrame:
    """Edges (``a``, ``b``) that link each node to the least node with the same value, a star per value and never all pairs.

    ``values`` names the kinds of value; NULL values link nothing, and values of different kinds never meet."""
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in values.items()))
    held = df.select(F.col(node).cast("long").alias("a"), F.explode(kinds).alias("v")).select("a", "v.kind", "v.value").filter(F.col("value").isNotNull() & F.col("a").isNotNull()).distinct()
    least = held.groupBy("kind", "value").agg(F.min("a").alias("b"), F.max("a").alias("top")).filter("b < top").select("kind", "value", "b")
    return held.join(least, ["kind", "value"]).filter("a <> b").select("a", "b").distinct()
