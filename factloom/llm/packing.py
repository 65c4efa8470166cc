"""Filling containers of fixed capacity: first-fit decreasing with a tournament tree, in randomised groups of documents."""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pieces a group holds on average.
PIECES_PER_GROUP = 8192


class TournamentTree:
    """Free space of bins in order of their opening; each inner node knows the most of its subtree."""

    def __init__(self, capacity: int, bins: int) -> None:
        self.capacity, self.opened = capacity, 0
        self.leaves = 1 << max(1, (max(1, bins) - 1).bit_length())
        self.most = [0] * (2 * self.leaves)

    def place(self, size: int) -> int:
        """The first bin with room for ``size``, opening one if there is none."""
        at = 1
        if self.opened and self.most[1] >= size:
            while at < self.leaves:
                at *= 2
                if self.most[at] < size:
                    at += 1
            if at - self.leaves < self.opened:
                free = self.most[at] - size
            else:
                at = 1
        if at == 1:
            at = self.leaves + self.opened
            self.opened += 1
            free = self.capacity - size
        chosen = at - self.leaves
        self.most[at] = free
        while at > 1:
            at //= 2
            self.most[at] = max(self.most[2 * at], self.most[2 * at + 1])
        return chosen


def first_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """The bin (from 0) of each size, the largest placed first, equal sizes in the given order.  No size may exceed the capacity."""
    tree = TournamentTree(capacity, len(sizes))
    bins = [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        bins[i] = tree.place(sizes[i])
    return bins


def pack(items: DataFrame, keys: list[str], size: str, capacity: int, pieces_per_group: int = PIECES_PER_GROUP, seed: int = 0) -> DataFrame:
    """``keys``, ``piece_no`` (from 0), ``piece_start``, ``piece_size`` and ``container_id`` of each item or its pieces.

    An item beyond the capacity is split: pieces of exactly the capacity, each a full container, and the rest, which is packed
    like an item.  Items fall into groups by a hash of their keys, so a group has about ``pieces_per_group`` pieces at any
    number of items and repeated items with different keys spread over groups; each group is packed by first-fit decreasing.
    NULL sizes count as 0; a size of 0 takes part like any other.  Ties are packed in the order of the keys.  Empty input gives an empty
    result.  The number of groups comes from the number of rows; ``keys`` should be unique.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    groups = max(1, math.ceil(items.count() / pieces_per_group))
    total = F.coalesce(F.col(size), F.lit(0)).cast("long")
    rows = items.select(*keys, total.alias("__size"), F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(groups)).alias("__group"))
    n_full = F.floor(F.col("__size") / capacity).cast("int")
    full = rows.filter(n_full > 0).select(*keys, F.explode(F.sequence(F.lit(0), n_full - 1)).alias("piece_no"))
    full = full.select(
        *keys, F.col("piece_no").cast("long").alias("piece_no"), (F.col("piece_no").cast("long") * capacity).alias("piece_start"), F.lit(capacity).cast("long").alias("piece_size"),
        F.concat_ws("-", F.lit("f"), *(F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in keys), F.col("piece_no").cast("string")).alias("container_id"),
    )
    rest = rows.filter((F.col("__size") % capacity != 0) | (F.col("__size") == 0)).select(*keys, n_full.cast("long").alias("piece_no"), (n_full.cast("long") * capacity).alias("piece_start"), (F.col("__size") % capacity).alias("piece_size"), "__group")
    out = full.schema

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece_size", *keys], ascending=[False, *[True] * len(keys)], kind="stable")
        bins = first_fit_decreasing(frame["piece_size"].tolist(), capacity)
        group = frame["__group"].iloc[0]
        return frame.assign(container_id=[f"g{group}-{b}" for b in bins])[out.names]

    return full.unionByName(rest.groupBy("__group").applyInPandas(run, out))


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


#: How texts are cut into words before byte pairs are merged; the usual pattern of byte-level vocabularies (fixed value).
WORD_PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def count_tokens(df: DataFrame, keys: list[str], text: str, ranks_path: str, pattern: str = WORD_PATTERN) -> DataFrame:
    """``keys`` and ``n_tokens`` of whole texts, by a file of byte-pair ranks present on every machine; NULL gives 0."""
    schema = df.select(*keys).schema.add("n_tokens", "long")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(ranks_path, pattern)
        for batch in batches:
            counts = [len(encoder.encode_ordinary(t)) if isinstance(t, str) else 0 for t in batch["__text"]]
            yield batch.drop(columns="__text").assign(n_tokens=counts)

    return df.select(*keys, F.col(text).alias("__text")).mapInPandas(run, schema)
