"""Evaluation texts leaking into training text, by template windows.

Both sides become words; numbers, names and units become typed placeholders, so a window of words is a template.  A name is told
by its own form on each side, a capital at its start; as copies may differ in case, each window also comes with only the names
that the test items show inside their sentences.  Windows of documents are looked up in the hash table of the windows of the test
items; pairs that share enough windows at one offset are aligned and checked word by word.  Where only placeholders differ, the
slots must map consistently: those are re-parameterised copies.

Test items are a stated query set.  Their index goes to every task in blocks of checked size, so documents are read, cut into words
and checked where they are, once for each block, and nothing but the leaks is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words per template window.
WINDOW = 5
#: A span begins and ends with this many equal words at least.
END_RUN = 3
#: Bytes of item text in one block; an index takes about ten times as much.
BLOCK_BYTES = 8_000_000
#: Words of documents looked at together.
WORDS_AT_ONCE = 500_000
#: Pairs of equal windows that are counted together.
PAIRS_AT_ONCE = 4_000_000
#: Spellings of words that a task remembers.
SPELLINGS = 500_000

#: Words that say a unit (fixed values).
UNIT_WORDS = frozenset("aud cad chf cny eur gbp ils inr jpy sek usd zar percent pct euro euros dollar dollars pounds yen bn mn".split())

PLAIN, NUMBER, UNIT, NAME = range(4)
_OTHER = re.compile(r"[\W_]+")
_NAMES = re.compile(r"(?<=[a-zà-ÿ0-9,] )([A-ZÀ-Þ][a-zà-ÿ]+)")


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word) - (1 << 63)


_SLOT = {NUMBER: _hash("\0n"), UNIT: _hash("\0u"), NAME: _hash("\0@")}


class Coder:
    """Words by white space, in lower case and without anything but letters and digits, as numbers: the word, its template
    with the listed names, its template with names by form, and its kind."""

    def __init__(self, names: frozenset[str]) -> None:
        self.names = names
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.table: list[tuple[int, int, int, int]] = [(0, 0, 0, PLAIN)]

    def _add(self, spelling: str) -> int:
        bare = _OTHER.sub("", spelling)
        word = bare.lower()
        if not word:
            at = 0
        else:
            kind = NUMBER if "0" <= word[0] <= "9" else UNIT if word in UNIT_WORDS else NAME if word in self.names else PLAIN
            form = NAME if kind == PLAIN and bare[0].isupper() else kind
            own = _hash(word)
            at = len(self.table)
            self.table.append((own, _SLOT.get(kind, own), _SLOT.get(form, own), form))
        self.known[spelling] = at
        return at

    def read(self, texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
        """Rows (word, template, template by form, kind) of all words of some texts, and where each text starts (and the end)."""
        if len(self.table) > SPELLINGS:
            self.forget()
        known, add = self.known, self._add
        codes, ends = [], [0]
        for text in texts:
            for w in text.split():
                at = known.get(w)
                codes.append(add(w) if at is None else at)
            ends.append(len(codes))
        at = np.array(codes, dtype=np.int64)
        kept = at > 0
        starts = np.concatenate([[0], np.cumsum(kept)])[ends]
        return np.array(self.table, dtype=np.int64)[at[kept]], starts


def windows(templates: np.ndarray) -> np.ndarray:
    """A hash of each run of ``WINDOW`` templates."""
    n = max(0, len(templates) - WINDOW + 1)
    out = np.zeros(n, dtype=np.int64)
    with np.errstate(over="ignore"):
        for k in range(WINDOW):
            out = (out ^ templates[k : k + n]) * np.int64(0x5851F42D4C957F2D)
            out ^= out >> np.int64(29)
    return out


class ItemIndex:
    """The words of a block of test items and the sorted hashes of their windows."""

    BITS = 22

    def __init__(self, texts: list[str]) -> None:
        self.names = frozenset(m.lower() for t in texts for m in _NAMES.findall(t))
        self.words, self.starts = Coder(self.names).read(texts)
        found = []
        for column in (1, 2):
            h = windows(self.words[:, column])
            at = np.arange(len(h))
            inside = at + WINDOW <= self.starts[np.searchsorted(self.starts, at, side="right")] if len(h) else at > 0
            found.append(np.stack([h[inside], at[inside]]))
        both = np.unique(np.concatenate(found, axis=1), axis=1)
        self.hashes, self.places = both[0], both[1]
        self.seen = np.zeros(1 << self.BITS, dtype=bool)
        self.seen[self._bit(self.hashes)] = True

    def _bit(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.int64(64 - self.BITS)) & np.int64((1 << self.BITS) - 1)

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of the hashes that are here, and the first and the last (excluded) of their places in the table."""
        maybe = np.flatnonzero(self.seen[self._bit(h)])
        first = np.searchsorted(self.hashes, h[maybe], side="left")
        last = np.searchsorted(self.hashes, h[maybe], side="right")
        there = last > first
        return maybe[there], first[there], last[there]


def offsets(index: ItemIndex, words: np.ndarray, starts: np.ndarray, shared: int) -> Iterator[tuple[int, int, int]]:
    """(text, item, offset) of all pairs with ``shared`` equal windows or more at one offset of the item in the text."""
    found = [index.hits(windows(words[:, column])) for column in (1, 2)]
    at, first, last = (np.concatenate(x) for x in zip(*found, strict=True))
    # A text's windows stay together, so every part can be counted by itself.
    order = np.argsort(at, kind="stable")
    at, first, last = at[order], first[order], last[order]
    text = np.searchsorted(starts, at, side="right") - 1
    inside = at + WINDOW <= starts[text + 1]
    at, first, last, text = at[inside], first[inside], last[inside], text[inside]
    pairs = np.concatenate([[0], np.cumsum(last - first)])
    if not len(at):
        return
    edges = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1], [True]]))
    k = 0
    while k < len(edges) - 1:
        stop = max(k + 1, int(np.searchsorted(pairs[edges], pairs[edges[k]] + PAIRS_AT_ONCE, side="right")) - 1)
        yield from _count(index, at, first, last, starts, text, edges[k], edges[stop], shared)
        k = stop


def _count(index, at, first, last, starts, text, begin, end, shared) -> Iterator[tuple[int, int, int]]:
    counts: dict | None = None
    keys, numbers = np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    width = len(index.words) + int((starts[1:] - starts[:-1]).max()) + 1
    items = len(index.starts)
    while begin < end:
        # One text alone may have more pairs than are counted together: its counts are added up.
        stop = begin + max(1, int(np.searchsorted(np.cumsum(last[begin:end] - first[begin:end]), PAIRS_AT_ONCE, side="right")))
        n = last[begin:stop] - first[begin:stop]
        which = np.repeat(first[begin:stop] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        place = index.places[which]
        item = np.searchsorted(index.starts, place, side="right") - 1
        t = np.repeat(text[begin:stop], n)
        offset = np.repeat(at[begin:stop], n) - starts[t] - (place - index.starts[item])
        key, number = np.unique((t * items + item) * width + offset + len(index.words), return_counts=True)
        if len(keys):
            keys, back = np.unique(np.concatenate([keys, key]), return_inverse=True)
            numbers = np.bincount(back, weights=np.concatenate([numbers, number])).astype(np.int64)
        else:
            keys, numbers = key, number
        begin = stop
    for key in keys[numbers >= shared].tolist():
        pair, offset = divmod(key, width)
        yield pair // items, pair % items, offset - len(index.words)


def longest_run(flags: np.ndarray) -> int:
    """The length of the longest run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return int((edges[1::2] - edges[::2]).max()) if len(edges) else 0


def judge(doc: np.ndarray, item: np.ndarray, least: int, per: int, slots: bool = True) -> tuple[bool, bool, int]:
    """Aligned words of both sides (rows as of ``Coder.read``): does a span of ``least`` words have at most one in ``per`` replaced;
    if not, is a span of as many words the same template with consistent slots; and the longest run of equal words.

    A span begins and ends with ``END_RUN`` equal words, so that a common word or two around a shorter overlap don't lengthen it."""
    n = len(doc)
    same = doc[:, 0] == item[:, 0]
    longest = longest_run(same)
    if n < least:
        return False, False, longest
    sums = np.concatenate([[0], np.cumsum(same)])
    # A span that passes has a stretch of ``least`` words with at most one more replaced than its share.
    if (sums[least:] - sums[:-least]).max() >= least - least // per - 1:
        # No longer span needs a look: where ``END_RUN`` neighbours are equal beyond ``least`` words of both its ends, one side
        # passes by itself, and without such neighbours one in ``END_RUN`` of the words between is replaced.
        opens = same.copy()
        for k in range(1, END_RUN):
            opens[:-k] &= same[k:]
            opens[-k:] = False
        closes = np.concatenate([np.zeros(END_RUN - 1, dtype=bool), opens[: n - END_RUN + 1]])
        most = n if per <= END_RUN else int(2 * least / (1 - END_RUN / per)) + 1
        for size in range(least, min(n, most) + 1):
            ends = opens[: n - size + 1] & closes[size - 1 :]
            if (ends & (sums[size:] - sums[: n - size + 1] >= size - size // per)).any():
                return True, False, longest
    filled = (doc[:, 3] == item[:, 3]) & (item[:, 3] != PLAIN)
    if not slots or longest_run(same | filled) < least:
        return False, False, longest
    # Slots: within the span, one value of the item stands for one value of the document.  Equal words fit in any case.
    start, values = 0, {}
    for i, (d, t, is_slot, fits) in enumerate(zip(doc[:, 0].tolist(), item[:, 0].tolist(), (item[:, 3] != PLAIN).tolist(), (same | filled).tolist(), strict=True)):
        if not fits:
            start, values = i + 1, {}
            continue
        if is_slot:
            value, last = values.get(t, (d, i))
            if value != d:
                # Behind the last place of the other value.
                start = max(start, last + 1)
            values[t] = (d, i)
        if i + 1 - start >= least:
            return False, True, longest
    return False, False, longest


def leaks_of(texts: list[str | None], index: ItemIndex, coder: Coder, least: int, per: int) -> list[tuple[int, int, str, int]]:
    """(text, item, kind, longest run) of some texts against a block of items."""
    out: dict[tuple[int, int], tuple[bool, bool, int]] = {}
    begin = 0
    while begin < len(texts):
        end, size = begin, 0
        while end < len(texts) and (size == 0 or size < 6 * WORDS_AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        words, starts = coder.read(t or "" for t in texts[begin:end])
        for text, item, offset in offsets(index, words, starts, least - WINDOW + 1 - WINDOW * (least // per)):
            leaked, reworded, run = out.get((begin + text, item), (False, False, 0))
            if leaked:
                continue
            d, t = words[starts[text] : starts[text + 1]], index.words[index.starts[item] : index.starts[item + 1]]
            first = max(0, offset)
            last = min(len(d), offset + len(t))
            # Behind one reworded copy only passages are of interest.
            found = judge(d[first:last], t[first - offset : last - offset], least, per, not reworded)
            out[begin + text, item] = (found[0], reworded or found[1], max(run, found[2]))
        begin = end
    return [(d, i, "passage" if leaked else "reworded", run) for (d, i), (leaked, reworded, run) in out.items() if leaked or reworded]


def item_blocks(items: DataFrame, item_id: str, text: str, most: int = BLOCK_BYTES) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of the items, each pair once, in blocks of at most ``most`` bytes of text (or one longer item)."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter(F.col("t").isNotNull()).distinct()
    ids, texts, size = [], [], 0
    for r in rows.toLocalIterator():
        more = len(r.t.encode())
        if texts and size + more > most:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.i)
        texts.append(r.t)
        size += more
    if texts:
        yield ids, texts


def leaked_items(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, least: int = 20, per: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``doc_id``, ``item_id``, ``kind`` ("passage" or "reworded") and ``longest_run`` of every document that holds a test item.

    passage: at least ``least`` consecutive words of the item with at most one word in ``per`` replaced; reworded: no passage, but
    as many words of its template with other values in consistent slots, names of either side by their form.  With ``r = least //
    per`` words replaced, a span of ``least`` words still shares ``least - 4 - 5 * r`` windows of 5 words at its offset, so pairs
    with fewer are left out and none is lost.  Items too short give nothing, as do NULL and blank texts; repeated rows count
    once.  All words of all documents are covered; a text with ever the same words is compared at every offset that shares enough.
    """
    if least - WINDOW + 1 - WINDOW * (least // per) < 1:
        raise ValueError("least is too small for so many replaced words")
    spark = docs.sparkSession
    schema = docs.select(F.col(doc_id).alias("d")).schema
    id_type = items.schema[item_id].dataType
    schema = schema.add("i", id_type).add("leaked", "boolean").add("longest_run", "long")
    out = spark.createDataFrame([], schema)
    for ids, texts in item_blocks(items, item_id, item_text, block_bytes):
        shared = spark.sparkContext.broadcast((ids, ItemIndex(texts)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, index = shared.value
            coder = Coder(index.names)
            for batch in batches:
                found = leaks_of(batch.column(1).to_pylist(), index, coder, least, per)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array([f[0] for f in found], type=pa.int64())), pa.array([ids[f[1]] for f in found], type=items_type),
                        pa.array([f[2] == "passage" for f in found], type=pa.bool_()), pa.array([f[3] for f in found], type=pa.int64()),
                    ],
                    names=["d", "i", "leaked", "longest_run"],
                )

        from pyspark.sql.pandas.types import to_arrow_type

        items_type = to_arrow_type(id_type)
        out = out.unionByName(docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).mapInArrow(run, schema))
    best = out.groupBy("d", "i").agg(F.max("leaked").alias("leaked"), F.max("longest_run").alias("longest_run"))
    return best.select(F.col("d").alias(doc_id), F.col("i").alias(item_id), F.when(F.col("leaked"), "passage").otherwise("reworded").alias("kind"), "longest_run")
