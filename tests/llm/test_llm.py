import math
import random
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.llm import leakage
from factloom.llm.components import components, links_by_shared_value, spanning_forest
from factloom.llm.leakage import Coder, ItemIndex, judge, leaked_items, leaks_of
from factloom.llm.nearest import NearestState, join_nearest, nearest_in_time, stream_nearest
from factloom.llm.packing import count_tokens, first_fit_decreasing, pack
from factloom.llm.quantiles import bucket_counts, merge_counts, percentiles
from factloom.llm.truncation import truncated_texts


# nearest time


def _brute(lefts, rights, tol):
    out = {}
    for e, t in lefts:
        near = [(abs(rt - t), rt, p, v) for re, rt, p, v in rights if re == e and abs(rt - t) <= tol]
        if near:
            out[(e, t)] = min(near)[3]
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=20), st.lists(st.tuples(st.integers(0, 60), st.integers(0, 1)), max_size=20, unique=True))
def test_state_in_any_interleaving(lefts, rights):
    state, out = NearestState(5), {}
    for t, is_left, p in sorted([(t, True, 0) for t in lefts] + [(t, False, p) for t, p in rights]):
        state.add_left(t, t) if is_left else state.add_right(t, p, (t, p))
        out |= {("e", x): v for x, _, v in state.advance(t)}
        assert all(r[0] >= t - 15 for r in state.right)
    out |= {("e", x): v for x, _, v in state.advance(None)}
    assert out == _brute([("e", t) for t in lefts], [("e", t, p, (t, p)) for t, p in rights], 5)


def test_nearest_tables(spark):
    rng = random.Random(1)
    lefts = [(i, rng.choice(["a", "b", "hot", "hot", "hot", None]), rng.choice([None, *range(400)])) for i in range(500)]
    rights = [(e, t, p, f"{e}{t}{p}") for e in ("a", "hot") for t in range(0, 400, 13) for p in (0, 1) if rng.random() < 0.7] + [(None, 3, 0, "n"), ("a", None, 0, "n")]
    left, right = spark.createDataFrame(lefts, "id long, e string, t long"), spark.createDataFrame(rights, "e string, rt long, p long, v string")
    want = _brute([(e, t) for _, e, t in lefts if e and t is not None], [r for r in rights if r[0] and r[1] is not None], 4)
    assert {(r.e, r.t): r.v for r in nearest_in_time(left, right, "e", "t", "rt", 4, ["v"], "p").collect()} == want
    joined = join_nearest(left, right, "e", "t", "rt", 4, ["v"], "p").collect()
    assert sorted((r.id, r.v) for r in joined) == sorted((i, want[(e, t)]) for i, e, t in lefts if (e, t) in want)
    assert nearest_in_time(left.limit(0), right, "e", "t", "rt", 4, ["v"], "p").count() == 0
    assert nearest_in_time(left, right.limit(0), "e", "t", "rt", 4, ["v"], "p").count() == 0


def test_nearest_stream(spark, tmp_path):
    at = lambda m, s=0: datetime(2026, 1, 1, 0, m, s)
    for i, (ls, rs) in enumerate([([(1, "a", at(1)), (2, "a", at(2))], [("a", at(1, 20), "x")]), ([(3, "b", at(20))], [("a", at(2, 10), "y")]), ([(4, "c", at(50))], [("c", at(49, 30), "z")]), ([(5, "c", at(59))], [])]):
        spark.createDataFrame(ls, "id long, e string, t timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/l/{i}")
        spark.createDataFrame(rs, "e string, rt timestamp, v string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/r/{i}")
    read = lambda side, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{side}/*")
    left, right = read("l", "id long, e string, t timestamp"), read("r", "e string, rt timestamp, v string").withColumn("p", F.lit(0))
    out = stream_nearest(left, right, "e", "t", "rt", "1 minutes", 60, ["id"], ["v"], "p")
    q = out.writeStream.format("memory").queryName("nearest_out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(300)
    got = {r.id: r.v for r in spark.table("nearest_out").collect()}
    assert got.get(1) == "x" and set(got.items()) <= {(1, "x"), (2, "y"), (4, "z")}


# components


def _components(pairs):
    group = {}
    for a, b in pairs:
        ga, gb = group.setdefault(a, {a}), group.setdefault(b, {b})
        if ga is not gb:
            ga |= gb
            for x in gb:
                group[x] = ga
    return {x: min(g) for x, g in group.items()}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=60))
def test_spanning_forest(pairs):
    a, b = (np.array(x, dtype=np.int64) for x in zip(*pairs, strict=True))
    nodes, roots = spanning_forest(a, b)
    want = _components(pairs)
    assert dict(zip(nodes.tolist(), roots.tolist(), strict=True)) == {x: m for x, m in want.items() if x != m}


@pytest.mark.parametrize("bound", [10**6, 40, 12])
def test_components(spark, bound):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 8), (7, 8)]
    df = spark.createDataFrame([*pairs, (None, 1), (2, None)], "x long, y long")
    got = {r.node: r.component for r in components(df, "x", "y", bound).collect()}
    want = _components([p for p in pairs if p[0] != p[1]])
    assert got == want
    assert components(df.limit(0), "x", "y").count() == 0


def test_links(spark):
    df = spark.createDataFrame([(3, "a", "q"), (1, "a", None), (2, None, "q"), (2, None, "q"), (9, "q", None), (None, "a", "q")], "id long, u string, v string")
    assert sorted((r.a, r.b) for r in links_by_shared_value(df, "id", {"u": F.col("u"), "v": F.col("v")}).collect()) == [(3, 1), (3, 2)]


# percentiles


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e9, 1e9, allow_subnormal=False) | st.sampled_from([0.0, float("nan"), float("inf"), None]), max_size=80))
def test_percentiles(spark, values):
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(values)], "day long, v double").withColumn("g", F.lit("g"))
    daily = bucket_counts(df, ["g", "day"], F.col("v"), 0.01)
    out = percentiles(merge_counts(daily, ["g"]), ["g"], {"p50": 0.5, "p90": 0.9}, 0.01).collect()
    counted = sorted(v for v in values if v is not None and math.isfinite(v))
    assert len(out) == bool(counted)
    for r in out:
        assert r.n == len(counted)
        for got, q in ((r.p50, 0.5), (r.p90, 0.9)):
            want = counted[math.floor(q * (len(counted) - 1))]
            assert abs(got - want) <= 0.0100001 * abs(want)


# packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=60))
def test_first_fit(sizes):
    bins = first_fit_decreasing(sizes, 20)
    used = {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        first = next((b for b in range(len(used)) if used[b] + sizes[i] <= 20), len(used))
        assert bins[i] == first
        used[first] = used.get(first, 0) + sizes[i]


def test_pack(spark):
    rng = random.Random(3)
    items = [(i, rng.choice([0, 5, 17, 50, 99, 100, 101, 250, 1000, None])) for i in range(400)] + [(None, 3)]
    df = spark.createDataFrame(items, "id long, n long").withColumn("container_id", F.lit("clash"))
    out = pack(df, ["id"], "n", 100, pieces_per_group=50).collect()
    used, sizes = {}, {}
    for r in out:
        used[r.container_id] = used.get(r.container_id, 0) + r.piece_size
        sizes.setdefault(r.id, []).append((r.piece_no, r.piece_start, r.piece_size))
    assert max(used.values()) <= 100
    for i, n in items:
        pieces = sorted(sizes[i])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and sum(p[2] for p in pieces) == (n or 0)
        assert all(p[2] == 100 for p in pieces[:-1]) and [p[1] for p in pieces] == [100 * k for k in range(len(pieces))]
    assert sum(used.values()) / (100 * len(used)) > 0.9
    assert pack(df.limit(0), ["id"], "n", 100).count() == 0


def test_tokens(spark, tmp_path):
    import base64

    (tmp_path / "r").write_bytes(b"\n".join(base64.b64encode(bytes([i])) + b" %d" % i for i in range(256)))
    df = spark.createDataFrame([(1, "abc d"), (2, ""), (3, None), (4, "x" * 50_000)], "id long, t string")
    assert {r.id: r.n_tokens for r in count_tokens(df, ["id"], "t", str(tmp_path / "r")).collect()} == {1: 5, 2: 0, 3: 0, 4: 50_000}


# leakage

ITEM = "With 5331 perpetual pledges at hand, Veilbrixia insured its canal and again renewed USD 30.8 of licence. Each nominal rebate audited by Veilbrixia carries a depot worth 48.4 EUR, seldom split in August."


def _leaks(spark, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    items = spark.createDataFrame([(7, ITEM), (8, "too short"), (9, None)], "item_id long, text string")
    return sorted((r.doc_id, r.item_id, r.kind) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect())


def test_leaks(spark):
    w = ITEM.split()
    changed = list(w)
    changed[4] = changed[14] = changed[24] = "other"
    reworded = ITEM.replace("Veilbrixia", "Kelby").replace("5331", "12").replace("30.8", "7").replace("USD", "GBP").replace("48.4", "9").replace("EUR", "SEK")
    mixed = "x " + ITEM.upper().replace(" ", "\n> ") + " y"
    got = _leaks(spark, [ITEM, " ".join(w[:20]), " ".join(w[:19]) + " and more of this", " ".join(changed), mixed, reworded.replace("Kelby", "Veilbrixia", 0), "", None, "word " * 30_000, ITEM])
    assert (0, 7, "passage") in got and (1, 7, "passage") in got and (3, 7, "passage") in got and (4, 7, "passage") in got and (9, 7, "passage") in got
    assert not any(d in (2, 6, 7, 8) for d, _, _ in got)
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert leaked_items(docs, "doc_id", "text", spark.createDataFrame([(7, ITEM)], "item_id long, text string"), "item_id", "text").count() == 0


def test_leaks_of_other_names(spark):
    reworded = ITEM.replace("Veilbrixia", "Kelby").replace("5331", "12").replace("30.8", "7").replace("USD", "GBP").replace("48.4", "9").replace("EUR", "SEK")
    lower = ITEM.lower().replace("5331", "12")
    got = _leaks(spark, [reworded, "In short: \n> " + reworded.replace(" ", "\n> "), reworded.upper(), ITEM.upper(), lower, ITEM.replace("canal", "Canal"), " ".join(reworded.split()[:19])])
    assert got == [(0, 7, "reworded"), (1, 7, "reworded"), (2, 7, "reworded"), (3, 7, "passage"), (4, 7, "passage"), (5, 7, "passage")]


def _judged(doc, item, least, per):
    coder = Coder(frozenset())
    d, t = (coder.read([x])[0] for x in (doc, item))
    return judge(d, t, least, per)


def test_slots():
    assert _judged("a 5 b 6 c 5 d 7", "a 1 b 2 c 1 d 3", 8, 10) == (False, True, 1)
    assert _judged("a 5 b 6 c 4 d 7", "a 1 b 2 c 1 d 3", 8, 10)[1] is False


def test_slot_of_a_value_seen_twice():
    assert _judged("5 a 5 b 6 c", "1 a 1 b 1 c", 5, 10)[1] is False
    assert _judged("5 a 5 b 5 c", "1 a 1 b 1 c", 5, 10)[1] is True


def test_words_around_a_shorter_overlap():
    item = " ".join(f"w{i}x" for i in range(40)).split()
    near = lambda keep: " ".join(w if i in keep else f"o{i}" for i, w in enumerate(item))
    sixteen = set(range(5, 21))
    # Single words and pairs beyond other ones don't lengthen sixteen words, three words do.
    assert _judged(near(sixteen | {22, 24, 25}), " ".join(item), 20, 10)[0] is False
    assert _judged(near(sixteen | {22, 23, 24}), " ".join(item), 20, 10)[0] is True
    assert _judged(near(set(range(5, 25))), " ".join(item), 20, 10)[0] is True
    assert _judged(near(set(range(5, 38)) - {9, 20, 30}), " ".join(item), 20, 10)[0] is True


VOWELS, WORDS = "aeiou", "the of a in depot credit audit canal crate delayed minor carrying sold with by after before charter reserve and holds under note".split()


def _sentence(rng, n):
    """Words with names, numbers and units at fixed places, and the same with other values in the slots."""
    name = lambda: "".join(rng.choice("bdkmrtv") + rng.choice(VOWELS) for _ in range(3)).capitalize()
    a, b, x, y = name(), name(), rng.randrange(100, 9999), rng.randrange(2, 99) / 10
    words = [rng.choice(WORDS) for _ in range(n)]
    slots = {5: "{a}", 9: "{x}", 14: "{u}", 13: "{y}", 20: "{a}", 26: "{b}", 31: "{x}"}
    t = " ".join(slots.get(i, w) for i, w in enumerate(words))
    other = {"a": name(), "b": name(), "x": rng.randrange(10_000, 99_999), "y": rng.randrange(101, 999) / 10, "u": "SEK"}
    return t.format(a=a, b=b, x=x, y=y, u="EUR"), t.format(**other), t.format(**(other | {"a": other["b"]})).replace(other["b"], other["a"], 1)


def test_reworded_copies_are_found():
    rng = random.Random(5)
    items, copies, crossed = zip(*(_sentence(rng, 40) for _ in range(200)), strict=True)
    noise = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(60)))
    index = ItemIndex(list(items))
    found = leaks_of([f"{noise()}. {c} {noise()}" for c in copies], index, Coder(index.names), 20, 10)
    assert all(kind == "reworded" for _, _, kind, _ in found)
    assert {d for d, i, _, _ in found if d == i} >= set(range(180)) and len(found) < 220
    # Held against itself, every item is a passage.
    assert {(d, i) for d, i, kind, _ in leaks_of(list(items), index, Coder(index.names), 20, 10) if kind == "passage"} == {(i, i) for i in range(200)}


def test_blocks_and_parts_change_nothing(spark, monkeypatch):
    rng = random.Random(6)
    items = [" ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(25, 60))) for _ in range(12)]
    docs = [f"{rng.choice(items)[rng.randrange(30):]} x" + " ".join(rng.choice(WORDS[:6]) for _ in range(rng.randrange(200))) for _ in range(60)] + [None, ""]
    d = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    t = spark.createDataFrame([(f"i{k}", x) for k, x in enumerate(items)], "item_id string, text string")
    whole = leaked_items(d, "doc_id", "text", t, "item_id", "text").collect()
    assert whole and sorted(whole) == sorted(leaked_items(d, "doc_id", "text", t, "item_id", "text", block_bytes=500).collect())
    index = ItemIndex(items)
    once = leaks_of(docs, index, Coder(index.names), 20, 10)
    monkeypatch.setattr(leakage, "PAIRS_AT_ONCE", 50)
    monkeypatch.setattr(leakage, "WORDS_AT_ONCE", 100)
    monkeypatch.setattr(leakage, "SPELLINGS", 5)
    assert sorted(once) == sorted(leaks_of(docs, index, Coder(index.names), 20, 10))
    # Brute force over all offsets.
    coder, want = Coder(index.names), set()
    for i, doc in enumerate(docs):
        for k, item in enumerate(items):
            (a, _), (b, _) = coder.read([doc or ""]), coder.read([item])
            for off in range(20 - len(b), len(a) - 19):
                lo, hi = max(0, off), min(len(a), off + len(b))
                if judge(a[lo:hi], b[lo - off : hi - off], 20, 10)[0]:
                    want.add((i, k))
    assert {(i, k) for i, k, kind, _ in once if kind == "passage"} == want


# truncation


def test_truncated(spark):
    rng = random.Random(4)
    nouns, verbs = ["net debt", "gross margin", "book value", "order backlog"], ["rose", "fell", "held"]
    line = lambda: f"After the {rng.choice(['sale', 'move', 'audit'])} of a depot, {rng.choice(nouns)} {rng.choice(verbs)} by {rng.randrange(99)}.{rng.randrange(9)} percent of sales."
    texts = []
    for _ in range(400):
        texts.append(" ".join(line() for _ in range(6)) + rng.choice(["", "", "", "\n\n- Mild net debt\n- Late revenue", "\n\nPrepared by: desk 12, Felden", "  \n"]))
    full = line()
    cuts = [" ".join([line(), full[: full.index("depot") + 5]]), line() + " After the sale of a de", line() + " After the move of…", line() + " After the audit of a depot, net debt fell by 29.", line() + " After the sale of [cont"]
    rows = [(i, t, "s") for i, t in enumerate(texts + cuts)] + [(9000, None, "s"), (9001, "", None), (9002, "...", "s")]
    docs = spark.createDataFrame(rows, "id long, text string, source string")
    got = {r.doc_id: r.is_cut for r in truncated_texts(docs, "id", "text", "source").collect()}
    assert sum(got[i] for i in range(400)) == 0
    assert all(got[400 + i] for i in range(len(cuts)))
    assert not got[9000] and not got[9001] and not got[9002]
    assert truncated_texts(docs.limit(0), "id", "text", "source").count() == 0


def test_unrelated_texts_change_no_verdict(spark):
    rng = random.Random(7)
    line = lambda: f"After the {rng.choice(['sale', 'move', 'audit'])} of a depot, net debt {rng.choice(['rose', 'fell'])} by {rng.randrange(99)}.5 percent of sales."
    texts = [" ".join(line() for _ in range(4)) + rng.choice(["", "", "\n\nPrepared by: desk 12, Felden", "\n\n*** END ***"]) for _ in range(60)] + [line() + " After the sa", line() + " After the move of"]
    other = ["Une autre phrase sans rapport, la suite manque encore ici." for _ in range(500)] + [f"Nothing of number {i} recurs here." for i in range(500)]
    judged = lambda ts: {r.doc_id: r.evidence for r in truncated_texts(spark.createDataFrame([(i, t, "s") for i, t in enumerate(ts)], "id long, text string, source string"), "id", "text", "source").collect()}
    alone, among = judged(texts), judged(texts + other)
    assert {i: among[i] for i in alone} == alone


def test_truncated_items(spark):
    whole = ["Late revenue", "Mild net debt", "Debt of the old depot", "Debt to banks", "High debt ratio"]
    texts = [f"The audit held.\n\n- {whole[i % 5]}\n- {whole[i // 5 % 5]}\n- {whole[i // 25 % 5]}" for i in range(250)]
    # Two items end in "old" and "high", words that are inside items elsewhere.
    texts += ["The audit held.\n\n- Late and old\n- Rather high\n- Late revenue"] * 2
    cuts = [f"The audit held.\n\n- {x}" for x in ("Late revenue\n- Debt", "Late revenue\n- Debt of the old", "Mild net debt\n- High", "High debt")]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts + cuts)], "id long, text string, source string")
    got = {r.doc_id: r.is_cut for r in truncated_texts(docs, "id", "text", "source").collect()}
    assert [i for i in range(len(texts)) if got[i]] == []
    assert all(got[len(texts) + i] for i in range(len(cuts)))


def test_leaks_of_ever_the_same_words(spark):
    docs = spark.createDataFrame([(1, "word " * 30_000), (2, "word " * 19), (3, "word " * 25 + "end"), (4, "a b " * 40)], "doc_id long, text string")
    items = spark.createDataFrame([(7, "word " * 5_000), (8, "a b " * 10 + "c d e f"), (9, "the word " * 30)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").filter("kind = 'passage'").collect()}
    assert got == {(1, 7), (3, 7), (4, 8)}


def test_reworded_rows_of_numbers(spark):
    docs = spark.createDataFrame(
        [(1, " ".join(f"row {i + 20} of {i + 80}" for i in range(10))), (2, "and " * 7 + " ".join(f"row {i} of {i * i}" for i in range(3, 30))), (3, " ".join(f"row {i} of {i} or" for i in range(10)))], "doc_id long, text string"
    )
    items = spark.createDataFrame([(7, " ".join(f"row {i} of {i + 50}" for i in range(10))), (8, "row 1 of 2 " * 10)], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.kind) for r in leaked_items(docs, "doc_id", "text", items, "item_id", "text").collect())
    assert got == [(1, 7, "reworded"), (2, 7, "reworded")]
