import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.operators.nested import OBJECT, BrokenRecord, FlatTable, events, fields_to_columns, flatten, flatten_record, triples

TABLES = [FlatTable("records", ""), FlatTable("entries", "a.b|c.*"), FlatTable("notes", "a.b|c.*.notes.[]")]
JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4), x, max_size=3), max_leaves=12)


def _build(text):
    stack, out = [], None
    for kind, path, value in events(text):
        if kind == "close":
            done = stack.pop()
        else:
            done = ({} if value == "{" else []) if kind == "open" else value
        if kind == "open":
            stack.append(done)
            continue
        if not path:
            out = done
        elif isinstance(path[-1], int):
            stack[-1].append(done)
        else:
            stack[-1][path[-1]] = done
    return out


def _text(x):
    return {k: _text(v) for k, v in x.items()} if isinstance(x, dict) else [_text(v) for v in x] if isinstance(x, list) else x if x is None or isinstance(x, str) else json.dumps(x)


@settings(max_examples=200, deadline=None)
@given(JSON, st.sampled_from([None, 1]))
def test_events_rebuild_any_record(value, indent):
    assert _build(json.dumps(value, indent=indent)) == _text(value)


@settings(max_examples=200, deadline=None)
@given(JSON, st.integers(0, 30))
def test_cut_records_are_broken_just_when_json_says_so(value, cut):
    text = json.dumps(value)[: -cut or None]
    try:
        json.loads(text)
        valid = True
    except ValueError:
        valid = False
    try:
        list(events(text))
        assert valid
    except BrokenRecord:
        assert not valid


@pytest.mark.parametrize("text", ["", " ", "[1,]", '{"a":1,}', "{1:2}", "[1 2]", "01", "1.", "NaN", "tru", '"\t"', '"\\x"', "{}{}", "[", "]"])
def test_broken(text):
    with pytest.raises(BrokenRecord):
        list(events(text))


def test_triples():
    got = list(triples('{"a": [{"b": 1}, {"b": null}]}'))
    assert got == [((), OBJECT, None), (("a", 0), OBJECT, 1), (("a", 0, "b"), "1", 1), (("a", 1), OBJECT, 2), (("a", 1, "b"), None, 2)]


def test_fields_handed_down():
    tables = [FlatTable("entries", "a.*", ("date",)), FlatTable("notes", "a.*.notes.[]")]
    rows = flatten_record('{"a": {"k": {"notes": [{"t": 1}], "Date": "x"}, "l": {"notes": [{}]}}}', tables)
    assert [r["fields"] for r in rows if r["table_name"] == "notes"] == [{"t": "1", "../date": "x", "../map_key": "k", "../section": "a"}, {"../map_key": "l", "../section": "a"}]


def test_tables():
    text = '{"n": 1, "A": {"b": {"k1": {"Date": "x", "date": "y", "notes": [3, {"t": {"u": "v"}}, {"t": null}]}, "k2": 5}, "c": [{"q": "1"}, null, {"q": 2}]}}'
    rows = flatten_record(text, TABLES)
    got = [(r["table_name"], r["row_key"], r["parent_key"], r["section"], r["map_key"], r["ordinal"]) for r in rows]
    assert got == [
        ("records", "", "", "", None, 1),
        ("entries", "/A.b#1", "", "a.b", "k1", 1),
        ("notes", "/A.b#1/notes#1", "/A.b#1", "a.b.notes", None, 1),
        ("notes", "/A.b#1/notes#2", "/A.b#1", "a.b.notes", None, 2),
        ("entries", "/A.c#1", "", "a.c", None, 1),
        ("entries", "/A.c#2", "", "a.c", None, 2),
    ]
    assert rows[1]["fields"]["date"] == "x" and rows[2]["fields"] == {"t.u": "v"} and rows[5]["fields"] == {"q": "2"}
    assert flatten_record("[" * 50_000, TABLES) is None
    assert len(flatten_record("[" * 5_000 + "]" * 5_000, TABLES)) == 0


def test_flatten(spark):
    rows = [(1, '{"a": {"b": [{"v": 1}, {"v": 2, "notes": [{"t": 3}]}]}}', "extra"), (2, None, None), (3, '{"a": ', "x"), (None, '{"a": {"b": [{"v": 9}]}}', "y"), (1, '{"a": {"b": [{"v": 1}]}}', "again")]
    df = spark.createDataFrame(rows, "id long, data string, fields string")
    out = flatten(df, "data", ["id"], TABLES)
    entries = fields_to_columns(out, "entries", {"v": "v"})
    assert sorted(((r.id, r.row_key, r.v) for r in entries.collect()), key=str) == sorted([(1, "/a.b#1", "1"), (1, "/a.b#2", "2"), (None, "/a.b#1", "9"), (1, "/a.b#1", "1")], key=str)
    assert flatten(df.limit(0), "data", ["id"], TABLES).count() == 0


@pytest.mark.parametrize("key", ["a\\q", "\\u12", "\\u00zz", "\\x41"])
def test_keys_with_broken_escapes(spark, key):
    broken = '{"a": {"b": {"x": 1}}, "' + key + '": 2}'
    with pytest.raises(BrokenRecord):
        list(events(broken))
    assert flatten_record(broken, TABLES) is None
    df = spark.createDataFrame([(1, broken), (2, '{"a\\n": 1}')], "id long, body string")
    assert [(r.id, r.fields) for r in flatten(df, "body", ["id"], TABLES).collect()] == [(2, {"a\n": "1"})]
