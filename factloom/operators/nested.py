"""Deeply nested records to related flat tables.

Each text is parsed as a stream into path-value-ordinal triples, one for each scalar and one for each object that begins.  Triples
are grouped by their nearest repeated ancestor and every group is pivoted into one row of its table, in the same pass over the
text.  All triples of a record are together in one task, so neither grouping nor pivoting shuffles, however large the table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TOKEN = re.compile(
    r'[ \t\n\r]*(?:([{}\[\],:])|("(?:[^"\\\x00-\x1f]|\\.)*")|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][-+]?\d+)?(?![\w.+-]))|(true|false|null)\b)'
)
_SPACE = re.compile(r"[ \t\n\r]*")

#: Step of a path: the key in an object (str) or the place in an array (int, from 0).
Path = tuple


class BrokenRecord(ValueError):
    """The text is not one valid JSON value."""


def _unquoted(string: str) -> str:
    """The text of a string or key."""
    try:
        return json.loads(string) if "\\" in string else string[1:-1]
    except ValueError as e:
        raise BrokenRecord(str(e)) from None


def events(text: str) -> Iterator[tuple[str, Path, str | None]]:
    """Parses a text without building a tree: ("open"|"close", path, "{"|"[") and ("value", path, text or None).

    Strings come without quotes, numbers and booleans as written, null as None.  Raises BrokenRecord where the text
    stops being JSON, so that what came before must be thrown away.  Depth costs memory for the path only.
    """
    path: list = []
    closers: list[str] = []
    place, end, want = 0, len(text), "value"
    while True:
        if want == "done":
            if _SPACE.match(text, place).end() != end:
                raise BrokenRecord("text after the value")
            return
        m = _TOKEN.match(text, place)
        if not m:
            raise BrokenRecord(f"at {place}")
        place = m.end()
        mark, string = m[1], m[2]
        if want == "key" or want == "key or close":
            if string is not None:
                path[-1] = _unquoted(string)
                m = _TOKEN.match(text, place)
                if not m or m[1] != ":":
                    raise BrokenRecord(f"no colon at {place}")
                place, want = m.end(), "value"
                continue
            if mark != "}" or want == "key":
                raise BrokenRecord(f"no key at {place}")
        elif want == "comma or close":
            if mark == ",":
                if closers[-1] == "]":
                    path[-1] += 1
                    want = "value"
                else:
                    want = "key"
                continue
            if mark != closers[-1]:
                raise BrokenRecord(f"no comma at {place}")
        elif mark in ("{", "["):
            yield "open", tuple(path), mark
            closers.append("}" if mark == "{" else "]")
            path.append(None if mark == "{" else 0)
            want = "key or close" if mark == "{" else "value or close"
            continue
        elif mark is None:
            value = _unquoted(string) if string is not None else None if m[4] == "null" else m[3] or m[4]
            yield "value", tuple(path), value
            want = "comma or close" if closers else "done"
            continue
        elif mark != "]" or want != "value or close":
            raise BrokenRecord(f"no value at {place}")
        closers.pop()
        path.pop()
        yield "close", tuple(path), mark
        want = "comma or close" if closers else "done"


#: The value of a triple where an object begins.
OBJECT = object()


def triples(text: str) -> Iterator[tuple[Path, object, int | None]]:
    """Path, value and ordinal (from 1, of the innermost array; None outside of arrays) of every scalar and every object."""
    for kind, path, value in events(text):
        if kind == "value" or value == "{" and kind == "open":
            ordinal = next((s + 1 for s in reversed(path) if isinstance(s, int)), None)
            yield path, value if kind == "value" else OBJECT, ordinal


@dataclass(frozen=True)
class FlatTable:
    """A table of the objects at ``path``: steps joined by dots; ``a|b`` gives alternatives, ``[]`` is an array's member,
    ``*`` the member of an array or of a map; the empty path is the record itself.  Keys are matched in any case, and
    ``section`` shows them as written here."""

    name: str
    path: str
    #: Fields (in lower case) that the rows below get too, as ``../field``; with any of them, also ``../map_key`` and ``../section``.
    handed_down: tuple[str, ...] = ()

    def steps(self) -> list[dict[str, str] | str]:
        return [s if s in ("*", "[]") else {a.lower(): a for a in s.strip("{}").split("|")} for s in self.path.split(".") if s]


def _match(steps: list, path: Path) -> str | None:
    """The section name, if the path is one of the table."""
    if len(steps) != len(path):
        return None
    names = []
    for step, at in zip(steps, path, strict=True):
        if step == "[]":
            if not isinstance(at, int):
                return None
        elif step != "*":
            if isinstance(at, int) or at.lower() not in step:
                return None
            names.append(step[at.lower()])
    return ".".join(names)


def flatten_record(text: str | None, tables: list[FlatTable]) -> list[dict] | None:
    """The rows of one record, or None if it isn't valid JSON.  See ``flatten`` for the columns."""
    if text is None:
        return None
    compiled = [(t, t.steps()) for t in tables]
    depths = {len(s) for _, s in compiled}
    rows: list[dict] = []
    # The repeated ancestors of the triple at hand, each with the group of its triples.
    groups: list[dict] = [{"key": "", "path": (), "skip": 0, "counts": {}, "fields": {}, "row": None, "down": ()}]
    try:
        for path, value, _ in triples(text):
            while groups[-1]["path"] != path[: len(groups[-1]["path"])]:
                groups.pop()
            parent = groups[-1]
            if value is not OBJECT:
                field = ".".join(map(str, path[parent["skip"] :])).lower()
                if parent["fields"].get(field) is None:
                    parent["fields"][field] = value
            elif len(path) in depths:
                for table, steps in compiled:
                    section = _match(steps, path)
                    if section is None:
                        continue
                    place = (table.name, path[:-1])
                    parent["counts"][place] = ordinal = parent["counts"].get(place, 0) + 1
                    last = path[-1] if path else None
                    row = {
                        "table_name": table.name, "row_key": f"{parent['key']}/{'.'.join(map(str, path[parent['skip'] : -1]))}#{ordinal}" if path else "",
                        "parent_key": parent["key"], "section": section, "map_key": last if isinstance(last, str) else None, "ordinal": ordinal, "fields": {}, "parent": parent,
                    }
                    rows.append(row)
                    groups.append({"key": row["row_key"], "path": path, "skip": len(path), "counts": {}, "fields": row["fields"], "row": row, "down": table.handed_down})
                    break
    except BrokenRecord:
        return None
    for row in rows:
        # Fields may come behind the children, so they are handed down at the end.
        parent = row.pop("parent")
        if parent["down"]:
            above = parent["row"]
            row["fields"] |= {f"../{f}": above["fields"][f] for f in parent["down"] if f in above["fields"]} | {"../map_key": above["map_key"], "../section": above["section"]}
    return rows


_COLUMNS = "table_name string, row_key string, parent_key string, section string, map_key string, ordinal long, fields map<string,string>"


def flatten(df: DataFrame, text: str, keys: list[str], tables: list[FlatTable]) -> DataFrame:
    """One row per object of each table, with the record's ``keys`` and:

    ``table_name``; ``row_key``, unique within the record, and ``parent_key``, the key of the nearest enclosing row;
    ``section``, the named steps of its path; ``map_key``, its key if it stands in a map; ``ordinal``, its place (from 1)
    among the objects of the same array or map; ``fields``, its scalars by relative path in lower case.  Of fields that
    differ in case only, the first that isn't null counts.  Members that are no objects give no rows, and their scalars
    belong to the enclosing row.

    Records that are NULL or not valid JSON give no rows.  Empty tables give empty results.  Columns of ``df`` other than
    ``keys`` and ``text`` are not read; the keys must not have the names above.
    """
    schema = T.StructType([df.schema[k] for k in keys] + T._parse_datatype_string(_COLUMNS).fields)
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple] = []
            for record in batch.itertuples(index=False, name=None):
                for row in flatten_record(record[-1], tables) or ():
                    out.append((*record[:-1], row["table_name"], row["row_key"], row["parent_key"], row["section"], row["map_key"], row["ordinal"], row["fields"]))
            yield pd.DataFrame(out, columns=names).astype({k: batch[k].dtype for k in keys}) if out else pd.DataFrame({n: pd.Series(dtype=object) for n in names})

    return df.select(*keys, F.col(text).alias("__text")).mapInPandas(run, schema)


def fields_to_columns(rows: DataFrame, table: str, columns: dict[str, str]) -> DataFrame:
    """The pivot: one table of a ``flatten`` result with a column for each of ``columns`` (name: field)."""
    fixed = [c for c in rows.columns if c not in ("table_name", "fields")]
    return rows.filter(F.col("table_name") == table).select(*fixed, *(F.col("fields")[f.lower()].alias(n) for n, f in columns.items()))
