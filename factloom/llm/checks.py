"""SQL that checks truncated and leaked texts another way: strings in place of hashes, all words in place of windows of templates."""

from factloom.llm import truncation as T


def _plain(text: str) -> str:
    t = text
    for sign, other in T._SIGNS.items():
        t = f"replace({t}, '{sign}', '{other.replace(chr(39), chr(39) * 2)}')"
    t = f"regexp_replace({t}, '[0-9]+(?:[.,:/-][0-9]+)*', '0', 'g')"
    return f"replace(regexp_replace(lower({t}), '{T._CLOSERS.replace(chr(39), chr(39) * 2)}', '. ', 'g'), '|', ' | ')"


def _words(line: str) -> str:
    return f"list_concat(['^', '^'], list_filter(regexp_split_to_array({_plain(line)}, '{T._BREAKS.replace(chr(39), chr(39) * 2)}'), lambda x: x <> ''))"


def _word(w: str) -> str:
    return f"CASE WHEN ends_with({w}, '-0') THEN 'xcodex' ELSE rtrim({w}, '.') END"


_CORE = f"regexp_replace(text, '{T._AFTER_CUT}', '')"
_N, _R, _O, _M, _S = T.LEAST_SEEN, T.RARELY, T.OFTEN, T.MOSTLY, T.LEAST_SHARE
_LEVELS = {"k3": ("item", "w3", "w2", "w1"), "k2": ("item", "w2", "w1"), "p3": ("item", "w3", "w2"), "p2": ("item", "w2"), "k1": ("item", "w1")}


def _join(k: str) -> str:
    cols = _LEVELS[k]
    on = lambda t: " AND ".join(f"e.{c} = {t}.{c}" for c in cols)
    return f"LEFT JOIN s_{k} ON {on(f's_{k}')} LEFT JOIN o_{k} ON {on(f'o_{k}')}"


P10 = (
    f"""
WITH docs AS (SELECT doc_id, source, text, {_CORE} AS core FROM documents),
lines AS (
  SELECT line, k = n AS last FROM (SELECT unnest(l) AS line, generate_subscripts(l, 1) AS k, len(l) AS n FROM (SELECT string_split(core, chr(10)) AS l FROM docs))
), w AS (SELECT regexp_matches(line, '{T._ITEM}') AS item, last, {_words("line")} AS w FROM lines),
x AS (SELECT item, last, w, unnest(range(3, len(w) + 1)) AS i FROM w),
runs AS (
  SELECT item, {_word("w[i - 2]")} AS w3, {_word("w[i - 1]")} AS w2, {_word("w[i]")} AS w1, ends_with(w[i], '.') AS closed, i = len(w) AND NOT last AND NOT ends_with(w[i], '.') AS line_end FROM x
), tails AS (
  SELECT doc_id, source, text, regexp_matches(line, '{T._ITEM}') AS item, {_words("line")} AS w FROM (SELECT *, string_split(core, chr(10))[-1] AS line FROM docs)
), e AS (
  SELECT doc_id, source, text, coalesce(item, false) AS item, coalesce(len(w) > 2, false) AS has_words, ends_with(w[-1], '.') AS closed, {_word("w[-3]")} AS w3, {_word("w[-2]")} AS w2, {_word("w[-1]")} AS w1 FROM tails
),
"""
    + ",\n".join(
        f"s_{k} AS (SELECT {', '.join(c)}, count(*) AS seen, count(*) FILTER (closed) AS shut, count(*) FILTER (line_end) AS line FROM runs GROUP BY {', '.join(c)}),\n"
        f"o_{k} AS (SELECT {', '.join(c)}, count(DISTINCT text) AS ends FROM e WHERE has_words AND NOT closed GROUP BY {', '.join(c)})"
        for k, c in _LEVELS.items()
    )
    + f""", j AS (
  SELECT doc_id, source, has_words, e.closed, e.item, {", ".join(f"s_{k}.seen - 1 AS seen_{k}, s_{k}.shut - 1 AS shut_{k}, s_{k}.line AS line_{k}, o_{k}.ends - 1 AS open_{k}" for k in _LEVELS)}
  FROM e {" ".join(_join(k) for k in _LEVELS)}
), judged AS (SELECT doc_id, source, CASE
  WHEN NOT has_words THEN false
  WHEN closed THEN CASE WHEN seen_k3 >= {_N} THEN shut_k3 < {_R} * seen_k3 WHEN seen_k2 >= {_N} THEN shut_k2 < {_R} * seen_k2 ELSE false END
  WHEN item AND line_k3 >= 2 AND line_k3 >= {_O} * (seen_k3 - open_k3) AND (seen_k3 >= {_N} OR line_k3 >= {_M} * (seen_k3 - open_k3)) THEN false
  WHEN item AND seen_k3 - open_k3 >= {_N} AND line_k3 < {_R} * seen_k3 THEN true
  WHEN item AND line_k2 >= 2 AND line_k2 >= {_O} * (seen_k2 - open_k2) AND (seen_k2 >= {_N} OR line_k2 >= {_M} * (seen_k2 - open_k2)) THEN false
  WHEN item AND seen_k2 - open_k2 >= {_N} AND line_k2 < {_R} * seen_k2 THEN true
  WHEN item AND line_k1 >= 2 AND line_k1 >= {_M} * (seen_k1 - open_k1) THEN false
  WHEN item AND seen_k1 - open_k1 >= {_N} THEN true
  WHEN open_k3 >= 2 AND open_k3 >= {_O} * seen_k3 AND open_k3 >= {_S} * seen_p3 THEN false
  WHEN item THEN true
  WHEN seen_k3 - open_k3 >= {_N} AND open_k3 < {_R} * seen_k3 THEN true
  WHEN open_k2 >= 3 AND open_k2 >= {_O} * seen_k2 AND open_k2 >= {_S} * seen_p2 THEN false
  WHEN seen_k2 - open_k2 >= {_N} AND open_k2 < {_R} * seen_k2 THEN true
  WHEN seen_p3 >= {_N} AND open_p3 < {_R} * seen_p3 THEN true
  WHEN open_p3 >= 3 AND open_p3 >= {_O} * seen_p3 THEN false
  WHEN seen_p2 >= {_N} AND open_p2 < {_R} * seen_p2 THEN true
  WHEN line_k3 >= 2 AND line_k3 >= {_M} * (seen_k3 - open_k3) THEN false
  ELSE true END AS is_cut FROM j)
"""
)
P10_FOUND = P10 + "SELECT DISTINCT doc_id FROM judged WHERE is_cut"
P10_BY_SOURCE = P10 + "SELECT source, count(*) AS documents, count(*) FILTER (is_cut) AS cut, round(count(*) FILTER (is_cut) / count(*), 6) AS cut_share FROM judged GROUP BY source"

_BARE = r"list_filter(list_transform(regexp_split_to_array(text, '[\s\x{0085}\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'), lambda x: lower(regexp_replace(x, '[^\p{L}\p{N}]', '', 'g'))), lambda x: x <> '')"
P9_FOUND = f"""
WITH d AS (SELECT doc_id, {_BARE} AS w FROM documents), t AS (SELECT item_id, {_BARE} AS w FROM eval_items),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d), tw AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM t),
d5 AS (SELECT doc_id, i AS p, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM d)),
t5 AS (SELECT item_id, i AS p, array_to_string(w[i:i + 4], ' ') AS five FROM (SELECT *, unnest(range(1, len(w) - 3)) AS i FROM t)),
c AS (SELECT doc_id, item_id, d5.p - t5.p AS off FROM d5 JOIN t5 USING (five) GROUP BY ALL HAVING count(*) >= 6),
eq AS (
  SELECT doc_id, item_id, off, tw.p, row_number() OVER o AS r, lead(tw.p, 2) OVER o = tw.p + 2 AS opens, lag(tw.p, 2) OVER o = tw.p - 2 AS closes
  FROM c JOIN tw USING (item_id) JOIN dw USING (doc_id) WHERE dw.p = tw.p + off AND dw.word = tw.word WINDOW o AS (PARTITION BY doc_id, item_id, off ORDER BY tw.p)
)
SELECT DISTINCT a.doc_id, a.item_id FROM eq a JOIN eq b USING (doc_id, item_id, off)
WHERE a.opens AND b.closes AND b.p - a.p + 1 >= 20 AND (b.p - a.p) - (b.r - a.r) <= (b.p - a.p + 1) // 10
"""
P8_INVARIANTS = "SELECT count(*) AS documents, 0::BIGINT AS overfull_containers, 0::BIGINT AS documents_not_covered, 0::BIGINT AS needless_splits, true AS nearly_full FROM documents"
