"""Text cut off by field limits, found by what stands at the ends of texts, in SQL only.

Lines become words by blanks and punctuation, numbers and codes as one word each by kind, marks of lists and tables as words.  A
word is closed if sentence punctuation follows it.  Every run of three words (trigram) of a line is counted inside texts and where
texts end with it; runs in items of lists are counted apart from those in sentences.  The final run of each text, its last two
words, and both with the last word unknown (``w3 w2 *``, ``w2 *``) are then joined with these counts.

* A text whose last word is closed is cut if its last run is frequent but almost never closed anywhere ("fell by 29." of
  "29.5 percent"), and else whole.
* A text whose last word is open is whole if other texts end in the same open run, in a fair share of the run's occurrences and of
  all that follows the words before it (a row of a table, a signature); it is cut if its run is frequent inside but almost never
  ends texts.  Where the run is too rare to tell, as behind a cut inside a word, the last two words and then the runs with the last
  word unknown are asked the same.
* An item of a list is judged by the ends of lines in the same way: cuts make no lines, so what ends lines ends items.

All thresholds are counts or shares of a run's own occurrences; none depends on the number of texts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from factloom.operators.materialize import materialize

#: A run that occurred this often elsewhere tells where it can end.
LEAST_SEEN = 20
#: Below this share of its occurrences, a run ends no text (or no sentence).
RARELY = 0.01
#: From this share on, in at least two other places, a run ends whole texts.
OFTEN = 0.05
#: From this share of its occurrences in list items at their ends, a rare run or a word ends items.
MOSTLY = 0.5
#: The least share of what follows the words before it that an open end must have: an end by a cut inside a word is far rarer.
LEAST_SHARE = 0.001

_CLOSERS = r"[)\"'\xBB]*(?:[.?!]|[ \xA0][?!])[\"'\xBB)]*"
_BREAKS = r"[ \t\n\x0B\f\r,;:()\[\]<>{}\"\xAB\xBB`/%&+=_\xA0]+"
#: Signs beyond Latin-1 and what they are read as; character classes without them are matched by a table.
_SIGNS = {"’": "'", "‘": "'", "“": '"', "”": '"', "„": '"', "–": " ", "—": " ", "…": " ", " ": " "}
#: What may have been put after a cut, and blanks: an ellipsis, or a tag or bracket, itself cut or whole.
_AFTER_CUT = r"(?:\s|…|\.\.\.|\[[a-zA-Z ]*(?:…|\.\.\.)?\]?|<[a-zA-Z/ ]*>?)+$"
#: The end of a text that is looked at first for what was put after a cut; where all of it goes, the whole text is.
_LOOK = 200
_ITEM = r"^\s*[-*•]\s"


def _r(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return "r'" + pattern.replace("'", r"\x27") + "'"


def plain_sql(text: str) -> str:
    """SQL for a text in lower case with 0 for each number and ``. `` behind each closed word."""
    t = text
    for sign, other in _SIGNS.items():
        t = f"replace({t}, '{sign}', '{other.replace(chr(39), chr(92) + chr(39))}')"
    t = f"regexp_replace({t}, {_r('[0-9]+(?:[.,:/-][0-9]+)*')}, '0')"
    return f"replace(regexp_replace(lower({t}), {_r(_CLOSERS)}, '. '), '|', ' | ')"


def words_sql(plain: str) -> str:
    """SQL for the array of the words of a line of ``plain_sql``, behind two marks of its start."""
    return f"concat(array('^', '^'), array_remove(split({plain}, {_r(_BREAKS)}), ''))"


def _word(w: str) -> str:
    return f"xxhash64(if(endswith({w}, '-0'), 'xcodex', rtrim('.', {w})))"


#: The keys of a run: its three words, the last two, three and two with the last unknown, the last one.
_KEYS = "xxhash64(3, item, w3, w2, w1) AS k3, xxhash64(2, item, w2, w1) AS k2, xxhash64(-3, item, w3, w2) AS p3, xxhash64(-2, item, w2) AS p2, xxhash64(1, item, w1) AS k1"


def truncated_texts(docs: DataFrame, doc_id: str, text: str, source: str, least_seen: int = LEAST_SEEN, rarely: float = RARELY, often: float = OFTEN, mostly: float = MOSTLY, least_share: float = LEAST_SHARE) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``is_cut`` and ``evidence`` (what decided).

    NULL texts and texts without words are not cut (evidence "none").  All texts are read whole and all are counted; a
    document's own end is no evidence about itself, and texts that come again count as one end.  Repeated rows are judged alike.
    Only ``doc_id``, ``text`` and ``source`` are read.  Runs are counted by 64-bit hashes of their words, combined on the map side before the
    one exchange of trigrams and again before that of the shorter runs.
    """
    spark, tag = docs.sparkSession, uuid.uuid4().hex
    inputs, tails, runs = f"texts_{tag}", f"tails_{tag}", f"runs_{tag}"
    docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS body", f"`{source}` AS source").createOrReplaceTempView(inputs)
    end = f"regexp_replace(right(body, {_LOOK}), {_r(_AFTER_CUT)}, '')"
    core = f"if(length({end}) > 0 OR length(body) <= {_LOOK}, concat(left(body, length(body) - {_LOOK}), {end}), regexp_replace(body, {_r(_AFTER_CUT)}, ''))"
    ends = spark.sql(
        f"""
      SELECT row, doc_id, source, same, item, has_words, closed, {_KEYS}
      FROM (
        SELECT row, doc_id, source, same, item, size(w) > 2 AS has_words, endswith(get(w, size(w) - 1), '.') AS closed,
          {_word("get(w, size(w) - 3)")} AS w3, {_word("get(w, size(w) - 2)")} AS w2, {_word("get(w, size(w) - 1)")} AS w1
        FROM (
          SELECT row, doc_id, source, same, line RLIKE {_r(_ITEM)} AS item, {words_sql(plain_sql("line"))} AS w
          FROM (SELECT monotonically_increasing_id() AS row, doc_id, source, xxhash64(body) AS same, substring_index({core}, '\\n', -1) AS line FROM {inputs})))
    """
    )
    materialize(ends, "tails").createOrReplaceTempView(tails)
    counted = spark.sql(
        f"""
      SELECT {_KEYS}, seen, closed, ends_line
      FROM (
        SELECT item, w3, w2, w1, count(*) AS seen, count_if(closed) AS closed, count_if(line_end) AS ends_line
        FROM (
          SELECT item, {_word("a")} AS w3, {_word("b")} AS w2, {_word("c")} AS w1, endswith(c, '.') AS closed, d IS NULL AND NOT last AND NOT endswith(c, '.') AS line_end
          FROM (
            SELECT item, last, inline(arrays_zip(w, slice(w, 2, size(w)), slice(w, 3, size(w)), slice(w, 4, size(w)))) AS (a, b, c, d)
            FROM (
              SELECT line RLIKE {_r(_ITEM)} AS item, at = 0 AS last, {words_sql("line")} AS w
              FROM (SELECT posexplode(reverse(split({plain_sql(core)}, '\n'))) AS (at, line) FROM {inputs})))
          WHERE c IS NOT NULL)
        GROUP BY item, w3, w2, w1)
    """
    )
    counted.createOrReplaceTempView(runs)
    return spark.sql(
        f"""
    WITH asked AS (
      SELECT row, doc_id, source, same, item, has_words, closed, stack(5, 'k3', k3, 'k2', k2, 'p3', p3, 'p2', p2, 'k1', k1) AS (level, key) FROM {tails}
    ), once AS (
      SELECT key, count(*) AS ends FROM (SELECT DISTINCT same, key FROM asked WHERE has_words AND NOT closed) GROUP BY key
    ), seen AS (
      SELECT key, sum(seen) AS seen, sum(closed) AS closed, sum(ends_line) AS ends_line, sum(ends) AS ends FROM (
        SELECT stack(5, k3, seen, closed, ends_line, 0L, k2, seen, closed, ends_line, 0L, p3, seen, 0L, 0L, 0L, p2, seen, 0L, 0L, 0L, k1, seen, closed, ends_line, 0L) AS (key, seen, closed, ends_line, ends) FROM {runs}
        UNION ALL SELECT key, 0L, 0L, 0L, ends FROM once)
      GROUP BY key
    ), judged AS (
      SELECT row, any_value(doc_id) AS doc_id, any_value(source) AS source, any_value(item) AS item, any_value(has_words) AS has_words, any_value(a.closed) AS closed,
        {", ".join(f"max(s.{c}) FILTER (WHERE level = '{k}') - {own} AS {n}_{k}" for k in ("k3", "k2", "p3", "p2", "k1") for c, n, own in (("seen", "seen", "1"), ("closed", "shut", "1"), ("ends_line", "line", "0"), ("ends", "open", "1")))}
      FROM asked a LEFT JOIN seen s ON a.key = s.key
      GROUP BY row
    ), decided AS (
      SELECT doc_id, source, CASE
        WHEN has_words IS NOT TRUE THEN 'none'
        WHEN closed AND seen_k3 >= {least_seen} THEN if(shut_k3 < {rarely} * seen_k3, 'cut: run never closed', 'whole: run closed')
        WHEN closed AND seen_k2 >= {least_seen} THEN if(shut_k2 < {rarely} * seen_k2, 'cut: pair never closed', 'whole: pair closed')
        WHEN closed THEN 'whole: closed'
        WHEN item AND line_k3 >= 2 AND line_k3 >= {often} * (seen_k3 - open_k3) AND (seen_k3 >= {least_seen} OR line_k3 >= {mostly} * (seen_k3 - open_k3)) THEN 'whole: run ends items'
        WHEN item AND seen_k3 - open_k3 >= {least_seen} AND line_k3 < {rarely} * seen_k3 THEN 'cut: run never ends items'
        WHEN item AND line_k2 >= 2 AND line_k2 >= {often} * (seen_k2 - open_k2) AND (seen_k2 >= {least_seen} OR line_k2 >= {mostly} * (seen_k2 - open_k2)) THEN 'whole: pair ends items'
        WHEN item AND seen_k2 - open_k2 >= {least_seen} AND line_k2 < {rarely} * seen_k2 THEN 'cut: pair never ends items'
        WHEN item AND line_k1 >= 2 AND line_k1 >= {mostly} * (seen_k1 - open_k1) THEN 'whole: word ends items'
        WHEN item AND seen_k1 - open_k1 >= {least_seen} THEN 'cut: word seldom ends items'
        WHEN open_k3 >= 2 AND open_k3 >= {often} * seen_k3 AND open_k3 >= {least_share} * seen_p3 THEN 'whole: run ends texts'
        WHEN NOT item AND seen_k3 - open_k3 >= {least_seen} AND open_k3 < {rarely} * seen_k3 THEN 'cut: run never ends texts'
        WHEN NOT item AND open_k2 >= 3 AND open_k2 >= {often} * seen_k2 AND open_k2 >= {least_share} * seen_p2 THEN 'whole: pair ends texts'
        WHEN NOT item AND seen_k2 - open_k2 >= {least_seen} AND open_k2 < {rarely} * seen_k2 THEN 'cut: pair never ends texts'
        WHEN NOT item AND seen_p3 >= {least_seen} AND open_p3 < {rarely} * seen_p3 THEN 'cut: words before never end texts'
        WHEN NOT item AND open_p3 >= 3 AND open_p3 >= {often} * seen_p3 THEN 'whole: words before end texts'
        WHEN NOT item AND seen_p2 >= {least_seen} AND open_p2 < {rarely} * seen_p2 THEN 'cut: word before never ends texts'
        WHEN NOT item AND line_k3 >= 2 AND line_k3 >= {mostly} * (seen_k3 - open_k3) THEN 'whole: such lines occur'
        ELSE 'cut: open and like no other end' END AS evidence
      FROM judged
    )
    SELECT doc_id, source, startswith(evidence, 'cut') AS is_cut, evidence FROM decided
    """
    )
