"""DuckDB statements for the text operators that SQL can express, over the given tables (doc_id unique)."""

from __future__ import annotations

import string

from blockloom.llm import quality as q

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

JACCARD = rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
      ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END)) AS sh FROM w),
x AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM x a JOIN x b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, links.b FROM r JOIN links ON r.reach = links.a)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, c.component_id,
      CASE WHEN len(sh) = 0 THEN s.doc_id ELSE min(s.doc_id) OVER (PARTITION BY sh) END AS class_id
FROM s JOIN (SELECT node, min(reach) AS component_id FROM r GROUP BY node) c ON c.node = s.doc_id"""

LM_SCORES = rf"""WITH w AS (SELECT doc_id, {_WORDS.format(_LOWER)} AS ws FROM documents),
t0 AS (SELECT doc_id, len(ws) AS nd, unnest(ws) AS w, unnest(range(len(ws))) AS i FROM w),
t AS (SELECT *, lag(w) OVER d AS h, lag(w, 2) OVER d AS g FROM t0 WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
one AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1,
      count(*) OVER (PARTITION BY h, w) - count(*) OVER (PARTITION BY doc_id, h, w) AS c2,
      count(*) OVER (PARTITION BY g, h, w) - count(*) OVER (PARTITION BY doc_id, g, h, w) AS c3, count(*) OVER () - nd AS n FROM t),
b AS (SELECT *, lag(c1) OVER d AS b1, lag(c2) OVER d AS b2 FROM one WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
p AS (SELECT doc_id, CASE WHEN g IS NOT NULL THEN c3 WHEN h IS NOT NULL THEN c2 ELSE c1 END > 0 AS seen,
      CASE WHEN g IS NOT NULL AND c3 > 0 THEN c3 / b2 ELSE CASE WHEN g IS NOT NULL THEN 0.4 ELSE 1.0 END
      * CASE WHEN h IS NOT NULL AND c2 > 0 THEN c2 / b1 ELSE CASE WHEN h IS NOT NULL THEN 0.4 ELSE 1.0 END
      * CASE WHEN c1 > 0 THEN c1 / n ELSE CAST(0.4 AS DOUBLE) / (n + 1) END END END AS p FROM b)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_seen, 0) AS BIGINT) AS n_seen, round(score, 6) AS score
FROM w LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE seen) AS n_seen,
      avg(log10(p)) AS score FROM p GROUP BY doc_id) x ON x.doc_id = w.doc_id"""

_COMMON = "[" + ", ".join(f"'{c}'" for c in q.COMMON) + "]"
_LEFT = "length(regexp_replace(rest, '{}', '', 'g'))"
_SHARES = "CASE WHEN list_sum({0}) > 0 THEN list_transform({0}, lambda x: x / list_sum({0})) END"
_DISTANCE = """sqrt(greatest(0.0, list_sum(list_transform(range(1, len({p}) + 1), lambda i:
      (CASE WHEN {p}[i] > 0 THEN {p}[i] * log2(2 * {p}[i] / ({p}[i] + {q}[i])) / 2 ELSE 0 END)
      + (CASE WHEN {q}[i] > 0 THEN {q}[i] * log2(2 * {q}[i] / ({p}[i] + {q}[i])) / 2 ELSE 0 END)))))"""

QUALITY = rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws,
      list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
      regexp_replace(coalesce(text, ''), '[A-Za-z\x20\x09-\x0D]+', '', 'g') AS rest FROM documents),
c AS (SELECT doc_id, lang, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
      length(rest) AS n_rest, {_LEFT.format('[^0-9]+')} AS digit, {_LEFT.format('[^#*$%&|<>]+')} AS symbol, {_LEFT.format("[^.,;:!?''\"()-]+")} AS stop,
      {_LEFT.format(r'[\x00-\x7F\P{L}]+')} AS letter, ws,
      list_transform({_COMMON}, lambda y: len(list_filter(ws, lambda x: lower(x) = y))) AS common FROM w),
d AS (SELECT *, [word_chars - n_rest, letter, digit, stop, symbol, n_rest - digit - symbol - stop - letter] AS classes FROM c),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) AS g, unnest(range(1, len(ws) - 1)) AS i FROM c),
g2 AS (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS k FROM g),
m AS (SELECT doc_id, count(DISTINCT j) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM g2 WHERE k > 1) GROUP BY doc_id),
e AS (SELECT lang, 0 AS kind, unnest(classes) AS v, unnest(range(1, 7)) AS i FROM d UNION ALL
      SELECT lang, 1, unnest(common), unnest(range(1, {len(q.COMMON) + 1})) FROM d),
sums AS (SELECT lang, kind, i, sum(v) AS v FROM e GROUP BY GROUPING SETS ((lang, kind, i), (kind, i)) HAVING lang IS NOT NULL OR GROUPING(lang) = 1),
ref AS (SELECT lang, list(v ORDER BY i) FILTER (WHERE kind = 0) AS rc, list(v ORDER BY i) FILTER (WHERE kind = 1) AS rw FROM sums GROUP BY lang),
j AS (SELECT d.*, coalesce(m.n_repeat_words, 0) AS n_repeat_words, {_SHARES.format('d.classes')} AS pc, {_SHARES.format('d.common')} AS pw,
      coalesce(CASE WHEN own.lang IS NOT NULL AND list_sum(own.rc) >= {q.REFERENCE_CHARS} THEN {_SHARES.format('own.rc')} END, {_SHARES.format('pooled.rc')}) AS qc,
      coalesce(CASE WHEN own.lang IS NOT NULL AND list_sum(own.rc) >= {q.REFERENCE_CHARS} THEN {_SHARES.format('own.rw')} END, {_SHARES.format('pooled.rw')}) AS qw
      FROM d LEFT JOIN m ON m.doc_id = d.doc_id LEFT JOIN ref own ON own.lang = d.lang JOIN ref pooled ON pooled.lang IS NULL),
k AS (SELECT *, CASE WHEN list_sum(classes) >= {q.CLASS_MIN_CHARS} AND pc IS NOT NULL THEN {_DISTANCE.format(p='pc', q='qc')} END AS cd,
      CASE WHEN n_words >= {q.WORDS_MIN_COUNT} AND pw IS NOT NULL THEN {_DISTANCE.format(p='pw', q='qw')} END AS wd,
      n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed FROM j)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(symbol AS BIGINT) AS n_symbols,
      CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
      NOT base_failed AND coalesce(cd, 0) <= {q.CLASS_LIMIT} AND coalesce(wd, 0) <= {q.WORDS_LIMIT} AS kept,
      round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM k"""
