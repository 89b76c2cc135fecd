"""SQL twins (DuckDB) of the operators that SQL can express, over the whole tables with the production parameters."""

from __future__ import annotations

from . import exact_dedup, line_dedup
from .decontaminate import COVER, LITERAL, LONG, NUMBERS, SHORT, TOKEN, UNITS, WINDOW

NGRAM_JACCARD = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i + 1 : i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 2, 1))) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id),
links AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS both_ FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL)
  JOIN sizes sa ON sa.doc_id = a JOIN sizes sb ON sb.doc_id = b WHERE 100 * both_ >= 90 * (sa.n + sb.n - both_)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(id, c) AS (SELECT doc_id, doc_id FROM words UNION SELECT e.b, r.c FROM reach r JOIN both_ways e ON e.a = r.id WHERE r.c < e.b)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id
FROM words d LEFT JOIN sizes USING (doc_id) JOIN (SELECT id, min(c) AS component_id FROM reach GROUP BY id) c ON c.id = d.doc_id
"""


def _listed(words: str) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words.split()) + ")"


_PLAIN = (
    f"CASE WHEN substr(t, 1, 1) BETWEEN '0' AND '9' OR lower(t) IN {_listed(NUMBERS)} THEN '<num>' WHEN lower(t) IN {_listed(UNITS)} THEN '<unit>' ELSE replace(lower(t), 'ß', 'ss') END"
)
_CANON = f"CASE WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND NOT starts_with({_PLAIN}, '<') THEN '<name>' ELSE {_PLAIN} END"
_TOKEN = TOKEN.replace("'", "''")

DECONTAMINATION = f"""
WITH d AS (SELECT id, words, list_transform(words, lambda t: {_CANON}) AS canon, list_transform(words, lambda t: {_PLAIN}) AS plain
  FROM (SELECT doc_id AS id, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS words FROM documents)),
items AS (SELECT *, least(len(canon), {WINDOW}) AS size
  FROM (SELECT item, words, list_transform(words, lambda t: {_CANON}) AS canon, list_transform(words, lambda t: {_PLAIN}) AS plain
    FROM (SELECT item_id AS item, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS words FROM benchmark))
  WHERE len(canon) >= {SHORT}),
iw AS (SELECT item, size, i, array_to_string(part, ' ') AS w, array_to_string(plain[i + 1 : i + size], ' ') AS v
  FROM (SELECT item, size, i, plain, canon[i + 1 : i + size] AS part FROM (SELECT *, unnest(range(0, len(canon) - size + 1)) AS i FROM items))
  WHERE len(list_filter(part, lambda t: NOT starts_with(t, '<'))) >= {LITERAL}),
marks AS (SELECT item, size, i, w FROM iw UNION SELECT item, size, i, v FROM iw),
totals AS (SELECT item, count(DISTINCT i) AS n_windows FROM iw GROUP BY item),
spots AS (SELECT id, canon, plain, size, unnest(range(0, len(canon) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM iw)),
dw AS (SELECT id, size, p, array_to_string(canon[p + 1 : p + size], ' ') AS w FROM spots UNION SELECT id, size, p, array_to_string(plain[p + 1 : p + size], ' ') FROM spots),
aligned AS (SELECT row_number() OVER () AS k, *, list_min(seen) AS lo, list_max(seen) + size - 1 AS hi
  FROM (SELECT id, item, m.size, p - i AS shift, list(DISTINCT i) AS seen FROM marks m JOIN dw ON dw.size = m.size AND dw.w = m.w GROUP BY id, item, m.size, p - i)),
cells AS (SELECT k, p, lo, hi, seen, size, x, u, v, coalesce(x = y OR u = v, false) AS same
  FROM (SELECT a.*, i.canon[p + 1] AS x, replace(lower(i.words[p + 1]), 'ß', 'ss') AS u, CASE WHEN p + shift >= 0 THEN d.canon[p + shift + 1] END AS y, CASE WHEN p + shift >= 0 THEN replace(lower(d.words[p + shift + 1]), 'ß', 'ss') END AS v
    FROM (SELECT a.*, unnest(range(0, len(i.words))) AS p FROM aligned a JOIN items i USING (item)) a JOIN items i USING (item) JOIN d ON d.id = a.id)),
whole AS (SELECT k, count(DISTINCT (x, u)) FILTER (same AND x LIKE '<%' AND p BETWEEN lo AND hi) = count(DISTINCT (x, u, v)) FILTER (same AND x LIKE '<%' AND p BETWEEN lo AND hi) AS consistent,
  coalesce(bool_and(u = v) FILTER (same AND x LIKE '<%' AND p BETWEEN lo AND hi), true) AS verbatim FROM cells GROUP BY k),
runs AS (SELECT k, count(*) AS n, coalesce(bool_and(u = v) FILTER (x LIKE '<%'), true) AS verbatim
  FROM (SELECT *, sum((NOT same)::INT) OVER (PARTITION BY k ORDER BY p) AS island FROM cells) WHERE same GROUP BY k, island
  HAVING count(DISTINCT (x, u)) FILTER (x LIKE '<%') = count(DISTINCT (x, u, v)) FILTER (x LIKE '<%')
    AND len(list_filter(any_value(seen), lambda i: i >= min(p) AND i + any_value(size) - 1 <= max(p))) > 0),
longest AS (SELECT k, max(n) AS run, count(*) FILTER (n >= {LONG}) AS n_long, bool_and(verbatim) FILTER (n >= {LONG}) AS long_verbatim FROM runs GROUP BY k),
per AS (SELECT a.id, a.item, a.seen, w.consistent, CASE WHEN w.consistent THEN w.verbatim ELSE long_verbatim END AS verbatim, run
  FROM aligned a JOIN whole w USING (k) LEFT JOIN longest l USING (k) WHERE w.consistent OR n_long > 0),
covered AS (SELECT id, item, count(DISTINCT i) AS c FROM (SELECT id, item, unnest(seen) AS i FROM per WHERE consistent) GROUP BY id, item),
pairs AS (SELECT id AS doc_id, item AS item_id, coalesce(any_value(c), 0) / any_value(n_windows)::DOUBLE AS coverage, max(run)::BIGINT AS n_tokens, bool_and(verbatim) AS verbatim
  FROM per JOIN totals USING (item) LEFT JOIN covered USING (id, item) GROUP BY id, item)
SELECT * FROM pairs WHERE coverage >= {COVER} OR n_tokens >= {LONG}
"""

ORACLES = {
    "op3_line_dedup": line_dedup.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op6_ngram_jaccard_join": NGRAM_JACCARD,
    "op7_benchmark_decontamination": DECONTAMINATION,
}
