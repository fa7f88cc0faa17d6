"""DuckDB SQL of the operators that SQL can express."""

LINES_SQL = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
      '(?is)<(script|style)[^>]*>.*?</(script|style)>', chr(10), 'g'),
      '(?s)<!--.*?-->', chr(10), 'g'),
      '(?i)</?(html|head|body|title|meta|nav|ul|ol|li|div|article|section|header|footer|h[1-6]|p|br|tr|td|th|table)[^>]*>', chr(10), 'g'),
      '<[^>]*>', '', 'g') AS text
  FROM pages),
l AS (SELECT page_id, host, unnest(list_distinct(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> ''))) AS line FROM p),
c AS (SELECT host, line, count(*) AS n FROM l GROUP BY host, line),
t AS (SELECT host, count(*) AS pages FROM p GROUP BY host),
d AS (SELECT c.host, list(line) AS drops FROM c JOIN t ON c.host IS NOT DISTINCT FROM t.host
      WHERE n > 1 AND n / pages > 0.1 GROUP BY c.host),
j AS (SELECT p.*, coalesce(drops, []) AS drops, string_split(text, chr(10)) AS parts
      FROM p LEFT JOIN d ON p.host IS NOT DISTINCT FROM d.host)
SELECT page_id, host, array_to_string(list_filter(parts, lambda x: NOT list_contains(drops, trim(x))), chr(10)) AS text,
  coalesce(len(list_filter(parts, lambda x: trim(x) <> '')), 0) AS n_lines,
  coalesce(len(list_filter(parts, lambda x: trim(x) <> '' AND list_contains(drops, trim(x)))), 0) AS n_dropped
FROM j
"""


def mixing_sql(documents: str = "documents") -> str:
    """Closed form: sources by limit over weight; the level is the first that leaves all later ones below theirs."""
    return rf"""
WITH r AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
    md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || md5(coalesce(text, '')) || ':' ||
      (row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1)) AS u FROM {documents}),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM r GROUP BY source),
w AS (SELECT *, CASE (k - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
o AS (SELECT *, coalesce(sum(cap) OVER before, 0) AS capped, sum(weight) OVER (ORDER BY cap / weight DESC, k DESC) AS open,
    sum(source_size) OVER () * 1.5::DOUBLE AS budget
  FROM w WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT coalesce(arg_min((budget - capped) / open, pos) FILTER (WHERE weight * ((budget - capped) / open) <= cap), 0) AS level
  FROM (SELECT *, row_number() OVER (ORDER BY cap / weight, k) AS pos FROM o)),
g AS (SELECT w.source, source_size, least(weight * level, cap) AS target FROM w, v),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM g),
d AS (SELECT r.*, source_size, target, whole, target - whole * source_size AS need,
    sum(size) OVER (PARTITION BY r.source, u) AS same,
    sum(size) OVER (PARTITION BY r.source ORDER BY u RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
  FROM r JOIN e ON r.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  ((whole + CASE WHEN need > 0 AND run - same / 2.0 <= need THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM d
"""


MIXING_SQL = mixing_sql()


NEGATIVES_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""


DIVERGENCE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
w AS (SELECT doc, lang, source, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT doc, lang, source, unnest(words) AS word FROM d)),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM k GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
g AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
f AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 5) // (g.total + 5 * v) AS p,
    1 + 1000000000 * (k.n + 5) // (l.total + 5 * v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT s.lang, s.source, t.source AS item, sum(abs(s.p - t.p)) AS value FROM f s JOIN f t USING (lang, term) GROUP BY ALL) x
    ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
terms AS (SELECT lang, source, term AS item, p - q AS value FROM f WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value,
  row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pairs
UNION ALL
SELECT lang, source, 'term', item, value::BIGINT, row_number() OVER o AS rank FROM terms
WINDOW o AS (PARTITION BY lang, source ORDER BY value DESC, item) QUALIFY row_number() OVER o <= 50
"""
