"""DuckDB SQL that gives the rows of queries by plainer means, for those that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING_DEDUP = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
v AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT g, min(doc_id) AS least FROM v GROUP BY g),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM v JOIN f USING (g) WHERE least < doc_id),
gone AS (SELECT doc_id, list(i) AS places, count(*) AS n FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed,
 sha256(coalesce(array_to_string(list_filter(ws, lambda x, i: NOT list_contains(coalesce(places, CAST([] AS BIGINT[])), i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone ON w.doc_id = gone.doc_id"""

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, md5(coalesce(text, '')) AS t, {WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * k >= 80 * (nx.c + ny.c - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
reach AS (SELECT doc_id AS x, doc_id AS class_id FROM w UNION SELECT y, class_id FROM reach JOIN e USING (x)),
c AS (SELECT x AS doc_id, min(class_id) AS class_id FROM reach GROUP BY x),
d AS (SELECT e.x AS doc_id, count(*) AS n_links, count(DISTINCT b.t) FILTER (b.t <> a.t) AS n_class_links FROM e JOIN w a ON a.doc_id = e.x JOIN w b ON b.doc_id = e.y GROUP BY e.x)
SELECT c.doc_id, class_id, coalesce(n_links, 0) AS n_links, coalesce(n_class_links, 0) AS n_class_links FROM c LEFT JOIN d USING (doc_id)"""

MIXING = f"""
WITH z AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM z GROUP BY source),
k AS (SELECT source, source_size, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
v AS (SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 150 / 100 - coalesce(sum(source_size * 2) OVER before, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
 FROM k WINDOW before AS (ORDER BY source_size * 2 / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, level * weight <= source_size * 2 AS fits, arg_min(level, source_size * 2 / weight) FILTER (level * weight <= source_size * 2) OVER () AS rest FROM v),
t AS (SELECT source, source_size, CASE WHEN fits THEN rest * weight ELSE CAST(source_size * 2 AS DOUBLE) END AS target FROM m),
r AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate, CAST(CAST('0x' || substr(md5('20260101/' || doc_id), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496 AS draw FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""
