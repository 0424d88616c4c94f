"""DuckDB SQL for the corpus queries that SQL can express."""

NGRAM_JOIN = r"""
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g
  FROM t
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id
  JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.y AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT x, min(y) AS y FROM reach GROUP BY x) c ON c.x = d.doc_id
"""

WARC = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM m
"""

MIXING = r"""
WITH RECURSIVE size AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.7) AS w FROM documents GROUP BY source),
rate AS (SELECT source, w * (SELECT sum(n) FROM size) / ((SELECT sum(w) FROM size) * n) AS mix_rate FROM size),
doc AS (
  SELECT d.*, r.mix_rate, greatest(ceil(r.mix_rate / 8.0), 1)::INT AS pieces
  FROM documents d JOIN rate r ON d.source IS NOT DISTINCT FROM r.source
), piece AS (
  SELECT doc_id, mix_rate / pieces AS mean, unnest(range(1, pieces + 1)) AS j FROM doc
), drawn AS (
  SELECT doc_id, mean, j, (('0x' || substr(md5('mix-1|' || doc_id::VARCHAR || '|' || j::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u FROM piece
), step AS (
  SELECT doc_id, j, mean, u, exp(-mean) AS term, exp(-mean) AS total, 0 AS k FROM drawn
  UNION ALL
  SELECT doc_id, j, mean, u, term * mean / (k + 1), total + term * mean / (k + 1), k + 1 FROM step WHERE total <= u AND k < 64
), counts AS (
  SELECT doc_id, sum(k)::INT AS mix_count FROM (SELECT doc_id, j, max(k) AS k FROM step GROUP BY doc_id, j) GROUP BY doc_id
)
SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, d.mix_rate, c.mix_count, unnest(range(0, c.mix_count))::INT AS mix_copy
FROM doc d JOIN counts c ON c.doc_id = d.doc_id WHERE c.mix_count > 0
"""
