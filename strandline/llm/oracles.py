"""DuckDB equivalents of the queries that SQL can express, over whole tables."""

from __future__ import annotations

#: Base 32 of a SHA-1: 160 bits are four groups of eight characters of five bits.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first, sha1(html) AS h FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, CAST((j // 8) * 10 + 1 AS INTEGER), 10) AS BIGINT) >> CAST(35 - 5 * (j % 8) AS INTEGER)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""

#: Classes of equal shingle sets first, so that copies are not expanded into pairs.
MINHASH = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (
  SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 3, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1),
    lambda i: md5(array_to_string(w[i:i + 3], ' '))))) AS s FROM w),
c AS (SELECT md5(array_to_string(s, ',')) AS cls, min(doc_id) AS rep, any_value(s) AS s, len(any_value(s)) AS n FROM s WHERE len(s) > 0 GROUP BY 1),
x AS (SELECT rep, n, unnest(s) AS g FROM c),
e AS (
  SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.g = b.g AND a.rep < b.rep
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(a, b) AS (SELECT rep, rep FROM c UNION SELECT r.a, u.b FROM r JOIN u ON u.a = r.b),
l AS (SELECT a AS rep, min(b) AS component_id FROM r GROUP BY a)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(l.component_id, s.doc_id) AS component_id, s.doc_id = coalesce(l.component_id, s.doc_id) AS kept
FROM s LEFT JOIN c ON c.cls = md5(array_to_string(s.s, ',')) AND len(s.s) > 0 LEFT JOIN l ON l.rep = c.rep
"""
