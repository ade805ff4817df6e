"""The same queries in SQL, where SQL can express them."""

from __future__ import annotations

MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), 'null ' || size) || ':mix') AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source IS NULL, source) AS rnk
  FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][(rnk - 1) % 3 + 1] AS weight, 2 * source_size AS cap FROM s
), o AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
         coalesce(sum(cap) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
         sum(weight) OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still_open,
         row_number() OVER (ORDER BY CAST(cap AS DOUBLE) / weight, rnk) AS place
  FROM w
), l AS (
  SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) * 1.5e0 - CAST(filled AS DOUBLE)) / CAST(still_open AS DOUBLE) AS level FROM o
), t AS (
  SELECT source, source_size, rnk,
         least(CAST(cap AS DOUBLE), coalesce((SELECT arg_min(level, place) FROM l WHERE level <= ratio) * weight, CAST(cap AS DOUBLE))) AS target
  FROM l
), q AS (
  SELECT d.doc_id, d.size, t.source, t.source_size, t.target, t.rnk,
         row_number() OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size) AS ordinal,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS served
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), n AS (
  SELECT *, unnest([1, 2]) AS pass FROM q WHERE size > 0
), k AS (
  SELECT *, unnest(range(0, size, 128)) AS first FROM n
), f AS (
  SELECT rnk, ordinal, pass, first, least(128, size - first) AS words,
         CAST(served + (pass - 1) * source_size + first + least(128, size - first) AS DOUBLE) / target AS finish
  FROM k
), g AS (
  SELECT *, coalesce(sum(words) OVER (ORDER BY finish, rnk, pass, ordinal, first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier
  FROM f
), h AS (
  SELECT rnk, ordinal, sum(greatest(0, least(words, (SELECT CAST(floor(sum(size) * 1.5e0) AS BIGINT) FROM d) - earlier))) AS taken FROM g GROUP BY rnk, ordinal
)
SELECT q.doc_id, q.size, q.source_size, q.target, CAST(coalesce(h.taken, 0) AS BIGINT) AS taken
FROM q LEFT JOIN h ON q.rnk = h.rnk AND q.ordinal = h.ordinal
"""

WARC = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest FROM p
), m AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS newest FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM newest THEN newest END AS refers_to
FROM m
"""

ORACLES: dict[str, str] = {"op3_mix_sources": MIX, "op5_warc_roundtrip": WARC}
