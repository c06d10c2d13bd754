"""Queries of the general data problems (1, 2 and 7)."""

from threadmill.operators import incremental, nested, ranking
from threadmill.session import table


def p1_found(spark, folder):
    return incremental.unprocessed_lines(table(spark, folder, "transcript_lines"), table(spark, folder, "index_state"))


def p2_found(spark, folder):
    return ranking.leading(table(spark, folder, "search_results")).select("query_id", "doc_id")


def p7_found(spark, folder):
    return nested.blocks_of_lines(table(spark, folder, "transcript_lines"), keep=False).select("path", "byte_start", "block_path", "parent_path")


QUERIES = {"p1_found": p1_found, "p2_found": p2_found, "p7_found": p7_found}

ORACLES = {
    "p1_found": """
WITH placed AS (
  SELECT path, byte_start, byte_len, seen_at, sha256(coalesce(line, chr(1) || 'null')) AS text
  FROM transcript_lines WHERE path IS NOT NULL AND byte_start IS NOT NULL),
held AS (
  SELECT * FROM (
    SELECT *, min(seen_at) OVER (PARTITION BY path, byte_start, text) AS first_seen,
      row_number() OVER (PARTITION BY path, byte_start ORDER BY seen_at DESC NULLS LAST, text DESC, byte_len DESC NULLS LAST) AS n
    FROM placed) WHERE n = 1),
saves AS (
  SELECT path, coalesce(last_byte_offset, 0) AS off, saved_at FROM (
    SELECT *, row_number() OVER (PARTITION BY path ORDER BY run_no DESC NULLS LAST, saved_at DESC NULLS LAST, last_byte_offset DESC NULLS LAST) AS n
    FROM index_state WHERE status = 'ok' AND path IS NOT NULL) WHERE n = 1)
SELECT h.path, h.byte_start FROM held h LEFT JOIN saves s ON h.path = s.path
WHERE NOT coalesce(h.byte_start + coalesce(h.byte_len, 0) <= s.off AND h.first_seen <= s.saved_at, false)""",
    "p2_found": """
WITH held AS (
  SELECT query_id, doc_id, CASE WHEN leg IS DISTINCT FROM 'keyword' AND NOT isnan(distance) THEN distance END AS d,
    CASE WHEN leg IS DISTINCT FROM 'vector' AND NOT isnan(bm25) THEN bm25 END AS b, TRY_CAST(timestamp AS TIMESTAMPTZ) AS t
  FROM search_results WHERE query_id IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY logged_at DESC NULLS LAST, leg DESC NULLS LAST, distance DESC NULLS LAST, bm25 DESC NULLS LAST, timestamp DESC NULLS LAST) = 1),
placed AS (
  SELECT query_id, doc_id,
    (SELECT count(*) FILTER (o.d < h.d OR o.d IS NOT NULL AND h.d IS NULL) - count(*) FILTER (o.d > h.d OR o.d IS NULL AND h.d IS NOT NULL)
      + count(*) FILTER (o.b < h.b OR o.b IS NOT NULL AND h.b IS NULL) - count(*) FILTER (o.b > h.b OR o.b IS NULL AND h.b IS NOT NULL)
      + count(*) FILTER (o.t > h.t OR o.t IS NOT NULL AND h.t IS NULL) - count(*) FILTER (o.t < h.t OR o.t IS NULL AND h.t IS NOT NULL)
      FROM held o WHERE o.query_id = h.query_id) AS lost
  FROM held h)
SELECT query_id, doc_id FROM placed QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY lost, doc_id) <= 3""",
    "p7_found": """
WITH RECURSIVE held AS (
  SELECT path, byte_start, line FROM (
    SELECT *, row_number() OVER (PARTITION BY path, byte_start ORDER BY seen_at DESC NULLS LAST, sha256(line) DESC NULLS LAST, byte_len DESC NULLS LAST) AS n
    FROM transcript_lines WHERE path IS NOT NULL AND byte_start IS NOT NULL) WHERE n = 1),
parsed AS (SELECT path, byte_start, json_extract(CASE WHEN json_valid(line) THEN line END, '$.message.content') AS c FROM held),
blocks AS (
  SELECT path, byte_start, CAST(i AS VARCHAR) AS block_path, '' AS parent_path, e AS block
  FROM (SELECT path, byte_start, unnest(items) AS e, unnest(range(len(items))) AS i
    FROM (SELECT path, byte_start, CASE json_type(c) WHEN 'OBJECT' THEN [c] WHEN 'ARRAY' THEN json_extract(c, '$[*]') END AS items FROM parsed))
  WHERE json_type(e) = 'OBJECT'
  UNION ALL
  SELECT path, byte_start, block_path || '.' || CAST(i AS VARCHAR), block_path, e
  FROM (SELECT path, byte_start, block_path, unnest(items) AS e, unnest(range(len(items))) AS i
    FROM (SELECT path, byte_start, block_path, CASE json_type(c) WHEN 'OBJECT' THEN [c] WHEN 'ARRAY' THEN json_extract(c, '$[*]') END AS items
      FROM (SELECT path, byte_start, block_path, CASE WHEN json_type(block, '$.content') IN ('OBJECT', 'ARRAY') THEN json_extract(block, '$.content')
          ELSE json_extract(block, '$.source.content') END AS c FROM blocks)))
  WHERE json_type(e) = 'OBJECT')
SELECT path, byte_start, block_path, parent_path FROM blocks""",
}
