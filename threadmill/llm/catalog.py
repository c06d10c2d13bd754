"""Queries of the operators that prepare training data, and SQL where it can give the same rows."""

from pyspark.sql import functions as F

from threadmill.llm import conversations, markup, packing, personal, sentences, splitting, tokens
from threadmill.session import table


def p3_found(spark, folder):
    return markup.marked(table(spark, folder, "turns"), "doc_id", "content")


def p4_found(spark, folder):
    messages = conversations.transcript_messages(table(spark, folder, "transcript_lines"), with_text=False)
    return conversations.verdicts(messages).where("dropped").select(F.col("conversation").alias("session_id"))


def p5_found(spark, folder):
    return splitting.oversized(table(spark, folder, "turns").select("doc_id", "content"), "doc_id", "content")


def p6_found(spark, folder):
    return personal.personal(table(spark, folder, "turns"), "doc_id", "content", table(spark, folder, "known_names")).select("doc_id", "kind", "found")


def p8_ids(spark, folder):
    return tokens.encode(table(spark, folder, "documents"), "doc_id", "text")


def p9_inputs(spark, folder):
    return packing.pack(table(spark, folder, "documents"), "doc_id", "text", "source", table(spark, folder, "embed_models"))


def p10_found(spark, folder):
    documents = table(spark, folder, "documents")
    return sentences.found(documents.where("form = 'prose'"), sentences.learn(documents))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found, "p5_found": p5_found, "p6_found": p6_found, "p8_ids": p8_ids, "p9_inputs": p9_inputs, "p10_found": p10_found}

ORACLES = {
    "p4_found": """
WITH held AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY path, byte_start ORDER BY seen_at DESC NULLS LAST, sha256(line) DESC NULLS LAST, byte_len DESC NULLS LAST) AS n
    FROM transcript_lines WHERE path IS NOT NULL AND byte_start IS NOT NULL AND session_id IS NOT NULL) WHERE n = 1),
parsed AS (
  SELECT session_id, byte_start, byte_start + coalesce(byte_len, 0) AS byte_end, line, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM held),
said AS (
  SELECT session_id, byte_start, byte_end,
    regexp_full_match(line, '\\s*') = false AND coalesce(json_type(j) <> 'OBJECT', true) AS broken,
    CASE WHEN j->>'$.type' = 'user' AND json_type(j, '$.message.content') = 'VARCHAR' AND regexp_matches(j->>'$.message.content', '\\S')
        AND NOT coalesce(json_type(j, '$.isMeta') = 'BOOLEAN' AND (j->>'$.isMeta') = 'true', false) THEN 'user'
      WHEN j->>'$.type' = 'assistant' AND json_type(j, '$.message.content') = 'ARRAY'
        AND len(list_filter(json_extract(j, '$.message.content[*]'), lambda b: coalesce(b->>'$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR' AND regexp_matches(b->>'$.text', '\\S'), false))) > 0 THEN 'assistant' END AS role
  FROM parsed),
linked AS (
  SELECT *, lag(byte_end, 1, 0) OVER w AS came, CASE WHEN role IS NOT NULL THEN
      coalesce(last_value(role IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY byte_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'none') END AS spoke
  FROM said WINDOW w AS (PARTITION BY session_id ORDER BY byte_start))
SELECT session_id FROM linked GROUP BY session_id
HAVING bool_or(broken) OR bool_or(came <> byte_start) OR bool_or(coalesce(role = 'user' AND spoke = 'user', false)) OR bool_or(coalesce(role = 'assistant' AND spoke = 'none', false))
  OR coalesce(arg_max(role, byte_start) FILTER (role IS NOT NULL), 'none') <> 'assistant'""",
    "p5_found": """
SELECT doc_id, CASE WHEN bool_or(regexp_matches(content, '[^\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}。！？]{1000}') AND
    list_max(list_transform(regexp_split_to_array(content, '[\\s\\x{0085}\\x{00a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}。！？]'), lambda x: length(x))) > 8000) THEN 'hard' ELSE 'soft' END AS cut
FROM turns WHERE length(content) > 8000 GROUP BY doc_id""",
}
