"""Queries of the engine's own operators on the tables of turns, transcripts, saves and searches, and SQL that gives the same rows."""

import re
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.config import Settings
from threadmill.functions import text as T
from threadmill.functions.json import decoded_object
from threadmill.operators import fulltext, fusion, incremental, sessions, turns, upkeep, vectors
from threadmill.operators.lines import held_lines
from threadmill.session import table

SETTINGS = Settings()
#: What the queries ask for.
HYBRID_QUERY, HYBRID_N, DIM = "deadlock checkpoint", 5, 64
NOW, DAYS, BRANCH, DELETED = datetime(2026, 6, 1), 180, "dev", datetime(2025, 10, 1)
WORDS = {
    "bm25_and": "stale lock parser",
    "bm25_or": "deadlock OR encoding",
    "bm25_not": "deadlock NOT cache",
    "bm25_prefix": "snap* missing",
    "bm25_phrase": "wrong time zone?",
    "bm25_plus": "broken + pipe checkpoint",
    "bm25_near": "NEAR(guard lock, 6)",
    "bm25_column": "content : deadlock AND (parser OR pool)",
}


def _turns(spark, folder) -> DataFrame:
    return sessions.distinct_turns(table(spark, folder, "turns"))


def _lines(spark, folder) -> DataFrame:
    return table(spark, folder, "transcript_lines")


def _filtered():
    return T.equal_filters(git_branch="main", session_id="", project_root=None) & T.date_filters("timestamp", "2025-07-01", "2026-03-31")


def turn_assembly(spark, folder):
    return turns.assemble(_lines(spark, folder))


def carry_forward(spark, folder):
    rows = turns.carried(turns.entries(_lines(spark, folder)))
    return rows.select("path", "byte_start", F.coalesce("at", F.lit("")).alias("timestamp"), F.coalesce("on", F.lit("")).alias("git_branch"), "turn")


def turn_closing_attr(spark, folder):
    return turns.assemble(_lines(spark, folder)).where("chunk_type = 'turn'").select("path", "turn_index", "timestamp", "git_branch")


def entry_filter(spark, folder):
    rows = turns.kept_entries(turns.entries(_lines(spark, folder)))
    return rows.select("path", "byte_start", F.coalesce("type", F.lit("")).alias("type"), F.col("prompt").isNotNull().alias("opens"), F.coalesce(F.size("texts"), F.lit(-1)).alias("texts"))


def json_field(spark, folder):
    v = F.col("v")
    rows = held_lines(_lines(spark, folder)).withColumn("v", decoded_object("line")).where("v is not null")
    return rows.select("path", "byte_start", turns._string(v, "$.type").alias("type"), turns._string(v, "$.message.role").alias("role"), turns._string(v, "$.gitBranch").alias("branch"))


def head_peek(spark, folder):
    return turns.head_cwd(_lines(spark, folder))


def turn_ids(spark, folder):
    return _turns(spark, folder).select("doc_id", T.key60("doc_id").alias("id"), T.sha16("content").alias("content_hash"))


def truncate_text(spark, folder):
    cut = T.truncated("content", SETTINGS.max_turn_chars)
    stored = F.substring("content", 1, SETTINGS.document_chars)
    return _turns(spark, folder).where("content is not null").select("doc_id", F.length("content").cast("bigint").alias("chars"), T.utf8_bytes("content").cast("bigint").alias("bytes"), F.length(cut).cast("bigint").alias("cut_chars"), T.sha16(cut).alias("cut_hash"), F.length(stored).cast("bigint").alias("stored_chars"), (F.length(T.strip("content")) >= SETTINGS.min_turn_chars).alias("long_enough"))


def content_dedup(spark, folder):
    return table(spark, folder, "documents").where("text is not null").groupBy(T.sha16("text").alias("content_hash")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def anti_join_new(spark, folder):
    stored = table(spark, folder, "search_results")
    return upkeep.new_turns(table(spark, folder, "turns"), stored).select("doc_id")


def reconcile_missing(spark, folder):
    indexed = table(spark, folder, "search_results").where("leg <> 'vector'")
    return upkeep.missing(_turns(spark, folder), indexed).select("doc_id", "session_id", "turn_index", F.substring(T.or_empty("content"), 1, SETTINGS.document_chars).alias("content"))


def term_stats(spark, folder):
    return fulltext.term_stats(_turns(spark, folder))


def _bm25(name):
    def query(spark, folder):
        found = fulltext.search(fulltext.index(_turns(spark, folder)), WORDS[name])
        return found.select("doc_id", F.round(F.col("score") + 0.0, 6).alias("score"))

    return query


def bm25_filtered(spark, folder):
    found = fulltext.search(fulltext.index(_turns(spark, folder)), "timeout", where=_filtered())
    return found.select("doc_id", F.round("score", 6).alias("score"))


def _probe(df):
    return [float(x) for x in df.orderBy("vec_id").first()["embedding"]]


def vector_topk(spark, folder):
    df = table(spark, folder, "embeddings")
    return vectors.nearest(df, _probe(df), 15, "vec_id", "embedding").select("vec_id", F.round("similarity", 6).alias("similarity"), F.round("distance", 6).alias("distance"))


def vector_topk_filtered(spark, folder):
    df = table(spark, folder, "embeddings")
    return vectors.nearest(df, _probe(df), 15, "vec_id", "embedding", F.col("label") == 3).select("vec_id", F.round("similarity", 6).alias("similarity"))


def _candidates(spark, folder):
    rows = table(spark, folder, "search_results").where("query_id is not null and doc_id is not null")
    best = rows.groupBy("query_id", "doc_id").agg(F.max(F.struct("logged_at", "leg", "distance", "bm25", "timestamp")).alias("r"))
    return best.select("query_id", "doc_id", "r.leg", "r.distance", "r.bm25", "r.timestamp")


def rrf_fusion(spark, folder):
    rows = _candidates(spark, folder)
    near = fusion.numbered(rows.where("leg in ('vector', 'both')"), F.asc_nulls_last("distance"), F.col("doc_id"), keys=("query_id",)).select("query_id", "doc_id", "rank")
    words = fusion.numbered(rows.where("leg in ('keyword', 'both')"), F.asc_nulls_last("bm25"), F.col("doc_id"), keys=("query_id",)).select("query_id", "doc_id", "rank")
    return fusion.reciprocal_ranks(near, words, 15, ("query_id",)).select("query_id", "doc_id", "rank", F.round("rrf", 9).alias("rrf"))


def recency_rerank(spark, folder):
    rows = fusion.numbered(_candidates(spark, folder).where("distance is not null and not isnan(distance)"), F.col("distance"), F.col("doc_id"), keys=("query_id",))
    return fusion.by_recency(rows, keys=("query_id",)).select("query_id", "doc_id", F.round("recency", 9).alias("recency"), "place")


def hybrid_search(spark, folder):
    """The flagship: keyword and vector legs over all turns, fused, by recency."""
    stored = _turns(spark, folder).withColumn("timestamp", T.or_empty("timestamp"))
    collection = vectors.embedded(stored.withColumn("content", T.or_empty("content")), "content", lambda: vectors.Hashing(DIM))
    query = [float(x) for x in vectors.Hashing(DIM).embed([HYBRID_QUERY], True)[0]]
    found = fusion.hybrid(fulltext.index(stored), collection, HYBRID_QUERY, query, HYBRID_N, recency=True)
    return found.select("doc_id", "rank", F.round("distance", 6).alias("distance"), F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"))


def context_window(spark, folder):
    stored = _turns(spark, folder)
    targets = stored.where("session_id is not null").groupBy("session_id").agg(F.floor(F.avg("turn_index")).alias("turn_index"))
    return sessions.context(stored, targets, 2).select("session_id", "doc_id", "turn_index", "target", "place")


def index_stats(spark, folder):
    return sessions.statistics(_turns(spark, folder))


def stats_by_type(spark, folder):
    return sessions.by_type(_turns(spark, folder))


def list_sessions(spark, folder):
    return sessions.session_list(_turns(spark, folder))


def session_totals(spark, folder):
    return sessions.session_list(_turns(spark, folder)).agg(F.count("*").alias("sessions"), F.sum("turns").alias("turns"))


def timestamp_bounds(spark, folder):
    ts = T.none_if_empty("timestamp")
    return _turns(spark, folder).groupBy("git_branch").agg(F.min(ts).alias("least"), F.max(ts).alias("greatest"), F.count(ts).alias("dated"))


def file_counts(spark, folder):
    return _lines(spark, folder).where(F.endswith("path", F.lit(".jsonl"))).agg(F.count_distinct("path").alias("files"), F.count_distinct("slug").alias("slugs"))


def date_range(spark, folder):
    return _turns(spark, folder).where(_filtered()).select("doc_id", "timestamp")


def operator_filters(spark, folder):
    where = T.operator_filters({"turn_index_gte": (">=", 1000), "turn_index_lt": ("<", 5000), "chunk_type": "turn", "git_branch": None})
    return _turns(spark, folder).where(where).select("doc_id", "turn_index")


def expire_keep(spark, folder):
    return _turns(spark, folder).where(~upkeep.is_expired(upkeep.cutoff(NOW, DAYS))).select("doc_id")


def delete_session_keep(spark, folder):
    stored = _turns(spark, folder)
    session = stored.agg(F.min(T.none_if_empty("session_id"))).first()[0]
    return stored.where(~upkeep.doomed(session_id=session)).select("doc_id")


def delete_branch_keep(spark, folder):
    return _turns(spark, folder).where(~upkeep.doomed(git_branch=BRANCH)).select("doc_id")


def cleanup_counts(spark, folder):
    old, branch = upkeep.doomed(max_age=upkeep.cutoff(NOW, DAYS)), upkeep.doomed(git_branch=BRANCH)
    return _turns(spark, folder).agg(F.count_if(old).alias("expired"), F.count_if(branch & ~old).alias("of_branch"), F.count("*").alias("before"))


def tombstone_view(spark, folder):
    stored = _turns(spark, folder).where("indexed_at is not null")
    stones = spark.createDataFrame([("git_branch", BRANCH, DELETED)], "column string, value string, deleted_at timestamp_ntz")
    return upkeep.without(stored, stones).select("doc_id")


def page_offset(spark, folder):
    return sessions.page(_turns(spark, folder).select("doc_id", "session_id"), ["doc_id"], 40, 25)


def page_keyset(spark, folder):
    rows = _turns(spark, folder).select(T.key60("doc_id").alias("id"), "doc_id")
    return sessions.page_after(rows, "id", 1 << 59, 25)


def migrate_verify(spark, folder):
    stored = _turns(spark, folder)
    return upkeep.compared(stored, stored.select(*reversed(stored.columns)), "doc_id")


def slug_encode(spark, folder):
    return _turns(spark, folder).select(T.or_empty("project_root").alias("project_root")).distinct().select("project_root", T.slug_of("project_root").alias("slug"))


BASE = "/home/dev/.transcripts/projects"


def path_parts(spark, folder):
    return _lines(spark, folder).select("path").distinct().select("path", T.base_name("path").alias("file"), T.stem("path").alias("stem"), T.slug_of_path("path", BASE).alias("slug"))


def slug_lookup(spark, folder):
    paths = _lines(spark, folder).where("path is not null").groupBy("path").agg(F.min("slug").alias("slug"))
    return upkeep.roots(paths, table(spark, folder, "slug_map"), turns.head_cwd(_lines(spark, folder)))


def slug_register(spark, folder):
    return upkeep.registered(table(spark, folder, "slug_map"), table(spark, folder, "index_state").where("project_root <> ''").select("project_root"))


def state_merge(spark, folder):
    saves = table(spark, folder, "index_state").select("path", "last_byte_offset", "project_root", "status")
    return upkeep.merged_states(saves.where("status = 'ok'").drop("status"), saves.where("status is distinct from 'ok'").drop("status"))


def last_offsets(spark, folder):
    return incremental.last_saves(table(spark, folder, "index_state")).select("path", "offset")


def stale_files(spark, folder):
    files = _lines(spark, folder).where("path is not null").groupBy("path").agg(F.max(F.col("byte_start") + F.col("byte_len")).alias("size"))
    state = incremental.last_saves(table(spark, folder, "index_state")).select("path", F.col("offset").alias("last_byte_offset"))
    return upkeep.stale_files(files, state)


def debounce_batches(spark, folder):
    rows = table(spark, folder, "events").select("user_id", "ts", "event_id")
    return upkeep.bursts(rows, ["user_id"], "ts", 600.0).groupBy("user_id", "burst").agg(F.count("*").alias("events"), F.min("event_id").alias("first_event"))


def format_header(spark, folder):
    return _turns(spark, folder).select("doc_id", sessions.heading(F.col("turn_index")).alias("heading"))


def similarity_display(spark, folder):
    rows = _candidates(spark, folder).where("leg <> 'keyword' and distance between -10 and 10")
    return rows.select("query_id", "doc_id", F.round(1 - F.col("distance"), 6).alias("similarity"))


NAMES = (
    "turn_assembly carry_forward turn_closing_attr entry_filter json_field head_peek turn_ids truncate_text content_dedup anti_join_new reconcile_missing term_stats bm25_filtered vector_topk vector_topk_filtered rrf_fusion recency_rerank "
    "hybrid_search context_window index_stats stats_by_type list_sessions session_totals timestamp_bounds file_counts date_range operator_filters expire_keep delete_session_keep delete_branch_keep cleanup_counts tombstone_view page_offset "
    "page_keyset migrate_verify slug_encode path_parts slug_lookup slug_register state_merge last_offsets stale_files debounce_batches format_header similarity_display"
).split()
QUERIES = {n: globals()[n] for n in NAMES} | {n: _bm25(n) for n in WORDS}

# SQL

_SPACE = "".join(chr(c) for c in (*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
_STRIP = lambda x: f"trim({x}, '{_SPACE}')"
_STORED = "stored AS (SELECT * FROM turns WHERE doc_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY indexed_at, content, session_id, transcript_file, turn_index) = 1)"
_HELD = """held AS (SELECT * FROM transcript_lines WHERE path IS NOT NULL AND byte_start IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY path, byte_start ORDER BY seen_at DESC NULLS LAST, sha256(line) DESC NULLS LAST, byte_len DESC NULLS LAST) = 1)"""
_JSON = lambda p: f"(CASE WHEN json_type(j, '{p}') = 'VARCHAR' THEN nullif(j->>'{p}', '') END)"
_ENTRIES = f"""{_HELD},
parsed AS (SELECT *, CAST(line AS JSON) AS j FROM held WHERE json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT'),
entries AS (SELECT path, session_id, transcript_file, byte_start, byte_start + coalesce(byte_len, 0) AS byte_end, octet_length(encode({_STRIP('line')})) AS n_bytes,
  {_JSON('$.type')} AS type, {_JSON('$.timestamp')} AS ts, {_JSON('$.gitBranch')} AS branch, {_JSON('$.cwd')} AS cwd,
  CASE WHEN {_JSON('$.type')} = 'summary' THEN {_JSON('$.summary')} END AS summary,
  CASE WHEN {_JSON('$.type')} = 'user' AND json_type(j, '$.message.content') = 'VARCHAR' AND NOT coalesce(json_type(j, '$.isMeta') = 'BOOLEAN' AND (j->>'$.isMeta') = 'true', false)
    THEN nullif({_STRIP("(j->>'$.message.content')")}, '') END AS prompt,
  CASE WHEN {_JSON('$.type')} = 'assistant' AND json_type(j, '$.message.content') = 'ARRAY' THEN
    list_filter(list_transform(list_filter(json_extract(j, '$.message.content[*]'), lambda b: coalesce(b->>'$.type' = 'text' AND json_type(b, '$.text') = 'VARCHAR', false)), lambda b: {_STRIP("(b->>'$.text')")}), lambda t: t <> '') END AS texts
  FROM parsed),
run AS (SELECT *, prompt IS NOT NULL OR coalesce(type = 'summary', false) AS boundary, last_value(ts IGNORE NULLS) OVER w AS ats, last_value(branch IGNORE NULLS) OVER w AS onb,
  sum(CASE WHEN prompt IS NOT NULL OR coalesce(type = 'summary', false) THEN 1 ELSE 0 END) OVER w AS turn
  FROM entries WINDOW w AS (PARTITION BY path ORDER BY byte_start ROWS UNBOUNDED PRECEDING))"""
_ASSEMBLED = f"""{_ENTRIES},
ends AS (SELECT path, arg_max(ats, byte_start) FILTER (ats IS NOT NULL) AS end_at, arg_max(onb, byte_start) FILTER (onb IS NOT NULL) AS end_on FROM run GROUP BY path),
heads AS (SELECT *, lead(ats) OVER p AS next_at, lead(onb) OVER p AS next_on, lead(byte_start) OVER p IS NOT NULL AS closed FROM run WHERE boundary WINDOW p AS (PARTITION BY path ORDER BY byte_start)),
said AS (SELECT path, turn, array_to_string(flatten(list(texts ORDER BY byte_start)), chr(10) || chr(10)) AS reply FROM run WHERE turn > 0 AND len(texts) > 0 GROUP BY path, turn),
whole AS (SELECT h.path, h.session_id, h.transcript_file, byte_start AS turn_index, 'User: ' || prompt || coalesce(chr(10) || chr(10) || 'Assistant: ' || reply, '') AS t,
  CASE WHEN closed THEN next_at ELSE end_at END AS timestamp, CASE WHEN closed THEN next_on ELSE end_on END AS git_branch, 'turn' AS chunk_type
  FROM heads h LEFT JOIN said USING (path, turn) JOIN ends USING (path) WHERE prompt IS NOT NULL),
made AS (SELECT * REPLACE (CASE WHEN length(t) > 8000 THEN substr(t, 1, 8000) || chr(10) || chr(10) || '[truncated]' ELSE t END AS t) FROM whole
  UNION ALL SELECT path, session_id, transcript_file, byte_end - n_bytes, 'Session Summary: ' || summary, ats, onb, 'summary' FROM heads WHERE summary IS NOT NULL),
done AS (SELECT path, t AS text, session_id || '::' || substr(sha256(turn_index || ':' || t), 1, 16) AS doc_id, session_id, transcript_file, turn_index, coalesce(timestamp, '') AS timestamp, coalesce(git_branch, '') AS git_branch, chunk_type
  FROM made WHERE chunk_type = 'summary' OR length({_STRIP('t')}) >= 20)"""
_TERMS = lambda c: f"regexp_extract_all(translate(lower(coalesce({c}, '')), '{fulltext.MARKED}', '{fulltext.PLAIN}'), '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"
_CANDIDATES = """candidates AS (SELECT * FROM search_results WHERE query_id IS NOT NULL AND doc_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY logged_at DESC NULLS LAST, leg DESC NULLS LAST, distance DESC NULLS LAST, bm25 DESC NULLS LAST, timestamp DESC NULLS LAST) = 1)"""
_SAVES = "saves AS (SELECT path, coalesce(last_byte_offset, 0) AS off FROM index_state WHERE status = 'ok' AND path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY run_no DESC NULLS LAST, saved_at DESC NULLS LAST, last_byte_offset DESC NULLS LAST) = 1)"
_CUTOFF = "'2025-12-03T00:00:00'"
_EXPIRED = f"coalesce(timestamp < {_CUTOFF} AND timestamp <> '', false)"
_RANGE = "git_branch = 'main' AND timestamp >= '2025-07-01' AND timestamp <= '2026-03-31T23:59:59'"
_HEAD_CWD = f"""{_HELD},
head AS (SELECT path, byte_start, CASE WHEN json_valid(line) THEN CAST(line AS JSON) END AS j FROM held QUALIFY row_number() OVER (PARTITION BY path ORDER BY byte_start) <= 30),
cwds AS (SELECT path, byte_start, CASE WHEN json_type(j) = 'OBJECT' THEN {_JSON('$.cwd')} END AS cwd FROM head),
first_cwd AS (SELECT path, coalesce(arg_min(cwd, byte_start) FILTER (cwd <> '/' AND length(cwd) - length(replace(cwd, '/', '')) >= 2), '') AS cwd FROM cwds GROUP BY path)"""


def _hits(c: str, terms: list[str], prefix: bool = False) -> str:
    """SQL for how often a phrase stands in a list of terms."""
    if len(terms) == 1:
        test = f"starts_with(x, '{terms[0]}')" if prefix else f"x = '{terms[0]}'"
        return f"len(list_filter({c}, lambda x: {test}))"
    tests = " AND ".join(f"{c}[i + {k}] = '{t}'" for k, t in enumerate(terms))
    return f"len(list_filter(range(1, len({c}) + 1), lambda i: coalesce({tests}, false)))"


def _bm25_sql(phrases: list[tuple[list[str], bool]], match: str, where: str = "true", limit: str = "ORDER BY raw, doc_id LIMIT 15", only: str | None = None) -> str:
    """``match`` names the phrases h0, h1, ..."""
    f = ", ".join(f"{_hits('c', t, p)} AS f{i}, {_hits('c', t, p)} + {'0' if only else _hits('d', t, p)} > 0 AS h{i}" for i, (t, p) in enumerate(phrases))
    n = ", ".join(f"count(*) FILTER (h{i}) AS n{i}" for i in range(len(phrases)))
    parts = " + ".join(
        f"(CASE WHEN ln((n_docs - n{i} + 0.5) / (n{i} + 0.5::DOUBLE)) <= 0 THEN 1e-6 ELSE ln((n_docs - n{i} + 0.5::DOUBLE) / (n{i} + 0.5::DOUBLE)) END) * f{i} * 2.2::DOUBLE / (f{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * size / mean))" for i in range(len(phrases))
    )
    return f"""WITH {_STORED},
terms AS (SELECT *, {_TERMS('content')} AS c, {_TERMS('doc_id')} AS d FROM stored),
counted AS (SELECT *, len(c) + len(d) AS size, {f} FROM terms),
corpus AS (SELECT count(*) AS n_docs, avg(size) AS mean, {n} FROM counted),
rated AS (SELECT doc_id, timestamp, -({parts}) AS raw FROM counted, corpus WHERE ({match}) AND {where})
SELECT doc_id, round(raw, 6) AS score FROM rated {limit}"""


_NEAR = "h0 AND h1 AND len(list_filter(range(1, len(c) + 1), lambda i: (c[i] = 'guard' AND len(list_intersect(c[greatest(i - 7, 1):i], ['lock'])) > 0) OR (c[i] = 'lock' AND len(list_intersect(c[greatest(i - 7, 1):i], ['guard'])) > 0))) > 0"
_HASHED = f"list_transform({_TERMS('content')}, lambda t: CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % {DIM})"
_QUERY_PLACES = [vectors.Hashing(DIM).place(t) for t in fulltext.fold(HYBRID_QUERY)]

ORACLES = {
    "turn_assembly": f"WITH {_ASSEMBLED} SELECT * FROM done",
    "carry_forward": f"WITH {_ENTRIES} SELECT path, byte_start, coalesce(ats, '') AS timestamp, coalesce(onb, '') AS git_branch, CAST(turn AS BIGINT) AS turn FROM run",
    "turn_closing_attr": f"WITH {_ASSEMBLED} SELECT path, turn_index, timestamp, git_branch FROM done WHERE chunk_type = 'turn'",
    "entry_filter": f"WITH {_ENTRIES} SELECT path, byte_start, coalesce(type, '') AS type, prompt IS NOT NULL AS opens, CAST(coalesce(len(texts), -1) AS INTEGER) AS texts FROM entries WHERE coalesce(type, '') NOT IN ('file-history-snapshot', 'progress', 'system', 'queue-operation')",
    "json_field": f"WITH {_HELD}, parsed AS (SELECT *, CAST(line AS JSON) AS j FROM held WHERE json_valid(line) AND json_type(CASE WHEN json_valid(line) THEN line END) = 'OBJECT') SELECT path, byte_start, {_JSON('$.type')} AS type, {_JSON('$.message.role')} AS role, {_JSON('$.gitBranch')} AS branch FROM parsed",
    "head_peek": f"WITH {_HEAD_CWD} SELECT path, cwd FROM first_cwd",
    "turn_ids": f"WITH {_STORED} SELECT doc_id, CAST('0x' || substr(sha256(doc_id), 1, 15) AS BIGINT) AS id, substr(sha256(content), 1, 16) AS content_hash FROM stored",
    "truncate_text": f"WITH {_STORED}, cut AS (SELECT *, CASE WHEN length(content) > 8000 THEN substr(content, 1, 8000) || chr(10) || chr(10) || '[truncated]' ELSE content END AS t FROM stored WHERE content IS NOT NULL) SELECT doc_id, length(content) AS chars, octet_length(encode(content)) AS bytes, length(t) AS cut_chars, substr(sha256(t), 1, 16) AS cut_hash, length(substr(content, 1, 65535)) AS stored_chars, length({_STRIP('content')}) >= 20 AS long_enough FROM cut",
    "content_dedup": "SELECT substr(sha256(text), 1, 16) AS content_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "anti_join_new": "SELECT DISTINCT doc_id FROM turns t WHERE doc_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM search_results s WHERE s.doc_id = t.doc_id)",
    "reconcile_missing": f"WITH {_STORED} SELECT doc_id, session_id, turn_index, substr(coalesce(content, ''), 1, 65535) AS content FROM stored t WHERE NOT EXISTS (SELECT 1 FROM search_results s WHERE s.doc_id = t.doc_id AND s.leg <> 'vector')",
    "term_stats": f"WITH {_STORED}, words AS (SELECT doc_id, unnest({_TERMS('content')}) AS term FROM stored), per AS (SELECT term, doc_id, count(*) AS n FROM words GROUP BY ALL) SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS cf FROM per GROUP BY term",
    "bm25_and": _bm25_sql([(["stale"], False), (["lock"], False), (["parser"], False)], "h0 AND h1 AND h2"),
    "bm25_or": _bm25_sql([(["deadlock"], False), (["encoding"], False)], "h0 OR h1"),
    "bm25_not": _bm25_sql([(["deadlock"], False), (["cache"], False)], "h0 AND NOT h1"),
    "bm25_prefix": _bm25_sql([(["snap"], True), (["missing"], False)], "h0 AND h1"),
    "bm25_phrase": _bm25_sql([(["wrong", "time", "zone"], False)], "h0"),
    "bm25_plus": _bm25_sql([(["broken", "pipe"], False), (["checkpoint"], False)], "h0 AND h1"),
    "bm25_near": _bm25_sql([(["guard"], False), (["lock"], False)], _NEAR),
    "bm25_column": _bm25_sql([(["deadlock"], False), (["parser"], False), (["pool"], False)], "f0 > 0 AND (h1 OR h2)"),
    "bm25_filtered": _bm25_sql([(["timeout"], False)], "h0", _RANGE),
    "vector_topk": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS c FROM embeddings, q) SELECT vec_id, round(c, 6) AS similarity, round(1 - c, 6) AS distance FROM s ORDER BY c DESC, vec_id LIMIT 15",
    "vector_topk_filtered": "WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings ORDER BY vec_id LIMIT 1), s AS (SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], q) AS c FROM embeddings, q WHERE label = 3) SELECT vec_id, round(c, 6) AS similarity FROM s ORDER BY c DESC, vec_id LIMIT 15",
    "rrf_fusion": f"""WITH {_CANDIDATES},
a AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY distance NULLS LAST, doc_id) AS r FROM candidates WHERE leg IN ('vector', 'both')),
b AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 NULLS LAST, doc_id) AS r FROM candidates WHERE leg IN ('keyword', 'both')),
m AS (SELECT query_id, doc_id, a.r AS r1, b.r AS r2, coalesce(1 / (60 + a.r), 0.0) + coalesce(1 / (60 + b.r), 0.0) AS rrf FROM a FULL JOIN b USING (query_id, doc_id)),
n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, r1 NULLS LAST, r2) AS rank FROM m)
SELECT query_id, doc_id, CAST(rank AS INTEGER) AS rank, round(rrf, 9) AS rrf FROM n WHERE rank <= 15""",
    "recency_rerank": f"""WITH {_CANDIDATES},
c AS (SELECT *, nullif(timestamp, '') AS ts, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id) AS rank FROM candidates WHERE distance IS NOT NULL AND NOT isnan(distance)),
r AS (SELECT *, CASE WHEN ts IS NULL OR min(ts) OVER q = max(ts) OVER q THEN 0.5 ELSE percent_rank() OVER (PARTITION BY query_id, ts IS NULL ORDER BY ts) END AS recency, count(ts) OVER q AS dated FROM c WINDOW q AS (PARTITION BY query_id))
SELECT query_id, doc_id, round(recency, 9) AS recency, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN dated < 2 THEN 0.0 ELSE -((1 - distance) * (1 + 0.3::DOUBLE * recency)) END, rank) AS INTEGER) AS place FROM r""",
    "hybrid_search": "",
    "context_window": f"""WITH {_STORED},
targets AS (SELECT session_id, CAST(floor(avg(turn_index)) AS BIGINT) AS target FROM stored WHERE session_id IS NOT NULL GROUP BY session_id),
placed AS (SELECT session_id, doc_id, turn_index, target, row_number() OVER (PARTITION BY session_id ORDER BY turn_index, doc_id) AS pos, row_number() OVER (PARTITION BY session_id ORDER BY abs(turn_index - target), turn_index, doc_id) AS near FROM stored JOIN targets USING (session_id)),
hit AS (SELECT session_id, pos AS mid FROM placed WHERE near = 1)
SELECT session_id, doc_id, turn_index, target, CAST(pos - mid AS INTEGER) AS place FROM placed JOIN hit USING (session_id) WHERE pos BETWEEN mid - 2 AND mid + 2""",
    "index_stats": f"WITH {_STORED} SELECT count(*) AS total_turns, count(DISTINCT nullif(session_id, '')) AS sessions, string_agg(DISTINCT nullif(git_branch, ''), ', ' ORDER BY nullif(git_branch, '')) AS branches FROM stored",
    "stats_by_type": f"WITH {_STORED} SELECT chunk_type, count(*) AS n FROM stored GROUP BY 1",
    "list_sessions": f"WITH {_STORED} SELECT session_id, count(*) AS turns, coalesce(string_agg(DISTINCT nullif(git_branch, ''), ', ' ORDER BY nullif(git_branch, '')), '') AS branches, coalesce(min(nullif(timestamp, '')), '') AS first_seen, coalesce(max(nullif(timestamp, '')), '') AS last_seen FROM stored WHERE session_id <> '' GROUP BY 1",
    "session_totals": f"WITH {_STORED} SELECT count(DISTINCT session_id) AS sessions, count(*) AS turns FROM stored WHERE session_id <> ''",
    "timestamp_bounds": f"WITH {_STORED} SELECT git_branch, min(nullif(timestamp, '')) AS least, max(nullif(timestamp, '')) AS greatest, count(nullif(timestamp, '')) AS dated FROM stored GROUP BY 1",
    "file_counts": "SELECT count(DISTINCT path) AS files, count(DISTINCT slug) AS slugs FROM transcript_lines WHERE path LIKE '%.jsonl'",
    "date_range": f"WITH {_STORED} SELECT doc_id, timestamp FROM stored WHERE {_RANGE}",
    "operator_filters": f"WITH {_STORED} SELECT doc_id, turn_index FROM stored WHERE turn_index >= 1000 AND turn_index < 5000 AND chunk_type = 'turn'",
    "expire_keep": f"WITH {_STORED} SELECT doc_id FROM stored WHERE NOT {_EXPIRED}",
    "delete_session_keep": f"WITH {_STORED} SELECT doc_id FROM stored WHERE session_id IS DISTINCT FROM (SELECT min(nullif(session_id, '')) FROM stored)",
    "delete_branch_keep": f"WITH {_STORED} SELECT doc_id FROM stored WHERE git_branch IS DISTINCT FROM '{BRANCH}'",
    "cleanup_counts": f"WITH {_STORED} SELECT count(*) FILTER ({_EXPIRED}) AS expired, count(*) FILTER (git_branch = '{BRANCH}' AND NOT {_EXPIRED}) AS of_branch, count(*) AS before FROM stored",
    "tombstone_view": f"WITH {_STORED} SELECT doc_id FROM stored WHERE indexed_at IS NOT NULL AND NOT coalesce(git_branch = '{BRANCH}' AND indexed_at <= TIMESTAMP '{DELETED}', false)",
    "page_offset": f"WITH {_STORED} SELECT doc_id, session_id FROM stored ORDER BY doc_id LIMIT 25 OFFSET 40",
    "page_keyset": f"WITH {_STORED}, keyed AS (SELECT CAST('0x' || substr(sha256(doc_id), 1, 15) AS BIGINT) AS id, doc_id FROM stored) SELECT id, doc_id FROM keyed WHERE id > {1 << 59} ORDER BY id LIMIT 25",
    "migrate_verify": f"WITH {_STORED} SELECT count(*) AS source_rows, count(*) AS target_rows, count(DISTINCT doc_id) AS source_keys, count(DISTINCT doc_id) AS target_keys, true AS agree FROM stored",
    "slug_encode": f"WITH {_STORED} SELECT DISTINCT coalesce(project_root, '') AS project_root, replace(replace(coalesce(project_root, ''), '/', '-'), '.', '-') AS slug FROM stored",
    "path_parts": f"SELECT DISTINCT path, split_part(path, '/', -1) AS file, regexp_replace(split_part(path, '/', -1), '(.)\\.[^.]*$', '\\1') AS stem, CASE WHEN starts_with(path, '{BASE}/') AND contains(substr(path, {len(BASE) + 2}), '/') THEN split_part(substr(path, {len(BASE) + 2}), '/', 1) END AS slug FROM transcript_lines",
    "slug_lookup": f"WITH {_HEAD_CWD}, paths AS (SELECT path, min(slug) AS slug FROM transcript_lines WHERE path IS NOT NULL GROUP BY path), known AS (SELECT slug, max(nullif(project_root, '')) AS mapped FROM slug_map WHERE slug IS NOT NULL GROUP BY slug) SELECT p.path, coalesce(mapped, nullif(cwd, ''), '') AS project_root FROM paths p LEFT JOIN known USING (slug) LEFT JOIN first_cwd f ON f.path = p.path",
    "slug_register": "WITH fresh AS (SELECT replace(replace(project_root, '/', '-'), '.', '-') AS slug, max(project_root) AS project_root FROM index_state WHERE project_root <> '' GROUP BY 1) SELECT slug, project_root FROM slug_map WHERE slug IS NULL OR slug NOT IN (SELECT slug FROM fresh) UNION ALL SELECT * FROM fresh",
    "state_merge": "SELECT path, coalesce(last_byte_offset, 0) AS last_byte_offset, coalesce(project_root, '') AS project_root FROM index_state WHERE path IS NOT NULL QUALIFY row_number() OVER (PARTITION BY path ORDER BY CASE WHEN status = 'ok' THEN 0 ELSE 1 END, last_byte_offset DESC NULLS LAST, project_root DESC NULLS LAST) = 1",
    "last_offsets": f'WITH {_SAVES} SELECT path, off AS "offset" FROM saves',
    "stale_files": f'WITH {_SAVES}, files AS (SELECT path, max(byte_start + byte_len) AS size FROM transcript_lines WHERE path IS NOT NULL GROUP BY path) SELECT path, size, coalesce(off, 0) AS "offset" FROM files LEFT JOIN saves USING (path) WHERE coalesce(off, 0) < size',
    "debounce_batches": "WITH g AS (SELECT user_id, ts, event_id, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w > 600000000 THEN 1 ELSE 0 END AS later FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(later) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g) SELECT user_id, CAST(burst AS BIGINT) AS burst, count(*) AS events, min(event_id) AS first_event FROM b GROUP BY user_id, burst",
    "format_header": f"""WITH {_STORED} SELECT doc_id, '**Result ' || turn_index || '**' || coalesce(' (' || nullif(substr(timestamp, 1, 19), '') || ')', '') || coalesce(' [' || nullif(git_branch, '') || ']', '')
  || coalesce(' project:' || nullif(split_part(regexp_replace(project_root, '/+$', ''), '/', -1), ''), '') || coalesce(' session:' || nullif(session_id, ''), '') AS heading FROM stored""",
    "similarity_display": f"WITH {_CANDIDATES} SELECT query_id, doc_id, round(1 - distance, 6) AS similarity FROM candidates WHERE leg <> 'keyword' AND distance BETWEEN -10 AND 10",
}
_KEYWORD = re.sub(r"\nSELECT doc_id, round\(raw, 6\) AS score FROM rated .*$", "", _bm25_sql([([t], False) for t in fulltext.fold(HYBRID_QUERY)], "h0 AND h1"))
ORACLES["hybrid_search"] = f"""{_KEYWORD},
words AS (SELECT doc_id, row_number() OVER (ORDER BY raw, doc_id) AS r2 FROM (SELECT * FROM rated ORDER BY raw, doc_id LIMIT {3 * HYBRID_N})),
places AS (SELECT doc_id, unnest({_HASHED}) AS place FROM stored),
counts AS (SELECT doc_id, place, count(*)::DOUBLE AS n FROM places GROUP BY ALL),
cosines AS (SELECT doc_id, sum(n * (CASE WHEN place = {_QUERY_PLACES[0]} THEN 1 ELSE 0 END + CASE WHEN place = {_QUERY_PLACES[1]} THEN 1 ELSE 0 END)) / (sqrt(sum(n * n)) * sqrt({4 if _QUERY_PLACES[0] == _QUERY_PLACES[1] else 2}.0::DOUBLE)) AS c FROM counts GROUP BY doc_id),
near AS (SELECT doc_id, 1 - c AS distance, row_number() OVER (ORDER BY c DESC, doc_id) AS r1 FROM (SELECT * FROM cosines ORDER BY c DESC, doc_id LIMIT {3 * HYBRID_N})),
fused AS (SELECT doc_id, r1, r2, coalesce(distance, 0.0) AS distance, coalesce(1 / (60 + r1), 0.0) + coalesce(1 / (60 + r2), 0.0) AS rrf FROM near FULL JOIN words USING (doc_id)),
cut AS (SELECT *, row_number() OVER (ORDER BY rrf DESC, r1 NULLS LAST, r2) AS prior FROM fused QUALIFY prior <= {3 * HYBRID_N}),
dated AS (SELECT c.*, nullif(timestamp, '') AS ts FROM cut c JOIN stored USING (doc_id)),
recent AS (SELECT *, CASE WHEN ts IS NULL OR min(ts) OVER () = max(ts) OVER () THEN 0.5 ELSE percent_rank() OVER (PARTITION BY ts IS NULL ORDER BY ts) END AS recency, count(ts) OVER () AS known FROM dated),
final AS (SELECT *, (1 - distance) * (1 + 0.3::DOUBLE * recency) AS score FROM recent),
placed AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN known < 2 THEN 0.0 ELSE -score END, prior) AS rank FROM final)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance, round(rrf, 9) AS rrf, round(score, 6) AS score FROM placed WHERE rank <= {HYBRID_N}"""
