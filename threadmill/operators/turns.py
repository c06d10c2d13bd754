"""Transcript entries and the turns that they make (FL6-FL10, WN1-WN3, AG5, SC5).

A plain prompt opens a turn, assistant texts gather in it, the next prompt or summary closes it. Timestamp and branch
of a turn are those carried forward up to the entry that closes it. Transcripts are ordered in blocks of their bytes
and turns are joined by their number, so no task holds a whole long transcript.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.config import Settings
from threadmill.functions import blocks
from threadmill.functions.json import decoded_object, elements, is_string
from threadmill.functions.text import is_blank, none_if_empty, sha16, strip, truncated
from threadmill.operators.lines import held_lines
from threadmill.session import cut

_DEFAULT = Settings()


def _string(v: Column, path: str) -> Column:
    """The string at a path of a variant; null where it is of another type, absent or empty."""
    x = F.try_variant_get(v, path, "variant")
    return none_if_empty(F.when(is_string(x), F.try_variant_get(v, path, "string")))


def text_of(v: Column) -> Column:
    """The non-blank string that a variant is, else null (FL7, FL8)."""
    s = F.try_variant_get(v, "$", "string")
    return F.when(is_string(v) & ~is_blank(s), s)


def entries(lines: DataFrame) -> DataFrame:
    """The decodable lines that hold, with typed columns (FL7-FL9, FN7, FN8).

    path, session_id, transcript_file, byte_start, byte_end, n_bytes (of the stripped line), type, timestamp,
    branch, cwd, summary, prompt (text that opens a turn), texts (of an assistant). Absent and empty are null.
    Blank and undecodable lines and JSON that is no object are left out.
    """
    held = held_lines(lines.select("path", "session_id", "transcript_file", "byte_start", "byte_len", "line", "seen_at"))
    v = F.col("v")
    content = F.try_variant_get(v, "$.message.content", "variant")
    blocks_of = F.filter(elements(content), lambda b: F.try_variant_get(b, "$.type", "string") == "text")
    texts = F.filter(F.transform(blocks_of, lambda b: text_of(F.try_variant_get(b, "$.text", "variant"))), lambda t: t.isNotNull())
    meta = F.coalesce((F.schema_of_variant(F.try_variant_get(v, "$.isMeta", "variant")) == "BOOLEAN") & F.try_variant_get(v, "$.isMeta", "boolean"), F.lit(False))
    kind = _string(v, "$.type")
    return held.withColumn("v", decoded_object("line")).where("v is not null").select(
        "path", "session_id", "transcript_file", "byte_start", (F.col("byte_start") + F.coalesce("byte_len", F.lit(0))).alias("byte_end"), F.octet_length(strip("line")).alias("n_bytes"),
        kind.alias("type"), _string(v, "$.timestamp").alias("timestamp"), _string(v, "$.gitBranch").alias("branch"), _string(v, "$.cwd").alias("cwd"),
        F.when(kind == "summary", _string(v, "$.summary")).alias("summary"),
        F.when((kind == "user") & ~meta, strip(text_of(content))).alias("prompt"),
        F.when(kind == "assistant", F.transform(texts, strip)).alias("texts"),
    )


def kept_entries(rows: DataFrame, settings: Settings = _DEFAULT) -> DataFrame:
    """FL6: the entries whose type takes part in a conversation."""
    return rows.where(~F.coalesce(F.col("type").isin(*settings.skipped_types), F.lit(False)))


def carried(rows: DataFrame, settings: Settings = _DEFAULT) -> DataFrame:
    """WN1: entries with the last timestamp and branch so far (also of skipped types) and the number of the turn they are in."""
    boundary = (F.col("prompt").isNotNull() | F.col("type").eqNullSafe("summary")).cast("bigint")
    return blocks.scan(rows, ["path"], "byte_start", {"at": F.col("timestamp"), "on": F.col("branch")}, {"turn": boundary}, settings.block_bytes)


def assemble(lines: DataFrame, settings: Settings = _DEFAULT) -> DataFrame:
    """The turns of whole transcripts: text, doc_id, session_id, transcript_file, turn_index, timestamp, git_branch, chunk_type.

    Absent values are ''. Turns of fewer than ``min_turn_chars`` characters are left out, longer ones than
    ``max_turn_chars`` cut; a summary closes the turn before it and is a row of its own. Empty tables: no rows.
    """
    rows = cut(carried(entries(lines), settings))  # decoded once for the four uses below
    is_boundary = F.col("prompt").isNotNull() | F.col("type").eqNullSafe("summary")
    heads = rows.where(is_boundary)
    closing = heads.select(F.col("path").alias("__p"), (F.col("turn") - 1).alias("__t"), F.col("at").alias("close_at"), F.col("on").alias("close_on"))
    ends = rows.groupBy(F.col("path").alias("__e")).agg(F.max_by("at", F.when(F.col("at").isNotNull(), F.col("byte_start"))).alias("end_at"), F.max_by("on", F.when(F.col("on").isNotNull(), F.col("byte_start"))).alias("end_on"))
    said = rows.where("turn > 0 and size(texts) > 0").groupBy(F.col("path").alias("__s"), F.col("turn").alias("__n")).agg(F.array_sort(F.collect_list(F.struct("byte_start", "texts"))).alias("said"))
    said = said.select("__s", "__n", F.array_join(F.flatten(F.transform("said", lambda x: x["texts"])), "\n\n").alias("reply"))

    starts = heads.where("prompt is not null").select("path", "session_id", "transcript_file", "byte_start", "turn", "prompt")
    starts = starts.join(said, (starts["path"] == said["__s"]) & (starts["turn"] == said["__n"]), "left")
    starts = starts.join(closing, (starts["path"] == closing["__p"]) & (starts["turn"] == closing["__t"]), "left").join(ends, starts["path"] == ends["__e"])
    text = truncated(F.concat(F.lit("User: "), F.col("prompt"), F.coalesce(F.concat(F.lit("\n\nAssistant: "), F.col("reply")), F.lit(""))), settings.max_turn_chars)
    closed = F.col("__t").isNotNull()
    turns = starts.select(
        "path", "session_id", "transcript_file", F.col("byte_start").alias("turn_index"), text.alias("text"),
        F.when(closed, F.col("close_at")).otherwise(F.col("end_at")).alias("timestamp"), F.when(closed, F.col("close_on")).otherwise(F.col("end_on")).alias("git_branch"), F.lit("turn").alias("chunk_type"),
    ).where(F.length(strip("text")) >= settings.min_turn_chars)
    summaries = heads.where("summary is not null").select(
        "path", "session_id", "transcript_file", (F.col("byte_end") - F.col("n_bytes")).alias("turn_index"), F.concat(F.lit("Session Summary: "), F.col("summary")).alias("text"),
        F.col("at").alias("timestamp"), F.col("on").alias("git_branch"), F.lit("summary").alias("chunk_type"),
    )
    out = turns.unionByName(summaries)
    doc_id = F.concat("session_id", F.lit("::"), sha16(F.concat(F.col("turn_index").cast("string"), F.lit(":"), F.col("text"))))
    return out.select("path", "text", doc_id.alias("doc_id"), "session_id", "transcript_file", "turn_index", F.coalesce("timestamp", F.lit("")).alias("timestamp"), F.coalesce("git_branch", F.lit("")).alias("git_branch"), "chunk_type")


def head_cwd(lines: DataFrame, most: int = 30) -> DataFrame:
    """SC5: (path, cwd), the first usable working directory within the first ``most`` lines of each transcript; '' where there is none.

    Blank and bad lines count. A directory is usable if it is neither '' nor '/' and has two slashes at least.
    """
    held = held_lines(lines.select("path", "byte_start", "byte_len", "line", "seen_at"))
    head = held.withColumn("n", F.row_number().over(Window.partitionBy("path").orderBy("byte_start"))).where(F.col("n") <= most)
    cwd = _string(decoded_object("line"), "$.cwd")
    usable = (cwd != "/") & (F.length(cwd) - F.length(F.replace(cwd, F.lit("/"), F.lit(""))) >= 2)
    rows = head.select("path", "byte_start", F.when(usable, cwd).alias("cwd"))
    return rows.groupBy("path").agg(F.coalesce(F.min_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("byte_start"))), F.lit("")).alias("cwd"))
