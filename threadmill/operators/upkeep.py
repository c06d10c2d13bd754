"""Keeping the store: what to insert, delete, expire, repair and copy (SK1, SK8, SC3, JN1, JN2, JN4, MT1-MT5, RC1, MG1, AG9, AG10)."""

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions import blocks
from threadmill.functions.text import slug_of


def new_turns(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """SK1, JN1: incoming turns, each doc_id once, that are not stored yet."""
    return incoming.where("doc_id is not null").dropDuplicates(["doc_id"]).join(stored.select("doc_id"), "doc_id", "left_anti")


def missing(stored: DataFrame, index: DataFrame) -> DataFrame:
    """RC1, JN2, PJ3: stored rows that the index lacks; ids are compared first, rows are fetched for the missing ones only."""
    ids = stored.select("doc_id").distinct().join(index.select("doc_id"), "doc_id", "left_anti")
    return stored.join(ids, "doc_id", "left_semi")


def stale_files(files: DataFrame, state: DataFrame) -> DataFrame:
    """SC3, JN5: files (path, size) with more bytes than their saved offset (0 where there is none), and that offset."""
    saved = state.select("path", F.col("last_byte_offset").alias("offset"))
    return files.join(saved, "path", "left").withColumn("offset", F.coalesce("offset", F.lit(0))).where(F.col("offset") < F.col("size"))


def roots(paths: DataFrame, slug_map: DataFrame, detected: DataFrame) -> DataFrame:
    """JN4, PJ4: (path, project_root): of the slug's map, else as detected in the transcript, else ''."""
    known = slug_map.where("slug is not null").groupBy("slug").agg(F.max(F.nullif("project_root", F.lit(""))).alias("mapped"))
    rows = paths.join(known, "slug", "left").join(detected.select("path", F.nullif("cwd", F.lit("")).alias("seen")), "path", "left")
    return rows.select("path", F.coalesce("mapped", "seen", F.lit("")).alias("project_root"))


def registered(slug_map: DataFrame, new_roots: DataFrame) -> DataFrame:
    """SK9: the slug map with these project roots (project_root) in it; a new root replaces what its slug stood for."""
    new = new_roots.where("project_root is not null").select(slug_of("project_root").alias("slug"), "project_root").groupBy("slug").agg(F.max("project_root").alias("project_root"))
    return slug_map.join(new.select("slug"), "slug", "left_anti").select("slug", "project_root").unionByName(new)


def merged_states(current: DataFrame, old: DataFrame) -> DataFrame:
    """SK8, ST3: index states (path, last_byte_offset, project_root) as one; an entry of the current state holds before an old one, and the greatest offset within one."""
    both = current.withColumn("p", F.lit(0)).unionByName(old.withColumn("p", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("path").orderBy("p", F.desc_nulls_last("last_byte_offset"), F.desc_nulls_last("project_root"))
    rows = both.where("path is not null").withColumn("n", F.row_number().over(w)).where("n = 1")
    return rows.select("path", F.coalesce("last_byte_offset", F.lit(0)).alias("last_byte_offset"), F.coalesce("project_root", F.lit("")).alias("project_root"))


def cutoff(now: datetime, days: int) -> str:
    """FN16, FL5."""
    return (now - timedelta(days=days)).strftime("%Y-%m-%dT%H:%M:%S")


def is_expired(before: str) -> Column:
    return F.coalesce((F.col("timestamp") < F.lit(before)) & (F.col("timestamp") != ""), F.lit(False))


def doomed(max_age: str | None = None, session_id: str | None = None, git_branch: str | None = None, project_root: str | None = None) -> Column:
    """MT5: which turns a cleanup takes; falsy arguments are ignored, several add up, project_root narrows them."""
    out = F.lit(False)
    if max_age:
        out |= is_expired(max_age)
    for c, v in (("session_id", session_id), ("git_branch", git_branch)):
        if v:
            out |= F.coalesce(F.col(c) == F.lit(v), F.lit(False))
    return out & F.coalesce(F.col("project_root") == F.lit(project_root), F.lit(False)) if project_root else out


def without(turns: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The turns that no tombstone (column, value, deleted_at) written after them takes away."""
    out = turns
    for c in ("session_id", "git_branch", "doc_id"):
        stones = tombstones.where(F.col("column") == c).groupBy(F.col("value").alias("__v")).agg(F.max("deleted_at").alias("__at"))
        out = out.join(stones, (out[c] == stones["__v"]) & (out["indexed_at"] <= stones["__at"]), "left_anti")
    return out


def expiry_due(last_check: float | None, now: float, days: int, every: int = 86400) -> bool:
    """MT3."""
    return days > 0 and now - (last_check or 0) >= every


def compared(source: DataFrame, target: DataFrame, key: str) -> DataFrame:
    """MG1, AG9: one row: counts and checksums of both sides and whether they agree; column order does not matter, repeated rows count."""
    columns = sorted(source.columns)
    sums = lambda df, p: df.agg(F.count("*").alias(f"{p}_rows"), F.count_distinct(key).alias(f"{p}_keys"), F.coalesce(F.sum(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]).cast("decimal(38,0)")), F.lit(0)).alias(f"{p}_sum"))
    both = sums(source, "source").crossJoin(sums(target, "target"))  # one row by one row
    return both.select("source_rows", "target_rows", "source_keys", "target_keys", ((F.col("source_rows") == F.col("target_rows")) & (F.col("source_sum") == F.col("target_sum"))).alias("agree"))


def bursts(events: DataFrame, keys: list[str], at: str, gap_seconds: float, block_seconds: int = 86400) -> DataFrame:
    """SM1, SM2: events with the burst they are in: a pause longer than the gap ends a burst (trailing-edge debounce).

    Each key is worked on in blocks of time; the last event and the number of bursts before a block are carried over,
    so a key with a third of all events is spread over many tasks. Events without a time are in burst 0.
    """
    width = block_seconds * 1_000_000
    rows = blocks.with_block(events.withColumn("__us", F.unix_micros(F.col(at).cast("timestamp"))), "__us", width)
    before = Window.partitionBy(*keys).orderBy(blocks.BLOCK).rowsBetween(Window.unboundedPreceding, -1)  # a row a block
    last = rows.groupBy(*keys, blocks.BLOCK).agg(F.max("__us").alias("__m")).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col(blocks.BLOCK).alias("__kb"), F.max("__m").over(before).alias("__last"))
    on = [rows[k].eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)] + [rows[blocks.BLOCK] == F.col("__kb")]
    rows = rows.join(last, on)
    earlier = F.coalesce(F.lag("__us").over(Window.partitionBy(*keys, blocks.BLOCK).orderBy("__us")), "__last")
    rows = rows.withColumn("__later", F.coalesce(F.col("__us") - earlier > int(gap_seconds * 1_000_000), F.lit(False)).cast("bigint")).select(*events.columns, "__us", "__later")
    return blocks.scan(rows, keys, "__us", {}, {"burst": F.col("__later")}, width).select(*events.columns, "burst")
