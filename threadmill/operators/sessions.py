"""Questions about stored turns: context windows, statistics and session lists (SR7, WN5, JN6, JN7, AG1-AG3, AG8, AG12)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.text import none_if_empty


def distinct_turns(turns: DataFrame) -> DataFrame:
    """One row per doc_id: the one indexed first."""
    cols = [c for c in turns.columns if c != "doc_id"]
    order = ["indexed_at"] * ("indexed_at" in cols) + [c for c in cols if c != "indexed_at"]
    best = turns.where("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct(*order)).alias("r"))
    return best.select(*[F.col("doc_id") if c == "doc_id" else F.col(f"r.`{c}`") for c in turns.columns])


def context(turns: DataFrame, targets: DataFrame, around: int = 2) -> DataFrame:
    """SR7: for each target (session_id, turn_index) the turns around the nearest one: all columns, target and place (0: the nearest).

    Of two as near the smaller turn_index is taken; the window is clipped at the ends of the session. Only the narrow
    keys of the sessions asked for are compared with a target, and each task keeps the few nearest on either side, so
    a long session is never gathered.
    """
    asked = targets.select("session_id", F.col("turn_index").alias("target")).distinct()
    at = turns.select("session_id", "turn_index", "doc_id").join(asked, "session_id")
    hit = at.groupBy("session_id", "target").agg(F.min(F.struct(F.abs(F.col("turn_index") - F.col("target")).alias("far"), "turn_index", "doc_id")).alias("h"))
    rows = at.join(hit, ["session_id", "target"])
    here, there = F.struct("turn_index", "doc_id"), F.struct("h.turn_index", "h.doc_id")
    parts = [rows.where(here == there).select("doc_id", "target", F.lit(0).alias("place"))]
    for sign, side, order in ((-1, here < there, (F.desc("turn_index"), F.desc("doc_id"))), (1, here > there, (F.asc("turn_index"), F.asc("doc_id")))):
        w = Window.partitionBy("session_id", "target").orderBy(*order)
        parts.append(rows.where(side).withColumn("n", F.row_number().over(w)).where(F.col("n") <= around).select("doc_id", "target", (sign * F.col("n")).alias("place")))
    return turns.join(parts[0].unionByName(parts[1]).unionByName(parts[2]), "doc_id")


def statistics(turns: DataFrame) -> DataFrame:
    """AG1: one row: total_turns, sessions, branches (sorted, joined by ', ')."""
    return turns.agg(F.count("*").alias("total_turns"), F.count_distinct(none_if_empty("session_id")).alias("sessions"), F.array_join(F.array_sort(F.collect_set(none_if_empty("git_branch"))), ", ").alias("branches"))


def by_type(turns: DataFrame) -> DataFrame:
    """AG2."""
    return turns.groupBy("chunk_type").agg(F.count("*").alias("n"))


def session_list(turns: DataFrame) -> DataFrame:
    """AG3: per session its turns, branches, first and last timestamp ('' where none), the latest first."""
    ts = none_if_empty("timestamp")
    rows = turns.where("session_id is not null and session_id <> ''").groupBy("session_id").agg(
        F.count("*").alias("turns"),
        F.array_join(F.array_sort(F.collect_set(none_if_empty("git_branch"))), ", ").alias("branches"),
        F.coalesce(F.min(ts), F.lit("")).alias("first_seen"),
        F.coalesce(F.max(ts), F.lit("")).alias("last_seen"),
    )
    return rows.orderBy(F.desc("last_seen"), "session_id")


def page(df: DataFrame, order: list[str], offset: int, size: int) -> DataFrame:
    """SC6, TK7."""
    return df.orderBy(*order).offset(offset).limit(size)


def page_after(df: DataFrame, key: str, last: object | None, size: int) -> DataFrame:
    """SC7: the page of keys after ``last``; the bound reaches the scan."""
    return (df if last is None else df.where(F.col(key) > F.lit(last))).orderBy(key).limit(size)


def heading(number: Column) -> Column:
    """SK10, FN14: the heading of a search result."""
    part = lambda before, c, after="": F.coalesce(F.concat(F.lit(before), none_if_empty(c), F.lit(after)), F.lit(""))
    root = F.element_at(F.split(F.regexp_replace("project_root", "/+$", ""), "/"), -1)
    return F.concat(F.lit("**Result "), number.cast("string"), F.lit("**"), part(" (", F.substring("timestamp", 1, 19), ")"), part(" [", F.col("git_branch"), "]"), part(" project:", root), part(" session:", F.col("session_id")))
