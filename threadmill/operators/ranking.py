"""Problem 2: one ranking of results whose scores are on unlike scales.

A walk goes over the results of a query: it picks one of the scores, draws any result, and jumps there if that one is
ranked higher by the score (if equal, every other time); so a jump goes uniformly to the higher-ranked ones, and only
ranks count. Power iteration with damping gives the share of time spent at each result; as the mass that reaches a
result is the mass of all lower ones, a step is a sum over the sorted results (prefix sums), never over pairs.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.session import cut

CRITERIA = ("distance", "bm25", "timestamp")
DAMPING, STEPS = 0.85, 60
#: Rows of one query that one task holds; larger queries are iterated in the cluster, in blocks of the ranks.
IN_TASK, BLOCKS = 250_000, 500
#: So many places behind the leading ones are looked at by the exact check.
MARGIN = 16
_OUT = "query_id bigint, doc_id string, stationarity double, standing bigint"


def scored(results: DataFrame) -> DataFrame:
    """(query_id, doc_id, distance, bm25, timestamp), one row per query and document; absent scores are null.

    Of repeated rows the one logged last holds. A keyword result has no distance and a vector result no bm25,
    whatever filler stands there; NaN and unreadable timestamps are absent too.
    """
    rows = results.where("query_id is not null and doc_id is not null")
    last = F.max(F.struct("logged_at", "leg", "distance", "bm25", "timestamp")).alias("r")
    rows = rows.groupBy("query_id", "doc_id").agg(last)
    number = lambda c, other: F.when(~F.col("r.leg").eqNullSafe(other) & ~F.isnan(f"r.{c}"), F.col(f"r.{c}"))
    return rows.select("query_id", "doc_id", number("distance", "keyword").alias("distance"), number("bm25", "vector").alias("bm25"), F.unix_micros(F.col("r.timestamp").try_cast("timestamp")).alias("timestamp"))


def walk(query: np.ndarray, scores: list[np.ndarray], steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(stationarity, standing) of the rows of whole queries, sorted by query; scores are best when small, NaN where absent.

    standing is the sum over the scores of twice the mean number of better results, plus one.
    """
    n = len(query)
    first = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
    segment = np.repeat(np.arange(len(first)), np.diff(np.r_[first, n]))
    last = np.r_[first[1:], n]
    size = (last - first)[segment]
    standing = np.zeros(n, np.int64)
    plans = []
    for s in scores:
        absent = np.isnan(s)
        order = np.lexsort((np.where(absent, 0.0, s), absent, segment))
        v, a, g = s[order], absent[order], segment[order]
        new = np.r_[True, (g[1:] != g[:-1]) | (a[1:] != a[:-1]) | (~a[1:] & (v[1:] != v[:-1]))]
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        lo, hi = begin[run], np.r_[begin[1:], n][run]
        better, equal = np.empty(n, np.int64), np.empty(n, np.int64)
        better[order], equal[order] = lo - first[g], hi - lo
        standing += 2 * better + equal
        low, high = np.empty(n, np.int64), np.empty(n, np.int64)
        low[order], high[order] = lo, hi
        plans.append((order, low, high, last[segment], 1 - (better + equal / 2) / size))
    pi = 1.0 / size
    for _ in range(steps):
        reached = np.zeros(n)
        for order, low, high, end, stay in plans:
            sums = np.r_[0.0, np.cumsum(pi[order])]
            reached += (sums[end] - (sums[high] + sums[low]) / 2) / size + pi * stay
        pi = DAMPING * reached / len(scores) + (1 - DAMPING) / size
    return pi, standing


def _in_tasks(scores: DataFrame, top: int | None) -> DataFrame:
    """ranked() of queries that a task can hold: rows come sorted by query, whole queries are worked on together."""

    def done(rows: pa.Table) -> pa.RecordBatch:
        query = rows.column("query_id").to_numpy()
        numbers = [rows.column(c).to_numpy(zero_copy_only=False).astype(float) for c in CRITERIA]
        numbers[2] = -numbers[2]
        pi, standing = walk(query, numbers)
        doc = np.array(rows.column("doc_id").to_pylist(), dtype=object)
        keep = np.arange(len(query))
        if top:
            order = np.lexsort((doc, -np.round(pi, 12), query))
            begin = np.r_[True, query[order][1:] != query[order][:-1]]
            place = np.arange(len(order)) - np.maximum.accumulate(np.where(begin, np.arange(len(order)), 0))
            keep = order[place < top]
        return pa.RecordBatch.from_arrays([pa.array(query[keep], pa.int64()), pa.array(doc[keep], pa.string()), pa.array(np.round(pi[keep], 12)), pa.array(standing[keep], pa.int64())], ["query_id", "doc_id", "stationarity", "standing"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ids = batch.column(0).to_numpy()
            at = int(np.searchsorted(ids, ids[-1]))  # the last query may go on in the next batch
            if at or held and held[-1].column(0)[-1].as_py() != ids[0]:
                whole = [*held, batch.slice(0, at)] if at else held
                yield done(pa.Table.from_batches(whole))
                held = []
            held.append(batch.slice(at))
        if held:
            yield done(pa.Table.from_batches(held))

    return scores.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, _OUT)


def _in_cluster(scores: DataFrame, steps: int) -> DataFrame:
    """ranked() of queries too large for a task: ranks and prefix sums by blocks of the values, carried over by block."""
    long = None
    for c in CRITERIA:
        v = F.col(c).cast("double") * (-1 if c == "timestamp" else 1)
        rows = scores.select("query_id", "doc_id", F.lit(c).alias("c"), F.coalesce(v, F.lit(float("nan"))).alias("v"))  # NaN sorts behind all
        long = rows if long is None else long.unionByName(rows)
    values = cut(long.groupBy("query_id", "c", "v").agg(F.count("*").alias("equal")))
    bounds = values.where(~F.isnan("v")).groupBy("query_id", "c").agg(F.percentile_approx("v", [i / BLOCKS for i in range(1, BLOCKS)], 10 * BLOCKS).alias("bounds"))
    values = values.join(bounds, ["query_id", "c"], "left")
    block = F.when(F.isnan("v"), BLOCKS + 1).otherwise(F.size(F.filter("bounds", lambda b: b < F.col("v"))))
    values = cut(values.select("query_id", "c", "v", "equal", block.alias("block")))

    def before(rows: DataFrame, number: str) -> DataFrame:
        """rows with ``sum``: the sum of ``number`` over all smaller values of the query and score."""
        blocks = rows.groupBy("query_id", "c", "block").agg(F.sum(number).alias("s"))
        earlier = Window.partitionBy("query_id", "c").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # at most BLOCKS + 2 rows
        blocks = blocks.select("query_id", "c", "block", F.coalesce(F.sum("s").over(earlier), F.lit(0)).alias("carry"))
        inner = Window.partitionBy("query_id", "c", "block").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("own", F.coalesce(F.sum(number).over(inner), F.lit(0))).join(blocks, ["query_id", "c", "block"]).withColumn("sum", F.col("own") + F.col("carry")).drop("own", "carry")

    sizes = scores.groupBy("query_id").agg(F.count("*").alias("size"))
    values = cut(before(values, "equal").withColumnRenamed("sum", "better").join(sizes, "query_id"))
    items = cut(long.join(values, ["query_id", "c", "v"]).select("query_id", "doc_id", "c", "v", "block", "better", "equal", "size"))
    pi = items.where(F.col("c") == CRITERIA[0]).select("query_id", "doc_id", (1 / F.col("size")).alias("pi"))
    for _ in range(steps):
        at = items.join(pi, ["query_id", "doc_id"])
        mass = at.groupBy("query_id", "c", "block", "v").agg(F.sum("pi").alias("m"))
        mass = before(mass, "m").select("query_id", "c", "v", "m", F.col("sum").alias("ahead"))
        reached = (1 - F.col("ahead") - F.col("m") / 2) / F.col("size") + F.col("pi") * (1 - (F.col("better") + F.col("equal") / 2) / F.col("size"))
        pi = at.join(mass, ["query_id", "c", "v"]).groupBy("query_id", "doc_id").agg((F.lit(DAMPING) * F.sum(reached) / len(CRITERIA) + (1 - DAMPING) / F.first("size")).alias("pi"))
        pi = cut(pi)
    standing = items.groupBy("query_id", "doc_id").agg(F.sum(2 * F.col("better") + F.col("equal")).alias("standing"))
    return pi.join(standing, ["query_id", "doc_id"]).select("query_id", "doc_id", F.round("pi", 12).alias("stationarity"), "standing")


def ranked(results: DataFrame, top: int | None = None, in_task: int = IN_TASK, steps: int = STEPS) -> DataFrame:
    """(query_id, doc_id, stationarity, standing): every result of every query, or the ``top`` of greatest stationarity (then least doc_id).

    Null ids, repeated rows, absent scores: see scored(). Empty tables give no rows.
    """
    scores = cut(scored(results))
    large = scores.groupBy("query_id").count().where(F.col("count") > in_task).select("query_id")
    if large.isEmpty():
        return _in_tasks(scores, top)
    large = cut(large)
    rows = _in_cluster(scores.join(large, "query_id", "left_semi"), steps)
    if top:
        w = Window.partitionBy("query_id").orderBy(F.desc("stationarity"), "doc_id")
        rows = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).drop("place")
    return _in_tasks(scores.join(large, "query_id", "left_anti"), top).unionByName(rows)


def leading(results: DataFrame, n: int = 3, margin: int = MARGIN) -> DataFrame:
    """(query_id, doc_id, place) of the n leading results of each query.

    The walk gives the leading n + margin; the exact check orders these by their mean places, then by doc_id.
    """
    w = Window.partitionBy("query_id").orderBy("standing", "doc_id")
    return ranked(results, n + margin).withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("query_id", "doc_id", "place")
