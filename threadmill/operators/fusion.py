"""Ranked lists: fusion by reciprocal ranks, recency and hybrid search (SR4-SR6, WN4, WN6, JN3, AG4, AG7, TK3-TK5)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from threadmill.config import Settings
from threadmill.functions.text import none_if_empty
from threadmill.operators import fulltext, vectors

_DEFAULT = Settings()


def numbered(df: DataFrame, *order: Column, keys: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """WN6: places from 1, per ``keys``. Without keys for lists cut by a limit only: the window has one partition."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*[F.col(k) for k in keys] or [F.lit(0)]).orderBy(*order)))


def reciprocal_ranks(first: DataFrame, second: DataFrame, n: int | None = None, keys: tuple[str, ...] = (), settings: Settings = _DEFAULT) -> DataFrame:
    """SR4: two ranked lists (doc_id, rank from 1, other columns alike) as one: the sum of 1 / (k + rank), best first; per ``keys`` if given.

    Other columns are those of the first list that holds a document. Ties go by first appearance.
    """
    on = [*keys, "doc_id"]
    columns = [c for c in first.columns if c not in (*on, "rank")]
    side = lambda df, i: df.select(*on, F.col("rank").alias(f"r{i}"), F.struct(F.lit(i).alias("__side"), *columns).alias(f"p{i}"))
    both = side(first, 1).join(side(second, 2), on, "full_outer")
    score = F.coalesce(1 / (settings.rrf_k + F.col("r1")), F.lit(0.0)) + F.coalesce(1 / (settings.rrf_k + F.col("r2")), F.lit(0.0))
    rows = numbered(both.withColumn("rrf", score), F.desc("rrf"), F.asc_nulls_last("r1"), F.col("r2"), keys=keys)
    rows = rows if n is None else rows.where(F.col("rank") <= n)
    return rows.select(*on, "rank", "rrf", *[F.coalesce(f"p1.{c}", f"p2.{c}").alias(c) for c in columns])


def by_recency(df: DataFrame, settings: Settings = _DEFAULT, keys: tuple[str, ...] = ()) -> DataFrame:
    """SR5: candidates (rank, distance, timestamp, ...) with recency, score and their new place ``place``, per ``keys`` if given.

    recency is the share of the other dated candidates that are older (0.5 without a timestamp or where all are
    equal), score = (1 - distance) * (1 + weight * recency). With fewer than two timestamps the order stays.
    """
    ts = none_if_empty("timestamp")
    group = [F.col(k) for k in keys] or [F.lit(0)]
    w = Window.partitionBy(*group)
    dated = Window.partitionBy(*group, ts.isNull()).orderBy(ts)
    rows = df.withColumns({"__n": F.count(ts).over(w), "__low": F.min(ts).over(w), "__high": F.max(ts).over(w)})
    recency = F.when(ts.isNull() | (F.col("__low") == F.col("__high")), 0.5).otherwise(F.percent_rank().over(dated))
    rows = rows.withColumn("recency", recency)
    rows = rows.withColumn("score", (1 - F.col("distance")) * (1 + settings.recency_weight * F.col("recency")))
    order = Window.partitionBy(*group).orderBy(F.when(F.col("__n") < 2, 0.0).otherwise(-F.col("score")), "rank")
    return rows.withColumn("place", F.row_number().over(order)).drop("__n", "__low", "__high")


def hybrid(idx: fulltext.Index, collection: DataFrame, query: str, vector: list[float], n: int = 5, where: Column | None = None, recency: bool = False, settings: Settings = _DEFAULT) -> DataFrame:
    """SR6: the vector leg and the keyword leg, each of ``overfetch`` * n, fused; then by recency if wanted; then the n best.

    ``collection`` has the columns of the documents and ``vector``. A document that only the keyword leg found has distance 0.
    """
    wide = settings.overfetch * n
    columns = [c for c in idx.documents.columns if c != "doc_id"]
    near = vectors.nearest(collection, vector, wide, "doc_id", where=where)
    near = numbered(near, F.desc("similarity"), F.col("doc_id")).select("doc_id", "rank", *columns, "distance")
    words = fulltext.search(idx, query, wide, where, settings)
    words = numbered(words, F.col("score"), F.col("doc_id")).select("doc_id", "rank", *columns, F.lit(0.0).alias("distance"))
    rows = reciprocal_ranks(near, words, wide, settings=settings)
    if recency:
        rows = by_recency(rows, settings).drop("rank").withColumnRenamed("place", "rank")
    return rows.where(F.col("rank") <= n)
