"""Problem 1: process only what is new or changed.

Processed sequence numbers are kept per source key as disjoint intervals ``[seq_from, seq_to)``. A run takes
the available items, subtracts the intervals, processes what is left (also items that were committed late
into a gap) and commits the merged intervals together with its output. Items that can change at their place carry
a version; a place is done only for the versions that were processed.
"""

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from threadmill.operators.lines import held_lines
from threadmill.session import cut

BLOCK = 1 << 22


def _block(x) -> F.Column:
    return F.floor(x / F.lit(BLOCK)).cast("bigint")


def _carry(blocks: DataFrame, value: str, name: str) -> DataFrame:
    """A row per source and block with the greatest ``value`` of all earlier blocks."""
    earlier = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.groupBy("source", "b").agg(F.max(value).alias("v")).select("source", "b", F.max("v").over(earlier).alias(name))


def merge_intervals(intervals: DataFrame) -> DataFrame:
    """Disjoint, maximal intervals (source, seq_from, seq_to) of the given ones.

    Empty or reversed intervals and those with a null are left out; touching ones become one. A source is worked on
    in blocks of its sequence numbers; how far the intervals of earlier blocks reach, and where the last island
    began, is carried over by one row a block, so a source with a third of all rows is spread over many tasks.
    """
    rows = intervals.select("source", "seq_from", "seq_to").where("source is not null and seq_from < seq_to").withColumn("b", _block(F.col("seq_from")))
    inner = Window.partitionBy("source", "b").orderBy("seq_from", "seq_to")
    rows = rows.join(_carry(rows, "seq_to", "reach"), ["source", "b"])
    reach = F.greatest("reach", F.max("seq_to").over(inner.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("began", F.when(F.coalesce(F.col("seq_from") > reach, F.lit(True)), F.col("seq_from")))
    rows = rows.join(_carry(rows, "began", "before"), ["source", "b"])
    island = F.coalesce(F.max("began").over(inner.rowsBetween(Window.unboundedPreceding, 0)), "before")
    return rows.withColumn("island", island).groupBy("source", "island").agg(F.max("seq_to").alias("seq_to")).select("source", F.col("island").alias("seq_from"), "seq_to")


def _pieces(intervals: DataFrame) -> DataFrame:
    """The intervals cut at the borders of blocks: (source, b, seq_from, seq_to)."""
    parts = intervals.where("source is not null and seq_from < seq_to").withColumn("b", F.explode(F.sequence(_block(F.col("seq_from")), _block(F.col("seq_to") - 1))))
    return parts.select("source", "b", F.greatest("seq_from", F.col("b") * F.lit(BLOCK)).alias("seq_from"), F.least("seq_to", (F.col("b") + 1) * F.lit(BLOCK)).alias("seq_to"))


def reopen(intervals: DataFrame, points: DataFrame) -> DataFrame:
    """The intervals (disjoint) without the sequence numbers (source, seq) that are to be processed again, in blocks."""
    cuts = points.where("source is not null").select("source", _block(F.col("seq")).alias("b"), F.col("seq").alias("seq_from"), F.lit(None).cast("bigint").alias("seq_to")).distinct()
    rows = _pieces(intervals).select("source", "b", "seq_from", "seq_to").unionByName(cuts)
    order = Window.partitionBy("source", "b").orderBy("seq_from", F.asc_nulls_last("seq_to"))
    rows = rows.withColumns({"end": F.max("seq_to").over(order.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("seq_from").over(order)})
    start = F.when(F.col("seq_to").isNull(), F.col("seq_from") + 1).otherwise(F.col("seq_from"))
    rows = rows.where("end is not null").select("source", start.alias("seq_from"), F.least("end", F.coalesce("next", "end")).alias("seq_to"))
    return rows.where("seq_from < seq_to")


def subtract_intervals(items: DataFrame, processed: DataFrame) -> DataFrame:
    """The items (source, seq, ...) whose seq lies in no processed interval; extra columns are kept.

    Items and interval pieces meet per (source, block) in one sorted window: no range join, no pairs.
    """
    extra = [c for c in items.columns if c not in ("source", "seq")]
    kept = items.select("source", "seq", F.struct(F.lit(1), *extra).alias("rest"), F.lit(None).cast("bigint").alias("reach"))
    pieces = _pieces(processed).select("source", F.col("seq_from").alias("seq"), F.lit(None).cast(kept.schema["rest"].dataType).alias("rest"), F.col("seq_to").alias("reach"))
    both = kept.unionByName(pieces).withColumn("b", _block(F.col("seq"))).withColumn("is_item", F.col("rest").isNotNull())
    w = Window.partitionBy("source", "b").orderBy("seq", "is_item").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("covered", F.max("reach").over(w))
    left = both.where(F.col("is_item") & (F.col("covered").isNull() | (F.col("covered") <= F.col("seq"))))
    return left.select("source", "seq", *[F.col("rest")[c].alias(c) for c in extra])


def last_saves(index_state: DataFrame) -> DataFrame:
    """Per path the save that counts: the 'ok' row of greatest run_no (then latest saved_at, then greatest offset)."""
    best = F.max(F.struct("run_no", "saved_at", F.coalesce("last_byte_offset", F.lit(0)).alias("offset")))
    return index_state.where("status = 'ok' and path is not null").groupBy("path").agg(best.alias("s")).select("path", F.col("s.offset").alias("offset"), F.col("s.saved_at").alias("saved_at"))


def line_items(lines: DataFrame) -> DataFrame:
    """(path, byte_start, byte_end, first_seen) of the lines that hold; first_seen: the first delivery with the text that holds."""
    slim = lines.where("path is not null and byte_start is not null").select("path", "byte_start", "byte_len", "seen_at", F.sha2(F.coalesce("line", F.lit("\0null")), 256).alias("text"))
    slim = slim.repartition("path", "byte_start")  # serves both windows
    last = Window.partitionBy("path", "byte_start").orderBy(F.desc_nulls_last("seen_at"), F.desc_nulls_last("text"), F.desc_nulls_last("byte_len"))
    slim = slim.withColumn("first_seen", F.min("seen_at").over(Window.partitionBy("path", "byte_start", "text"))).withColumn("n", F.row_number().over(last))
    return slim.where("n = 1").select("path", "byte_start", (F.col("byte_start") + F.coalesce("byte_len", F.lit(0))).alias("byte_end"), "first_seen")


def saved_intervals(items: DataFrame, saves: DataFrame) -> DataFrame:
    """The ledger that the saves stand for: of each path the numbers below its offset, as disjoint intervals.

    Lines that were not there as a whole when the path was saved (they end behind the offset, or the text that holds
    came later) are open again: their numbers are gaps in it.
    """
    ledger = saves.select(F.col("path").alias("source"), F.lit(0).cast("bigint").alias("seq_from"), F.col("offset").alias("seq_to"))
    told = items.join(saves, "path")
    done = F.coalesce((F.col("byte_end") <= F.col("offset")) & (F.col("first_seen") <= F.col("saved_at")), F.lit(False))
    late = told.where(~done & (F.col("byte_start") < F.col("offset"))).select(F.col("path").alias("source"), F.col("byte_start").alias("seq"))
    return merge_intervals(reopen(merge_intervals(ledger), late))


def unprocessed_lines(lines: DataFrame, index_state: DataFrame) -> DataFrame:
    """(path, byte_start) of the lines that hold and are new or changed since the save that counts.

    A line is known by the number of its first byte. Rows without path or byte_start name no line. Null seen_at or
    saved_at: not done. Null byte_len counts as 0. Empty tables give no rows (no saves: every line).
    """
    items = cut(line_items(lines))
    ledger = saved_intervals(items, last_saves(index_state))
    found = subtract_intervals(items.select(F.col("path").alias("source"), F.col("byte_start").alias("seq")), ledger)
    return found.select(F.col("source").alias("path"), F.col("seq").alias("byte_start"))


def versioned_lines(lines: DataFrame) -> DataFrame:
    """The lines that hold as items of a Ledger: source (path), seq (byte_start), version (hash of the text) and all other columns."""
    held = held_lines(lines).withColumn("version", F.sha2(F.coalesce("line", F.lit("\0null")), 256))
    return held.withColumnsRenamed({"path": "source", "byte_start": "seq"})


class Ledger:
    """Runs and their intervals in one folder; a run exists once its manifest does.

    ``run(items, process)`` writes the output and the merged intervals of the run under a name of its own and
    then creates the manifest ``_runs/<number>``, which only one writer can. A run that fails before that leaves files no one
    reads; the next run sees the same gaps again. Two writers that race for a number: one create fails, that
    run is void.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _names(self) -> list[str]:
        """The manifests, the last one last."""
        at = self._path(f"{self.folder}/_runs")
        return sorted(x.getPath().getName() for x in self._fs.listStatus(at) if x.getPath().getName().isdigit()) if self._fs.exists(at) else []

    def _read(self, name: str) -> dict | None:
        """None where a writer stopped between creating the manifest and filling it: that run never was."""
        stream = self._fs.open(self._path(f"{self.folder}/_runs/{name}"))
        text = self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        try:
            return json.loads(text)
        except ValueError:
            return None

    def _manifests(self) -> list[dict]:
        return [m for m in map(self._read, self._names()) if m]

    def _last(self) -> dict | None:
        return next((m for m in map(self._read, reversed(self._names())) if m), None)

    def vacuum(self) -> int:
        """Remove the folders of runs that failed; call it while no run is going on."""
        kept, gone = {m["name"] for m in self._manifests()}, 0
        for x in self._fs.listStatus(self._path(self.folder)) if self._fs.exists(self._path(self.folder)) else ():
            if x.getPath().getName().startswith("run-") and x.getPath().getName() not in kept:
                gone += bool(self._fs.delete(x.getPath(), True))
        return gone

    def processed(self) -> DataFrame:
        last = self._last()
        if not last:
            return self.spark.createDataFrame([], "source string, seq_from bigint, seq_to bigint")
        return self.spark.read.parquet(f"{self.folder}/{last['name']}/intervals")

    def places(self) -> DataFrame:
        """(source, seq, version) of every item that was processed; version is null where items had none."""
        runs, schema = self._manifests(), "source string, seq bigint, version string"
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{r['name']}/input" for r in runs])

    def _todo(self, items: DataFrame, before: DataFrame) -> DataFrame:
        if "version" not in items.columns:
            return subtract_intervals(items, before)
        done = self.places()
        same = [items["source"] == done["source"], items["seq"] == done["seq"], items["version"].eqNullSafe(done["version"])]
        return items.join(done, same, "left_anti").dropDuplicates(["source", "seq", "version"])

    def output(self) -> DataFrame | None:
        runs = [f"{self.folder}/{r['name']}/output" for r in self._manifests()]
        return self.spark.read.parquet(*runs) if runs else None

    def run(self, items: DataFrame, process: Callable[[DataFrame], DataFrame]) -> str:
        """items: (source, seq[, version string], ...). Items are read once: what is committed is what was processed.

        An item with a version is processed unless that version of its place was; so a changed text opens its
        place again. Only the sequence numbers of processed items are committed, none that lie between them.
        """
        names = self._names()
        number = int(names[-1]) + 1 if names else 0
        name, before = f"run-{number:09d}-{uuid.uuid4().hex[:12]}", self.processed()
        at = f"{self.folder}/{name}"
        self._todo(items, before).write.parquet(f"{at}/input")  # frozen: a second read could see more
        todo = self.spark.read.parquet(f"{at}/input")
        process(todo).write.parquet(f"{at}/output")
        new = todo.select("source", F.col("seq").alias("seq_from"), (F.col("seq") + 1).alias("seq_to"))
        merge_intervals(before.unionByName(new)).write.parquet(f"{at}/intervals")
        self._fs.mkdirs(self._path(f"{self.folder}/_runs"))
        final = self._path(f"{self.folder}/_runs/{number:09d}")
        try:
            stream = self._fs.create(final, False)  # whoever creates it first has the number
        except Exception as e:
            raise RuntimeError(f"another run committed {final.getName()} first; this one is void") from e
        stream.write(bytearray(json.dumps({"name": name}).encode()))
        stream.close()
        return name
