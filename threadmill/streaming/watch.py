"""Following transcripts (SM1-SM5, SM7, CT1): the tail source into the store, batch by batch.

The trigger's interval is the debounce, one batch runs at a time, and a batch that fails is replayed from the
checkpoint; its folders are then written again. Offsets are those of the checkpoint, kept beside the store.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from threadmill.operators import turns, upkeep
from threadmill.sources.transcripts import register
from threadmill.store import Store


def _start(store: Store, folder: str, slug_map: DataFrame | None, **trigger) -> StreamingQuery:
    register(store.spark)

    def batch(df: DataFrame, number: int) -> None:
        df = df.persist()
        roots = None
        if slug_map is not None:
            paths = df.groupBy("path").agg(F.min("slug").alias("slug"))
            roots = upkeep.roots(paths, slug_map, turns.head_cwd(df.withColumn("seen_at", F.lit(None).cast("timestamp"))))
        store.ingest(df, number, roots)
        df.unpersist()

    stream = store.spark.readStream.format("transcript_tail").load(folder)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{store.folder}/offsets").trigger(**trigger).start()


def follow(store: Store, folder: str, slug_map: DataFrame | None = None) -> StreamingQuery:
    """Run until stopped; what arrives within ``trigger_seconds`` makes one batch."""
    return _start(store, folder, slug_map, processingTime=f"{store.settings.trigger_seconds} seconds")


def backfill(store: Store, folder: str, slug_map: DataFrame | None = None) -> None:
    """SM4: everything that is there, then stop."""
    _start(store, folder, slug_map, availableNow=True).awaitTermination()
