"""The store of turns in one shared folder (SK1-SK9, MT1-MT5, MG1, GD1).

``lines/`` holds the raw lines by batch, ``turns/`` the assembled turns by batch, ``tombstones/`` what was deleted
and when. A batch writes its own folders and overwrites them when it is replayed, so it counts once. Visible is the
last version of each turn that no later tombstone takes away.
"""

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadmill.config import Settings
from threadmill.operators import sessions, turns, upkeep

LINES = "path string, transcript_file string, session_id string, slug string, byte_start bigint, byte_len bigint, line string, seen_at timestamp_ntz, batch bigint"
TURNS = "content string, doc_id string, session_id string, transcript_file string, turn_index bigint, timestamp string, git_branch string, chunk_type string, project_root string, path string, indexed_at timestamp_ntz, batch bigint"
STONES = "column string, value string, deleted_at timestamp_ntz"


class Store:
    def __init__(self, spark: SparkSession, folder: str, settings: Settings = Settings()):
        self.spark, self.folder, self.settings = spark, folder.rstrip("/"), settings
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}"))

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if self._exists(name) else self.spark.createDataFrame([], schema)

    def lines(self) -> DataFrame:
        return self._table("lines", LINES)

    def tombstones(self) -> DataFrame:
        return self._table("tombstones", STONES)

    def turns(self) -> DataFrame:
        """The visible turns: of each place the row of the last batch, unless it was deleted since."""
        rows = self._table("turns", TURNS)
        cells = [c for c in rows.columns if c not in ("session_id", "turn_index", "chunk_type")]
        last = rows.groupBy("session_id", "turn_index", "chunk_type").agg(F.max_by(F.struct(*cells), F.struct("batch", "doc_id")).alias("r"))
        return upkeep.without(last.select(*[F.col(c) if c not in cells else F.col(f"r.{c}") for c in rows.columns]), self.tombstones())

    def ingest(self, lines: DataFrame, batch: int, roots: DataFrame | None = None) -> None:
        """Add raw lines and the turns of the transcripts they belong to; an open turn is written again when it goes on."""
        now = F.current_timestamp().cast("timestamp_ntz")
        lines.withColumn("seen_at", now).write.mode("overwrite").parquet(f"{self.folder}/lines/batch={batch}")
        touched = self.lines().where(F.col("batch") == batch).select("path").distinct()
        made = turns.assemble(self.lines().where(F.col("batch") <= batch).join(touched, "path", "left_semi"), self.settings).withColumnRenamed("text", "content")
        if roots is not None:
            made = made.join(roots.select("path", "project_root"), "path", "left")
        made = made.withColumn("project_root", F.coalesce("project_root", F.lit("")) if roots is not None else F.lit(""))
        known = self._table("turns", TURNS).where(F.col("batch") < batch).select("doc_id")
        fresh = upkeep.new_turns(made, known).withColumn("indexed_at", now)
        fresh.select(*[c.split()[0] for c in TURNS.split(", ")[:-1]]).write.mode("overwrite").parquet(f"{self.folder}/turns/batch={batch}")

    def _bury(self, rows: list[tuple[str, str]]) -> None:
        now = datetime.now(timezone.utc).replace(tzinfo=None)
        self.spark.createDataFrame([(c, v, now) for c, v in rows], STONES).write.mode("append").parquet(f"{self.folder}/tombstones")

    def delete(self, session_id: str | None = None, git_branch: str | None = None) -> int:
        """MT1, AG10: how many turns are gone."""
        gone = self.turns().where(upkeep.doomed(session_id=session_id, git_branch=git_branch)).count()
        rows = [(c, v) for c, v in (("session_id", session_id), ("git_branch", git_branch)) if v]
        if rows:
            self._bury(rows)
        return gone

    def expire(self, days: int, now: datetime | None = None) -> int:
        """MT2: the turns older than so many days; their tombstones are written in the cluster."""
        now = now or datetime.now(timezone.utc)
        old = self.turns().where(upkeep.is_expired(upkeep.cutoff(now, days))).select(F.lit("doc_id").alias("column"), F.col("doc_id").alias("value"), F.current_timestamp().cast("timestamp_ntz").alias("deleted_at"))
        before = self.turns().count()
        old.write.mode("append").parquet(f"{self.folder}/tombstones")
        return before - self.turns().count()

    def expire_when_due(self, now: datetime | None = None) -> int | None:
        """MT3: at most once per ``expire_every_seconds``."""
        now = now or datetime.now(timezone.utc)
        meta = self.meta()
        if not upkeep.expiry_due(meta.get("last_expire_check"), now.timestamp(), self.settings.expire_days, self.settings.expire_every_seconds):
            return None
        gone = self.expire(self.settings.expire_days, now)
        self.save_meta(meta | {"last_expire_check": now.timestamp()})
        return gone

    def cleanup(self, max_age_days: int | None = None, session_id: str | None = None, git_branch: str | None = None) -> str:
        """MT5: falsy arguments are ignored."""
        said = []
        if max_age_days:
            said.append(f"Expired {self.expire(max_age_days)} turns older than {max_age_days} days")
        if session_id:
            said.append(f"Deleted {self.delete(session_id=session_id)} turns of session {session_id}")
        if git_branch:
            said.append(f"Deleted {self.delete(git_branch=git_branch)} turns of branch {git_branch}")
        return "\n".join(said) or "Nothing to clean up: give max_age_days, session_id or git_branch"

    def reset(self) -> None:
        """MT4: everything, the saved offsets too."""
        for name in ("lines", "turns", "tombstones", "meta.json", "offsets"):
            if self._exists(name):
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)

    def meta(self) -> dict:
        """SC10: a file that can't be read counts as empty."""
        if not self._exists("meta.json"):
            return {}
        try:
            return json.loads("\n".join(r.value for r in self.spark.read.text(f"{self.folder}/meta.json", wholetext=True).collect()))
        except ValueError:
            return {}

    def save_meta(self, meta: dict) -> None:
        stream = self._fs.create(self._path(f"{self.folder}/meta.json"), True)
        stream.write(bytearray(json.dumps(meta).encode()))
        stream.close()

    def sessions(self) -> DataFrame:
        return sessions.session_list(self.turns())

    def statistics(self) -> DataFrame:
        return sessions.statistics(self.turns())
