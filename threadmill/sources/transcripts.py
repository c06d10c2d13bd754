"""Append-only JSONL transcripts as a Spark data source (SC1, SC2, SC4, FL12, WN7).

``spark.read.format("transcript_tail").load(folder)`` reads every whole line of every transcript;
``spark.readStream`` delivers only what was appended since the last batch. The offset is the number of bytes taken
of each file; a line without its end stays for later. One partition per file and SPLIT bytes: executors read the
files, the driver only looks at sizes and at the tails of the files that grew.
"""

import os
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, transcript_file string, session_id string, slug string, byte_start bigint, byte_len bigint, line string"
SPLIT = 64 << 20


class Piece(InputPartition):
    """The lines of a file that start in [start, end)."""

    def __init__(self, path: str, slug: str, start: int, end: int, limit: int):
        self.path, self.slug, self.start, self.end, self.limit = path, slug, start, end, limit


def found(folder: str, recursive: bool = True) -> dict[str, tuple[str, int]]:
    """path -> (slug, size) of the transcripts; files that can't be read are left out."""
    out = {}
    for at, folders, files in os.walk(folder):
        if not recursive:
            folders.clear()
        slug = os.path.relpath(at, folder).split(os.sep)[0]
        for f in files:
            if f.endswith(".jsonl"):
                try:
                    out[os.path.join(at, f)] = ("" if slug == "." else slug, os.path.getsize(os.path.join(at, f)))
                except OSError:
                    continue
    return out


def whole(path: str, start: int, size: int) -> int:
    """The end of the last whole line before ``size``, ``start`` where there is none."""
    with open(path, "rb") as f:
        at = size
        while at > start:
            back = max(start, at - (1 << 16))
            f.seek(back)
            k = f.read(at - back).rfind(b"\n")
            if k >= 0:
                return back + k + 1
            at = back
    return start


def pieces(path: str, slug: str, start: int, end: int) -> list[Piece]:
    return [Piece(path, slug, a, min(a + SPLIT, end), end) for a in range(start, end, SPLIT)]


def lines(p: Piece, first: int) -> Iterator[tuple]:
    """Rows of a piece; a line belongs to the piece that it starts in. ``first`` is where the file's part begins."""
    name = os.path.basename(p.path)
    stem = name.removesuffix(".jsonl")
    with open(p.path, "rb") as f:
        at = p.start
        if at > first:
            f.seek(at - 1)
            at += len(f.readline()) - 1  # the rest of the line before
        f.seek(at)
        while at < p.end:
            raw = f.readline(p.limit - at)
            if not raw:
                break
            yield p.path, name, stem, p.slug, at, len(raw), raw.rstrip(b"\n").removesuffix(b"\r").decode("utf-8", "replace")
            at += len(raw)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.recursive, self.final = options["path"], options.get("recursive", "true") == "true", options.get("final", "true") == "true"

    def partitions(self) -> list[Piece]:
        out = []
        for path, (slug, size) in found(self.folder, self.recursive).items():
            out += pieces(path, slug, 0, size if self.final else whole(path, 0, size))
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from lines(partition, 0) if partition else ()


class StreamReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.recursive = options["path"], options.get("recursive", "true") == "true"
        self.most = int(options.get("maxFilesPerTrigger", 0))
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        now, grown = dict(self.seen), 0
        for path, (_, size) in sorted(found(self.folder, self.recursive).items()):
            start = now.get(path, 0)
            if size > start and (not self.most or grown < self.most):
                end = whole(path, start, size)
                grown += end > start
                now[path] = end
        self.seen = now
        return now

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        self.seen = {**self.seen, **{k: max(v, self.seen.get(k, 0)) for k, v in end.items()}}
        out = []
        for path, stop in end.items():
            if stop > (first := start.get(path, 0)):
                slug = os.path.relpath(os.path.dirname(path), self.folder).split(os.sep)[0]
                for p in pieces(path, "" if slug == "." else slug, first, stop):
                    p.first = first
                    out.append(p)
        return out

    def read(self, partition: Piece) -> Iterator[tuple]:
        yield from lines(partition, partition.first)

    def commit(self, end: dict) -> None:
        pass


class Tail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "transcript_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options)

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Tail)
