"""Problem 5: pieces of oversized texts, cut at natural boundaries.

Dynamic programming over boundary positions: a piece ends at a boundary, the next one starts about ``overlap``
characters before that end. The sum of cut penalties and of the squared shares of unused room is least.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 8000, 200
#: Penalties of a cut: between paragraphs, lines, sentences, words; without overlap; inside a run.
PARAGRAPH, LINE, SENTENCE, WORD, BARE, HARD = 0.0, 0.2, 0.5, 1.0, 20.0, 1e6
_BREAK = re.compile(r"\s+|[。！？]+")


def _hard(a: int, b: int, limit: int, overlap: int) -> np.ndarray:
    """Where a run [a, b) without natural boundaries may have to be cut.

    A hard cut costs more than all else together, so a run gets the least number of them. Where that number is sure
    to do even if pieces overlap as much as they may, the k-th cut lies where k pieces can reach from the start and
    the rest can reach the end; elsewhere every position counts.
    """
    cuts = -(-(b - a) // limit) - 1
    if b - a > (cuts + 1) * (limit - overlap - overlap // 4):
        return np.arange(a + 1, b)
    return np.unique(np.concatenate([np.arange(max(a + 1, b - (cuts - k + 1) * limit), min(b - 1, a + k * limit) + 1) for k in range(1, cuts + 1)]))


def boundaries(text: str, limit: int, overlap: int, every: bool = False) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Positions at which a piece may end, ascending, and their penalties; the end of the text costs nothing.

    Natural ones come after white space or 。！？, and before it where it takes the run past the limit. Only in runs without any that exceed the limit are there hard ones; these runs are the third value. ``every``:
    hard positions all along a run, not only where a cut may be needed.
    """
    at, cost, long_runs, last = [], [], [], 0
    for m in _BREAK.finditer(text):
        a, b = m.span()
        s = m.group()
        c = PARAGRAPH if s.count("\n") > 1 else LINE if "\n" in s else SENTENCE if s[0] in "。！？" or (a and text[a - 1] in ".!?。！？।؟…") else WORD
        if a - last > limit:
            long_runs.append((last, a))
        tight = b - last > limit  # the stretch's end is out of reach from the boundary before, so its start counts too
        for p in range(a + (not tight), b) if b - a > limit // 2 else range(a, a + tight):  # a long stretch of white space may be cut anywhere
            at.append(p)
            cost.append(c)
        at.append(b)
        cost.append(c)
        last = b
    if len(text) - last > limit:
        long_runs.append((last, len(text)))
    pos, pen = np.array(at, np.int64), np.array(cost)
    hard = np.concatenate([np.arange(a + 1, b) if every else _hard(a, b, limit, overlap) for a, b in long_runs]) if long_runs else np.array([], np.int64)
    pos, pen = np.r_[pos, hard], np.r_[pen, np.full(len(hard), HARD)]
    inside = (pos > 0) & (pos < len(text))
    pos, first = np.unique(pos[inside], return_index=True)
    return np.r_[pos, len(text)], np.r_[pen[inside][first], 0.0], long_runs


class Front:
    """Which earlier end is the best to go on from, as the current end moves to the right.

    Going on from ``i`` costs best[i] + (unused room)^2 until the piece gets too long. The unused room shrinks faster
    for a later start, so once a later one is the better one it stays so: each candidate is best on one stretch of
    ends, and the stretches lie in the order of the candidates. The place where one takes over is a root.
    """

    def __init__(self, ends: list[int], starts: list[int], limit: int):
        self.ends, self.starts, self.limit = ends, starts, limit
        self.line: list[int] = []  # candidates in order
        self.since: list[int] = []  # the first end at which each is the best
        self.value: list[float] = []
        self.at = 0

    def cost(self, j: int) -> tuple[float, int]:
        """The least cost of a piece that ends at the j-th end, without its penalty, and where it comes from."""
        while self.at + 1 < len(self.line) and self.since[self.at + 1] <= j:
            self.at += 1
        if self.at < len(self.line):
            i = self.line[self.at]
            unused = self.limit - self.ends[j] + self.starts[i]
            if unused >= 0:
                return self.value[self.at] + (unused / self.limit) ** 2, i
        return float("inf"), -1

    def add(self, i: int, value: float) -> None:
        if value == float("inf"):
            return
        ends, limit, u = self.ends, self.limit, self.starts[i]
        takes = i + 1
        while len(self.line) > self.at:
            m = self.line[-1]
            v = self.starts[m]
            last = limit + v  # beyond it, a piece from m is too long
            if u > v:
                # value + (limit - e + u)^2 / limit^2 is the smaller one beyond this e
                last = min(last, limit + (u + v) / 2 + (value - self.value[-1]) * limit * limit / (2 * (u - v)))
            elif value < self.value[-1]:
                last = -1
            takes = max(i + 1, bisect_right(ends, last))
            if takes > self.since[-1]:
                break
            self.line.pop()
            self.since.pop()
            self.value.pop()
            takes = i + 1
        if takes < len(ends):
            self.line.append(i)
            self.since.append(takes)
            self.value.append(value)


def _least(ends: list[int], penalty: list[float], starts: list[int], limit: int) -> tuple[list[float], list[int], list[bool]]:
    """The least cost up to each end, the end before it (-1: none), and whether the piece begins there without overlap."""
    best, came, bare = [], [], []
    over, without = Front(ends, starts, limit), Front(ends, ends, limit)
    for j, e in enumerate(ends):
        if e <= limit:
            cost, i, plain = ((limit - e) / limit) ** 2, -1, False
        else:
            (cost, i), (other, k) = over.cost(j), without.cost(j)
            if plain := other < cost:
                cost, i = other, k
        best.append(cost + penalty[j])
        came.append(i)
        bare.append(plain)
        over.add(j, best[j])
        without.add(j, best[j] + BARE)
    return best, came, bare


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, hard) of each piece; hard: it ends inside a run without any natural boundary."""
    n = len(text)
    if n <= limit:
        return [(0, n, False)]
    ends, penalty, runs = boundaries(text, limit, overlap)
    want = np.maximum(ends - overlap, 0)  # the start of the next piece: the boundary nearest to the wanted one
    after = np.searchsorted(ends, want)
    before = ends[np.maximum(after - 1, 0)]
    after = ends[after]
    starts = np.where(np.abs(before - want) <= np.abs(after - want), before, after)
    starts = np.where((np.abs(starts - want) <= overlap // 4) & (starts < ends), starts, want)
    for a, b in runs:  # every position inside is as good
        starts = np.where((want > a) & (want < b), want, starts)
    starts = np.maximum.accumulate(starts)
    best, came, bare = _least(ends.tolist(), penalty.tolist(), starts.tolist(), limit)
    if best[-1] == float("inf"):
        raise RuntimeError(f"no sequence of pieces of at most {limit} characters reaches the end of a text of {n}")
    out, j = [], len(ends) - 1
    while j >= 0:
        i = came[j]
        start = 0 if i < 0 else int(ends[i] if bare[j] else starts[i])
        out.append((start, int(ends[j]), bool(penalty[j] >= HARD)))
        j = i
    return out[::-1]


def pieces(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP, with_text: bool = True) -> DataFrame:
    """(key, piece, piece_start, piece_end, hard[, piece_text]) of each row; offsets count code points.

    Null texts have no piece, empty ones one empty piece; repeated rows give their pieces again. Short texts
    pass in the JVM; only longer ones reach Python. A hard cut is made only where more than ``limit`` characters
    in a row are neither white space nor one of 。！？; pieces overlap less only where a long run leaves no room.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(text).alias("t")).where("t is not null")
    fields = f"k {kind}, piece int, piece_start bigint, piece_end bigint, hard boolean, piece_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(1)[i].as_py()
                found = split(s, limit, overlap)
                key_column = batch.column(0).take(pa.array([i] * len(found)))
                yield pa.RecordBatch.from_arrays(
                    [key_column, pa.array(range(len(found)), pa.int32()), pa.array([a for a, _, _ in found], pa.int64()), pa.array([b for _, b, _ in found], pa.int64()), pa.array([h for _, _, h in found], pa.bool_()), pa.array([s[a:b] if with_text else None for a, b, _ in found], pa.string())],
                    ["k", "piece", "piece_start", "piece_end", "hard", "piece_text"],
                )

    cut = rows.where(F.length("t") > limit).mapInArrow(run, fields)
    whole = rows.where(F.length("t") <= limit).select("k", F.lit(0).alias("piece"), F.lit(0).cast("bigint").alias("piece_start"), F.length("t").cast("bigint").alias("piece_end"), F.lit(False).alias("hard"), (F.col("t") if with_text else F.lit(None).cast("string")).alias("piece_text"))
    out = cut.unionByName(whole).withColumnRenamed("k", key)
    return out if with_text else out.drop("piece_text")


def oversized(df: DataFrame, key: str, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key, cut) of the texts that need more than one piece: 'hard' if any cut is, else 'soft'; one row a key and cut."""
    cut = pieces(df.where(F.length(text) > limit), key, text, limit, overlap, with_text=False)
    per = cut.groupBy(key, F.col("piece_end").alias("at")).agg(F.max("hard").alias("hard"))
    return per.groupBy(key).agg(F.when(F.max("hard"), "hard").otherwise("soft").alias("cut"))
