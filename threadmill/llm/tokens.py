"""Problem 8: token ids of whole texts by a public byte-level BPE.

Each partition cuts its texts into words by the tokenizer's pattern and lets DuckDB contract the distinct words
with a recursive query: token-position rows join the merge table, every word contracts its pair of least rank,
leftmost first, until no pair of any word is in the table. An ordered aggregation then reads off the ids.
"""

import json
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: Fixed value: the published word pattern of the byte-level BPE family that this vocabulary belongs to.
WORDS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
FOLDER = "/opt/tokenizers"
#: Distinct words that one recursive query contracts at once.
BATCH_WORDS = 20_000
#: Characters of text that are encoded at once, and contracted words that a worker remembers.
BATCH_CHARS, REMEMBERED = 4_000_000, 100_000

_RECURSIVE = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 0::INTEGER AS it, true AS live FROM start
  UNION ALL
  SELECT w, pos, new_tok, it + 1, live FROM (
    SELECT w, pos, it, coalesce(made, tok) AS new_tok, drop_next, lag(drop_next) OVER (PARTITION BY w ORDER BY pos) AS dropped, least_rank IS NOT NULL AS live
    FROM (
      SELECT *, take AS drop_next, CASE WHEN take THEN new END AS made
      FROM (
        SELECT *, rank IS NOT NULL AND rank = least_rank AND row_number() OVER (PARTITION BY w, hit ORDER BY pos) % 2 = 1 AS take
        FROM (
          SELECT *, CASE WHEN rank = least_rank THEN idx - sum(CASE WHEN rank = least_rank THEN 1 ELSE 0 END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) ELSE -1 - idx END AS hit
          FROM (
            SELECT p.*, m.rank, m.new, min(m.rank) OVER (PARTITION BY p.w) AS least_rank
            FROM (SELECT w, pos, tok, it, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS after, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx FROM step WHERE live) p
            LEFT JOIN merges m ON m.a = p.tok AND m.b = p.after)))))
  WHERE coalesce(dropped, false) = false AND live
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM (SELECT w, pos, tok, it, max(it) OVER (PARTITION BY w) AS last FROM step) WHERE it = last GROUP BY w ORDER BY w
"""

#: Words of more bytes than LONG contract every pair whose rank is least as far as a later merge can reach, not only
#: the least of the whole word: a token grows towards a pair only by taking in all between, and none is longer than
#: the longest of the vocabulary. So the number of steps does not grow with the length. ROUNDS steps make one query,
#: which keeps the rows of all its steps.
LONG, ROUNDS = 400, 12
#: Bytes of long words that share a query, unless one alone has more.
LONG_BYTES = 100_000
_LONG = """
WITH RECURSIVE step AS (
  SELECT w, pos, tok, 0::INTEGER AS it, true AS live FROM start
  UNION ALL
  SELECT w, pos, new_tok, it + 1, live FROM (
    SELECT w, pos, it, CASE WHEN taken THEN new ELSE tok END AS new_tok, lag(taken) OVER (PARTITION BY w ORDER BY pos) AS dropped, live
    FROM (
      SELECT *, rank IS NOT NULL AND max(bad) OVER (PARTITION BY w, run ORDER BY pos ROWS UNBOUNDED PRECEDING) = 0 AND row_number() OVER (PARTITION BY w, run ORDER BY pos) % 2 = 1 AS taken
      FROM (
        SELECT *, CASE WHEN rank > near THEN 1 ELSE 0 END AS bad, sum(CASE WHEN rank IS NOT DISTINCT FROM before THEN 0 ELSE 1 END) OVER (PARTITION BY w ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run
        FROM (
          SELECT p.*, m.rank, m.new, min(m.rank) OVER (PARTITION BY p.w ORDER BY p.pos RANGE BETWEEN {reach} PRECEDING AND {three} FOLLOWING) AS near,
            lag(m.rank) OVER (PARTITION BY p.w ORDER BY p.pos) AS before, min(m.rank) OVER (PARTITION BY p.w) IS NOT NULL AS live
          FROM (SELECT w, pos, tok, it, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS after FROM step WHERE live) p
          LEFT JOIN merges m ON m.a = p.tok AND m.b = p.after))))
  WHERE coalesce(dropped, false) = false AND it < {rounds}
)
SELECT w, pos, tok, live FROM (SELECT *, max(it) OVER (PARTITION BY w) AS last FROM step) WHERE it = last ORDER BY w, pos
"""


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class BytePair:
    """The vocabulary of one file and a DuckDB connection that holds its merge table."""

    def __init__(self, file: str):
        import duckdb
        import regex

        model = json.loads(open(file, encoding="utf-8").read())["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.known: dict[str, list[int]] = {}
        plain = regex.compile("[A-Za-z\u0120]+")
        self.reach = max((len(a + b) for a, b in pairs), default=1)
        self.plain_reach = max((len(a + b) for a, b in pairs if plain.fullmatch(a + b)), default=1)
        self.words = regex.compile(WORDS)
        self.of_byte = np.array([vocab[c] for _, c in sorted(byte_letters().items())], dtype=np.int32)
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({"a": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "b": pa.array([vocab[b] for _, b in pairs], pa.int32()), "rank": pa.array(range(len(pairs)), pa.int32()), "new": pa.array([vocab[a + b] for a, b in pairs], pa.int32())})
        self.db.register("arrow_merges", merges)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM arrow_merges")

    def contract_long(self, words: list[bytes], reach: int) -> list[list[int]]:
        """The ids of long words, in queries of a bounded number of steps."""
        out: list[list[int]] = [[] for _ in words]
        rows = self._start(words)
        while rows.num_rows:
            self.db.register("start", rows)
            got = self.db.sql(_LONG.format(reach=reach, three=3 * reach, rounds=ROUNDS)).to_arrow_table()
            self.db.unregister("start")
            live = got.column("live").to_numpy(zero_copy_only=False)
            w, tok = got.column("w").to_numpy()[~live], got.column("tok").to_numpy()[~live]
            first = np.flatnonzero(np.r_[True, w[1:] != w[:-1]]) if len(w) else np.zeros(0, np.int64)
            for k, ids in zip(w[first], np.split(tok, first[1:])):
                out[k] = ids.tolist()
            rows = got.filter(pa.array(live)).select(["w", "pos", "tok"])
        return out

    def _start(self, words: list[bytes]) -> pa.Table:
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        pos = (np.arange(len(data)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        return pa.table({"w": w, "pos": pos, "tok": self.of_byte[data]})

    def contract(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word."""
        if not words:
            return []
        self.db.register("start", self._start(words))
        out = self.db.sql(_RECURSIVE).to_arrow_table()
        self.db.unregister("start")
        return out.column("ids").to_pylist()

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; a null or empty text has none."""
        numbers: defaultdict[str, int] = defaultdict()
        numbers.default_factory = numbers.__len__  # a new word gets the next number
        places, counts = [], []
        for text in texts:
            found = self.words.findall(text) if text else []
            counts.append(len(found))
            places.extend(map(numbers.__getitem__, found))
        new = [x for x in numbers if x not in self.known]
        got = dict(self.known) if len(self.known) + len(new) > REMEMBERED else self.known
        raw = [x.encode("utf-8", "surrogatepass") for x in new]
        short = sum(len(x) <= LONG for x in raw)
        order = sorted(range(len(new)), key=lambda i: len(raw[i]))
        for at in range(0, short, BATCH_WORDS):
            some = order[at : min(at + BATCH_WORDS, short)]
            got.update(zip([new[i] for i in some], self.contract([raw[i] for i in some])))
        for plain in (True, False):
            some, size = [], 0
            for i in [*(i for i in order[short:] if (raw[i].isascii() and raw[i].strip(b" ").isalpha()) == plain), None]:
                if some and (i is None or size + len(raw[i]) > LONG_BYTES):
                    got.update(zip([new[k] for k in some], self.contract_long([raw[k] for k in some], self.plain_reach if plain else self.reach)))
                    some, size = [], 0
                if i is not None:
                    some.append(i)
                    size += len(raw[i])
        if got is not self.known:
            self.known = {}
        flat = [got[x] for x in numbers]
        sizes = np.fromiter(map(len, flat), np.int64, len(flat))
        starts = np.cumsum(sizes) - sizes
        ids = np.fromiter((x for y in flat for x in y), np.int32, int(sizes.sum()))
        place = np.array(places, dtype=np.int64)
        n = sizes[place] if len(place) else np.zeros(0, np.int64)
        index = np.repeat(starts[place] - (np.cumsum(n) - n), n) + np.arange(n.sum()) if len(place) else np.zeros(0, np.int64)
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(np.array(counts, np.int64))])]
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids[index.astype(np.int64)], pa.int32()))


def portions(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batch with a bounded amount of text each (one longer text makes a slice of its own)."""
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).to_numpy(zero_copy_only=False).astype(float))
    part = (np.cumsum(sizes) // BATCH_CHARS).astype(np.int64)
    for at in np.unique(part):
        rows = np.flatnonzero(part == at)
        yield batch.slice(int(rows[0]), len(rows))


_LOADED: dict[str, BytePair] = {}


def loaded(folder: str, name: str) -> BytePair:
    """One copy a worker."""
    file = os.path.join(folder, f"{name}.json")
    if file not in _LOADED:
        _LOADED[file] = BytePair(file)
    return _LOADED[file]


def encode(df: DataFrame, key: str, text: str, name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """(key, ids array<int>): one row for each row of ``df``, whole texts, without special tokens.

    Null, empty: []. Repeated keys and texts give a row each. White space and control characters are encoded
    like any text. The words of one Arrow batch are gathered before they are contracted; nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), loaded(folder, name).encode(part.column(1).to_pylist())], [key, "ids"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def count_tokens(df: DataFrame, text: str, out: str = "n_tokens", name: str = "byte_bpe_50k", folder: str = FOLDER) -> DataFrame:
    """The rows of ``df`` with the number of tokens of a text (null: 0)."""
    schema = StructType([*df.schema.fields, StructField(out, IntegerType())])
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, at):
                ids = loaded(folder, name).encode(part.column(at).to_pylist())
                n = pa.array(np.diff(ids.offsets.to_numpy()).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, n], [*part.schema.names, out])

    return df.mapInArrow(run, schema)
