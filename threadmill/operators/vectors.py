"""Vectors: embedding of texts and exact nearest neighbours (SR1, SK4, TK1, JN8, FN17, GD1)."""

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from threadmill.operators.fulltext import fold


def cosine(a: Column, b: Column) -> Column:
    """FN17 in double precision; null where a vector is null, of another length or has no direction."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def nearest(df: DataFrame, query: list[float], k: int, key: str, vector: str = "vector", where: Column | None = None) -> DataFrame:
    """The k rows of greatest cosine similarity: all columns, similarity and distance (1 - similarity); ties go by key.

    Filters and pruned columns reach the scan; every task keeps its k best, only those meet. Rows without a vector
    of the query's length are left out.
    """
    rows = df if where is None else df.where(where)
    norm = float(np.sqrt(sum(float(x) ** 2 for x in query)))
    if not norm:
        return rows.where("false").withColumns({"similarity": F.lit(0.0), "distance": F.lit(1.0)})
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("similarity", cosine(F.col(vector), q)).where("similarity is not null")
    return scored.withColumn("distance", 1 - F.col("similarity")).orderBy(F.desc("similarity"), key).limit(k)


class Hashing:
    """A lexical embedder: counts of terms in hashed places. Not semantic; the default where no model is at hand."""

    name = "hashing"

    def __init__(self, dim: int = 256, prefixes: dict | None = None):
        self.dim, self.prefixes, self.places = dim, prefixes or {"query": "", "document": ""}, {}

    def place(self, term: str) -> int:
        if len(self.places) > 500_000:
            self.places.clear()
        if term not in self.places:
            self.places[term] = int(hashlib.md5(term.encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) % self.dim
        return self.places[term]

    def embed(self, texts: list[str], is_query: bool = False) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for i, t in enumerate(texts):
            for term in fold(self.prefixes["query" if is_query else "document"] + t):
                out[i, self.place(term)] += 1
        return out


#: What the two supported models put before a text.
PREFIXES = {
    "modernbert": {"query": "search_query: ", "document": "search_document: "},
    "embeddinggemma": {"query": "task: search result | query: ", "document": "title: none | text: "},
}


def embedded(df: DataFrame, text: str, make: Callable[[], object], out: str = "vector") -> DataFrame:
    """SR1: df with the vectors of a text, in Arrow batches; ``make`` builds the embedder once a worker. A null text has a null vector."""
    schema = StructType([*[f for f in df.schema.fields if f.name != out], StructField(out, ArrayType(FloatType()))])
    kept = [c for c in df.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for batch in batches:
            texts = batch.column(kept.index(text)).to_pylist()
            some = [t for t in texts if t is not None]
            got = iter(model.embed(some)) if some else iter(())
            vectors = pa.array([None if t is None else next(got) for t in texts], pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*kept, out])

    return df.select(*kept).mapInArrow(run, schema)


def check_identity(stored: str | None, model: str, is_empty: bool) -> str:
    """GD1: the name to keep. A model that differs from the one the vectors were made with is an error, unless there are none."""
    if stored and stored != model and not is_empty:
        raise ValueError(f"the vectors were made by {stored!r}, not by {model!r}")
    return model
