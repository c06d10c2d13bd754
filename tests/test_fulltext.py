import re
import sqlite3

import pytest

from threadmill.operators import fulltext

TEXTS = [
    "The quick fox sees a lazy dog.", "A fox, a fox and another Fox!", "dog fox dog", "Déjà vu: the dog barks", "snapshot missing; snapper found", "where is fox", "fox_dog under_score", "quick brown fox jumps over the lazy dog and runs",
    "", "lazy lazy lazy", "and or not", "the end of the quick story", "fox filler words here quick", "dog quick fox", "zed",
]
QUERIES = [
    "fox", "fox dog", "fox AND dog", "fox OR dog", "dog NOT fox", "quick NOT (lazy OR story)", "snap*", "qu* fox", '"quick fox"', "quick + fox", "quick+fox dog", "where is fox?", "fox or dog", "NEAR(quick dog, 2)", "NEAR(quick dog)", "NEAR(fox dog, 0)", "NEAR(\"quick fox\" dog, 3)",
    "content:fox", "doc_id : d1", "d1", "- doc_id : fox", "{content doc_id}: fox", "session_id:fox", "foo:bar", "quick-fox", "AND", "", "^fox", "^the quick", "déja", "DEJA", "under_score", "fox OR dog AND lazy", "fox dog OR zed", "it's", "(fox", '"', '"zed', "...", "content : (fox OR zed) NOT dog",
]


@pytest.fixture(scope="module")
def idx(spark):
    df = spark.createDataFrame([(f"d{i}::x", t, "s") for i, t in enumerate(TEXTS)], "doc_id string, content string, session_id string")
    made = fulltext.index(df.unionByName(df.limit(2)))
    return fulltext.Index(made.postings.cache(), made.lengths.cache(), made.documents.cache())


@pytest.fixture(scope="module")
def db():
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(doc_id, content, session_id UNINDEXED, git_branch UNINDEXED, turn_index UNINDEXED, timestamp UNINDEXED, chunk_type UNINDEXED, project_root UNINDEXED)")
    con.executemany("INSERT INTO t(doc_id, content, session_id) VALUES (?, ?, 's')", [(f"d{i}::x", t) for i, t in enumerate(TEXTS)])
    return con


def _sqlite(db, query):
    doubled = query.replace('"', '""')
    for q in (doubled, f'"{doubled}"'):
        try:
            return {a: b for a, b in db.execute("SELECT doc_id, bm25(t, 0.0, 1.0) FROM t WHERE t MATCH ?", (q,))}
        except sqlite3.OperationalError:
            continue
    return {}


@pytest.mark.parametrize("query", QUERIES)
def test_against_sqlite(idx, db, query):
    want = _sqlite(db, query)
    got = {r.doc_id: r.score for r in fulltext.scored(idx, query).collect()}
    assert got.keys() == want.keys()
    mixed = " OR " in query and len(query.split()) > 3  # which parts of a branch that fails are scored is left open there
    if not mixed and not any(x in query for x in ("*", "NEAR", ":", "^")):
        assert all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_results_are_filtered_but_statistics_are_not(spark, idx):
    from pyspark.sql import functions as F

    every = {r.doc_id: r.score for r in fulltext.search(idx, "fox", 50).collect()}
    few = {r.doc_id: r.score for r in fulltext.search(idx, "fox", 50, F.col("doc_id").isin("d1::x", "d2::x")).collect()}
    assert few == {k: every[k] for k in ("d1::x", "d2::x")}


def test_only_postings_of_the_query_are_read(spark, idx, tmp_path):
    idx.postings.write.parquet(f"{tmp_path}/p")
    on_disk = fulltext.Index(spark.read.parquet(f"{tmp_path}/p"), idx.lengths, idx.documents)
    plan = fulltext.scored(on_disk, "fox dog")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(term, \[dog,fox", plan)
