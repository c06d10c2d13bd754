"""Every query of the catalogue against its SQL, and the operators that no query reaches."""

import datetime as dt
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from threadmill.operators import fusion, sessions, upkeep, vectors
from threadmill.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    want = db.execute(contract.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall())
    assert sorted(repr(tuple(r[c] for c in columns)) for r in df.collect()) == want


def test_entry(spark):
    df = contract.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"doc_id", "rank", "distance", "rrf", "score"}


def test_reciprocal_ranks(spark):
    a = spark.createDataFrame([("A", 1), ("B", 2), ("C", 3)], "doc_id string, rank int")
    b = spark.createDataFrame([("C", 1), ("D", 2)], "doc_id string, rank int")
    got = [(r.doc_id, round(r.rrf, 9)) for r in fusion.reciprocal_ranks(a, b).orderBy("rank").collect()]
    assert got == [("C", 0.032266458), ("A", 0.016393443), ("B", 0.016129032), ("D", 0.016129032)]


def test_recency(spark):
    rows = [("A", 0.2, "2026-01-03", 1), ("B", 0.1, "2026-01-01", 2), ("C", 0.0, "", 3), ("D", 0.3, "2026-01-02", 4), ("E", 0.26, "2026-01-03", 5)]
    df = spark.createDataFrame(rows, "doc_id string, distance double, timestamp string, rank int")
    got = [(r.doc_id, round(r.recency, 4), round(r.score, 3)) for r in fusion.by_recency(df).orderBy("place").collect()]
    assert got == [("C", 0.5, 1.15), ("A", 0.6667, 0.96), ("B", 0.0, 0.9), ("E", 0.6667, 0.888), ("D", 0.3333, 0.77)]
    one = df.where("doc_id in ('B', 'C')")
    assert [r.doc_id for r in fusion.by_recency(one).orderBy("place").collect()] == ["B", "C"]


def test_context_window(spark):
    df = spark.createDataFrame([("s", i, f"d{i}") for i in (0, 100, 250, 400, 900)] + [("t", 175, "other")], "session_id string, turn_index bigint, doc_id string")
    at = lambda i, n: [r.turn_index for r in sessions.context(df, spark.createDataFrame([("s", i)], "session_id string, turn_index bigint"), n).orderBy("turn_index").collect()]
    assert at(175, 1) == [0, 100, 250] and at(9999, 2) == [250, 400, 900] and at(0, 0) == [0]


def test_date_filters(spark):
    from threadmill.functions.text import date_filters

    df = spark.createDataFrame([("2026-04-02T23:59:58.9Z",), ("2026-04-02T23:59:59",), ("2026-04-02T23:59:59Z",), ("",)], "timestamp string")
    assert [r.timestamp for r in df.where(date_filters("timestamp", None, "2026-04-02")).collect()] == ["2026-04-02T23:59:58.9Z", "2026-04-02T23:59:59", ""]
    assert df.where(date_filters("timestamp", "2026-01-01", "2026-04-02")).count() == 2


def test_nearest_with_odd_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0]), (5, [1.0, 1.0]), (6, [1.0, 0.0])], "k int, vector array<float>")
    assert [r.k for r in vectors.nearest(df, [2.0, 0.0], 9, "k").collect()] == [1, 6, 5]
    assert vectors.nearest(df, [0.0, 0.0], 9, "k").count() == 0


def test_embedded_and_identity(spark):
    df = spark.createDataFrame([("Fox fox",), (None,), ("",)], "t string")
    got = [r.vector for r in vectors.embedded(df, "t", lambda: vectors.Hashing(8)).collect()]
    assert sum(got[0]) == 2 and got[1] is None and sum(got[2]) == 0
    assert vectors.check_identity("a", "b", True) == "b" and vectors.check_identity(None, "b", False) == "b"
    with pytest.raises(ValueError):
        vectors.check_identity("a", "b", False)


def test_compared_sees_changes(spark):
    df = spark.createDataFrame([("a", 1), ("b", None), ("b", None)], "k string, n int")
    same = lambda other: upkeep.compared(df, other, "k").first()["agree"]
    assert same(df.select("n", "k")) and not same(df.distinct()) and not same(df.fillna(0))


def test_expiry():
    now = dt.datetime(2026, 3, 2)
    assert upkeep.cutoff(now, 1) == "2026-03-01T00:00:00"
    assert upkeep.expiry_due(None, 90000.0, 365) and not upkeep.expiry_due(50000.0, 90000.0, 365) and not upkeep.expiry_due(None, 90000.0, 0)


def test_cleanup_predicate(spark):
    df = spark.createDataFrame([("s", "b", "p", "2026-01-01T00:00:00"), ("t", "b", "q", ""), ("t", None, "p", None)], "session_id string, git_branch string, project_root string, timestamp string")
    count = lambda **k: df.where(upkeep.doomed(**k)).count()
    assert (count(), count(max_age="2026-02-01"), count(session_id="t"), count(git_branch="b"), count(git_branch="b", project_root="p"), count(session_id="")) == (0, 1, 2, 2, 1, 0)


def test_vector_filters_reach_the_scan(spark):
    plan = catalog.QUERIES["vector_topk_filtered"](spark, FOLDER)._jdf.queryExecution().toString()
    assert "EqualTo(label,3)" in plan and "TakeOrderedAndProject" in plan


def test_turn_scan_reads_only_its_columns(spark):
    plan = catalog.QUERIES["stats_by_type"](spark, FOLDER)._jdf.queryExecution().toString()
    assert F is not None and "PushedFilters: [IsNotNull(doc_id)]" in plan


def test_bursts_across_blocks(spark):
    at = lambda *seconds: [(k, dt.datetime(2026, 1, 1) + dt.timedelta(seconds=x), i) for k in ("a", None) for i, x in enumerate(seconds)]
    df = spark.createDataFrame([*at(0, 5, 9, 9, 25, 31, 100, 101), ("a", None, 9)], "k string, t timestamp, n int")
    for width in (7, 1000):
        got = {(r.k, r.n): r.burst for r in upkeep.bursts(df, ["k"], "t", 10.0, width).collect()}
        assert got == {(k, i): b for k in ("a", None) for i, b in enumerate([0, 0, 0, 0, 1, 1, 2, 2])} | {("a", 9): 0}
