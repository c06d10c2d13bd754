import random
from collections import defaultdict
from datetime import datetime

import duckdb
import numpy as np
import pytest

import __spark_entry__ as contract
from threadmill.operators import ranking
from threadmill.operators.ranking import leading, ranked
from threadmill.plans import catalog

SCHEMA = "query_id bigint, doc_id string, distance double, bm25 double, timestamp string, leg string, logged_at timestamp"


def _row(doc, distance, bm25, ts, leg="both", query=1):
    return (query, doc, distance, bm25, ts, leg, None)


def _brute(rows):
    """Wins less losses over the three criteria, result by result."""
    seconds = lambda t: None if not t else t[:19]
    per = defaultdict(dict)
    for q, doc, d, b, t, leg, _ in rows:
        per[q][doc] = (None if leg == "keyword" else d, None if leg == "vector" else b, seconds(t))
    out = set()
    for q, docs in per.items():
        def beats(x, y, k):
            if x[k] is None or y[k] is None:
                return x[k] is not None and y[k] is None
            return x[k] > y[k] if k == 2 else x[k] < y[k]

        net = {a: sum(beats(y, x, k) - beats(x, y, k) for b, y in docs.items() for k in range(3)) for a, x in docs.items()}
        out |= {(q, a) for a in sorted(docs, key=lambda a: (net[a], a))[:3]}
    return out


def test_flagship_is_a_query():
    assert catalog.FLAGSHIP in catalog.QUERIES
    assert "p2_found" in contract.queries()


def test_filler_distance_is_absent(spark):
    rows = [_row("k", 0.0, -0.1, "2026-01-01T00:00:00Z", "keyword"), *[_row(f"b{i}", 0.1 + i, -9.0 + i, f"2026-01-0{9 - i}T00:00:00.000Z") for i in range(4)]]
    assert {r.doc_id for r in leading(spark.createDataFrame(rows, SCHEMA)).collect()} == {"b0", "b1", "b2"}


@pytest.mark.parametrize("seed", range(3))
def test_against_brute_force_and_sql(spark, seed, tmp_path):
    rng = random.Random(seed)
    rows = []
    for q in range(8):
        for i in range(rng.randint(1, 20)):
            leg = rng.choice(["vector", "keyword", "both"])
            ts = rng.choice(["", f"2026-03-{rng.randint(1, 9):02d}T00:00:00Z", f"2026-03-{rng.randint(1, 9):02d}T00:00:00.000000+00:00"])
            rows.append(_row(f"d{i:02d}", 0.0 if leg == "keyword" else rng.randint(0, 9) / 10, None if leg == "vector" else -float(rng.randint(0, 9)), ts, leg, q))
    rows += rng.sample(rows, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    df.write.parquet(at := f"{tmp_path}/search_results.parquet")
    found = sorted((r.query_id, r.doc_id) for r in leading(df).collect())
    assert found == sorted(_brute(rows))
    db = duckdb.connect()
    db.execute(f"SET TimeZone = 'UTC'; CREATE VIEW search_results AS SELECT * FROM '{at}/*.parquet'")
    assert sorted(db.execute(contract.oracle_sql()["p2_found"]).fetchall()) == found


def _dense(rows):
    """The chain of each query as a matrix."""
    per = defaultdict(dict)
    for q, doc, d, b, t, leg, _ in rows:
        per[q][doc] = [float("inf") if leg == "keyword" else d, float("inf") if leg == "vector" else b, float("inf") if not t else -datetime.fromisoformat(t).timestamp()]
    out = {}
    for q, docs in per.items():
        names, x = sorted(docs), np.array([docs[k] for k in sorted(docs)])
        go = sum((x[None, :, k] < x[:, None, k]) + 0.5 * (x[None, :, k] == x[:, None, k]) for k in range(3)) / (3 * len(names))
        go += np.diag(1 - go.sum(axis=1))
        pi = np.ones(len(names)) / len(names)
        for _ in range(ranking.STEPS):
            pi = ranking.DAMPING * (pi @ go) + (1 - ranking.DAMPING) / len(names)
        out |= {(q, k): p for k, p in zip(names, pi)}
    return out


def _random_rows(seed, queries=5, most=20):
    rng = random.Random(seed)
    rows = []
    for q in range(queries):
        for i in range(rng.randint(1, most)):
            leg = rng.choice(["vector", "keyword", "both"])
            ts = rng.choice(["", f"2026-03-{rng.randint(1, 9):02d}T00:00:00+00:00"])
            rows.append(_row(f"d{i:02d}", 0.0 if leg == "keyword" else rng.randint(0, 9) / 10, None if leg == "vector" else -float(rng.randint(0, 9)), ts, leg, q))
    return rows


def test_walk_equals_the_dense_chain(spark):
    rows = _random_rows(5, 40)
    got = {(r.query_id, r.doc_id): r.stationarity for r in ranked(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = _dense(rows)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_queries_beyond_a_task_give_the_same(spark, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCKS", 4)
    monkeypatch.setattr(ranking, "STEPS", 3)
    rows = _random_rows(7, 3, 14)
    got = {(r.query_id, r.doc_id): (r.stationarity, r.standing) for r in ranked(spark.createDataFrame(rows, SCHEMA), in_task=0, steps=3).collect()}
    whole = {(r.query_id, r.doc_id): r.standing for r in ranked(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = _dense(rows)
    assert got.keys() == want.keys() and all(abs(got[k][0] - want[k]) < 1e-9 for k in want) and {k: v[1] for k, v in got.items()} == whole


def test_no_rows_and_null_ids(spark):
    df = spark.createDataFrame([(None, "a", 0.1, -1.0, "", "both", None), (1, None, 0.1, -1.0, "", "both", None), (1, "a", float("nan"), None, "no time", None, None)], SCHEMA)
    assert [tuple(r) for r in leading(df).collect()] == [(1, "a", 1)]
    assert leading(df.limit(0)).count() == 0
