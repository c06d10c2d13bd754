import random
from datetime import datetime

import pytest

from threadmill.operators import incremental
from threadmill.operators.incremental import merge_intervals, reopen, subtract_intervals, unprocessed_lines

LINES = "path string, byte_start bigint, byte_len bigint, line string, seen_at timestamp"
SAVES = "run_no bigint, path string, last_byte_offset bigint, project_root string, status string, saved_at timestamp"


def _frame(spark, rows, names="source string, seq_from bigint, seq_to bigint"):
    return spark.createDataFrame(rows, names)


def _numbers(rows):
    return {(s, i) for s, a, b in rows for i in range(a, b)}


def test_islands_over_a_border(spark, monkeypatch):
    monkeypatch.setattr(incremental, "BLOCK", 100)
    rows = [("p", -10, 50), ("p", 10, 20), ("p", 40, 60), ("p", 60, 70), ("q", 5, 5), ("q", 9, 3), (None, 1, 2)]
    assert [tuple(r) for r in merge_intervals(_frame(spark, rows)).collect()] == [("p", -10, 70)]


@pytest.mark.parametrize("seed", range(4))
def test_against_sets_of_numbers(spark, monkeypatch, seed):
    monkeypatch.setattr(incremental, "BLOCK", 8)
    rng = random.Random(seed)
    rows = [(rng.choice("pqr"), a, a + rng.randint(-1, rng.choice([3, 12, 30]))) for a in (rng.randint(-20, 90) for _ in range(40))]
    merged = sorted(tuple(r) for r in merge_intervals(_frame(spark, rows)).collect())
    assert _numbers(merged) == _numbers(rows) and all(x[0] != y[0] or x[2] < y[1] for x, y in zip(merged, merged[1:]))
    points = [(rng.choice("pqr"), rng.randint(-20, 120)) for _ in range(30)]
    ledger, dots = _frame(spark, merged), _frame(spark, points, "source string, seq bigint")
    left = [tuple(r) for r in reopen(ledger, dots).collect()]
    assert _numbers(left) == _numbers(merged) - set(points) and len(_numbers(left)) == sum(b - a for _, a, b in left)
    assert {tuple(r) for r in subtract_intervals(dots, ledger).collect()} == set(points) - _numbers(merged)


@pytest.mark.parametrize("seed", range(3))
def test_unprocessed_lines_against_the_definition(spark, monkeypatch, seed):
    monkeypatch.setattr(incremental, "BLOCK", 64)
    rng = random.Random(seed)
    day = lambda: rng.choice([None, *[datetime(2026, 1, d) for d in range(1, 9)]])
    lines = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(0, 300, 7)]), rng.choice([None, 3, 7, 7, 7, 40]), rng.choice([None, "x", "y"]), day()) for _ in range(150)]
    saves = [(rng.randint(1, 3), p, rng.choice([None, 0, 63, 64, 130, 400]), None, rng.choice(["ok", "ok", "failed", None]), day()) for p in "aabbd"]
    want = set()
    for p, at in {(r[0], r[1]) for r in lines if r[0] is not None and r[1] is not None}:
        own = [r for r in lines if r[:2] == (p, at)]
        import hashlib

        digest = lambda t: hashlib.sha256((t if t is not None else "\0null").encode()).hexdigest()
        held = max(own, key=lambda r: (r[4] or datetime.min, digest(r[3]), -1 if r[2] is None else r[2]))
        seen = min((r[4] for r in own if r[3] == held[3] and r[4]), default=None)
        ok = [r for r in saves if r[1] == p and r[4] == "ok"]
        best = max(ok, key=lambda r: (r[0], r[5] or datetime.min, r[2] or 0), default=None)
        if not (best and seen and best[5] and at + (held[2] or 0) <= (best[2] or 0) and seen <= best[5]):
            want.add((p, at))
    got = [tuple(r) for r in unprocessed_lines(_frame(spark, lines, LINES), _frame(spark, saves, SAVES)).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_a_late_line_at_a_block_border_comes_out(spark):
    at = 64 << 20
    seen = datetime(2026, 1, 1)
    lines = [("p", at - 10, 25, "done", seen), ("p", at + 5, 10, "late", datetime(2026, 2, 1))]
    saves = [(1, "p", at + 100, None, "ok", datetime(2026, 1, 2))]
    assert [tuple(r) for r in unprocessed_lines(_frame(spark, lines, LINES), _frame(spark, saves, SAVES)).collect()] == [("p", at + 5)]


def test_empty_tables(spark):
    lines, saves = _frame(spark, [], LINES), _frame(spark, [], SAVES)
    assert unprocessed_lines(lines, saves).count() == 0
    assert unprocessed_lines(_frame(spark, [("p", 0, 1, None, None)], LINES), saves).count() == 1
