from datetime import datetime

import pytest

from threadmill.operators.incremental import Ledger, versioned_lines

LINES = "path string, byte_start bigint, byte_len bigint, line string, seen_at timestamp"


def _lines(spark, *rows):
    return versioned_lines(spark.createDataFrame([(p, a, n, t, datetime(2026, 1, day)) for p, a, n, t, day in rows], LINES))


def _run(spark, ledger, *rows):
    seen = []
    ledger.run(_lines(spark, *rows), lambda todo: seen.extend((r.source, r.seq, r.line) for r in todo.collect()) or todo.drop("version"))
    return sorted(seen)


def test_changed_and_late_lines_are_processed_once(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    first = [("p", 0, 100, "old", 1), ("p", 100, 50, "b", 1), ("p", 100, 50, "b", 2)]
    assert _run(spark, ledger, *first) == [("p", 0, "old"), ("p", 100, "b")]
    changed = [*first, ("p", 0, 100, "new", 3)]
    assert _run(spark, ledger, *changed) == [("p", 0, "new")]
    late = [*changed, ("p", 40, 30, "late", 4), ("q", 0, 9, None, 4)]
    assert _run(spark, ledger, *late) == [("p", 40, "late"), ("q", 0, None)]
    assert _run(spark, ledger, *late) == []
    assert ledger.output().count() == 5


def test_failed_run_leaves_its_lines_open(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    with pytest.raises(ZeroDivisionError):
        ledger.run(_lines(spark, ("p", 0, 9, "a", 1)), lambda todo: 1 / 0)
    assert _run(spark, ledger, ("p", 0, 9, "a", 1)) == [("p", 0, "a")]


def test_items_without_version_commit_only_their_numbers(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path / "ledger"))
    items = lambda *rows: spark.createDataFrame(list(rows), "source string, seq bigint, seq_end bigint")
    ledger.run(items(("p", 0, 100)), lambda todo: todo)
    ledger.run(items(("p", 0, 100), ("p", 50, 60)), lambda todo: todo)
    assert sorted(tuple(r) for r in ledger.processed().collect()) == [("p", 0, 1), ("p", 50, 51)]
    assert ledger.output().count() == 2
