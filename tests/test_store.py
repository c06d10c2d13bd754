import golden

from threadmill import api
from threadmill.store import Store
from threadmill.streaming import backfill


def _write(path, lines, end="\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with open(path, "ab") as f:
        f.write(("\n".join(lines) + end).encode())


def _seen(store):
    return sorted((r.turn_index, r.chunk_type, r.timestamp, r.git_branch, len(r.content), r.doc_id) for r in store.turns().collect())


def test_following_a_transcript(spark, tmp_path):
    store, file = Store(spark, str(tmp_path / "store")), tmp_path / "in" / "-home-x-proj" / "s1.jsonl"
    slugs = spark.createDataFrame([("-home-x-proj", "/home/x/proj")], "slug string, project_root string")
    _write(file, golden.LINES[:4], end="\n" + golden.LINES[4][:20])  # stops within a line
    backfill(store, str(tmp_path / "in"), slugs)
    assert [r.content for r in store.turns().collect()] == ["User: How do I fix the déploy script?\n\nAssistant: Use set -e."]
    _write(file, [golden.LINES[4][20:], *golden.LINES[5:]])
    backfill(store, str(tmp_path / "in"), slugs)
    assert _seen(store) == golden.TURNS  # the open turn went on
    assert {r.project_root for r in store.turns().collect()} == {"/home/x/proj"}
    backfill(store, str(tmp_path / "in"), slugs)
    assert _seen(store) == golden.TURNS and store.lines().count() == len(golden.LINES)

    found = api.search_all_sessions(store, "rerun script").orderBy("rank").collect()
    assert found[0].turn_index == 72 and api.results_text(found).startswith("**Result 1** (2026-04-01T10:05:00) [dev] project:proj session:s1")
    assert [r.turn_index for r in api.get_turns(store, "s1", 800, 1).collect()] == [72, 858, 919]
    assert "**Total Turns:** 3" in api.statistics_text(store) and "1 sessions, 3 turns" in api.session_table(store)
    assert api.scope("*", "/a") is None and api.scope(None, "/a") == "/a" and api.scope("/b", "/a") == "/b"

    assert store.expire_when_due() is not None and store.expire_when_due() is None
    assert store.cleanup() .startswith("Nothing") and "Deleted 3 turns" in store.cleanup(git_branch="dev")
    assert store.turns().count() == 0
    store.reset()
    assert store.lines().count() == 0
    backfill(store, str(tmp_path / "in"), slugs)
    assert _seen(store) == golden.TURNS


def test_batch_source_splits_files(spark, tmp_path, monkeypatch):
    from threadmill.sources import transcripts

    _write(tmp_path / "a.jsonl", golden.LINES)
    _write(tmp_path / "sub" / "b.jsonl", ["{}", "", "{}"], end="")
    _write(tmp_path / "c.txt", ["{}"])
    monkeypatch.setattr(transcripts, "SPLIT", 100)
    got = [r for p in transcripts.Reader({"path": str(tmp_path)}).partitions() for r in transcripts.lines(p, 0)]
    assert sorted(r[4] for r in got if r[1] == "a.jsonl") == [r[3] for r in golden.rows()] and {r[3] for r in got} == {"", "sub"}
    assert [r[6] for r in sorted(r for r in got if r[1] == "b.jsonl")] == ["{}", "", "{}"]
    transcripts.register(spark)
    df = spark.read.format("transcript_tail").load(str(tmp_path))
    assert df.count() == len(golden.LINES) + 3
