import hashlib
import json
import random
from dataclasses import replace

import golden

from threadmill.config import Settings
from threadmill.functions.text import key60
from threadmill.operators import turns


def _assembled(spark, rows, settings=Settings()):
    got = turns.assemble(spark.createDataFrame(rows, golden.SCHEMA), settings).collect()
    return sorted((r.session_id, r.turn_index, r.chunk_type, r.timestamp, r.git_branch, r.text, r.doc_id) for r in got)


def test_golden_transcript(spark):
    df = turns.assemble(spark.createDataFrame(list(golden.rows()), golden.SCHEMA))
    got = [tuple(r) for r in df.selectExpr("turn_index", "chunk_type", "timestamp", "git_branch", "length(text)", "doc_id").orderBy("turn_index").collect()]
    assert got == golden.TURNS
    assert [r.id for r in df.orderBy("turn_index").select(key60("doc_id").alias("id")).collect()] == golden.IDS
    assert df.orderBy("turn_index").first().text == "User: How do I fix the déploy script?\n\nAssistant: Use set -e.\n\nThen rerun it."


def _fold(rows):
    """The same as one walk over each transcript."""
    out = []
    for session in sorted({r[1] for r in rows}):
        ts = branch = ""
        prompt, start, replies = None, 0, []

        def close():
            if prompt is not None:
                text = "User: " + prompt + ("\n\nAssistant: " + "\n\n".join(replies) if replies else "")
                text = text[:8000] + "\n\n[truncated]" if len(text) > 8000 else text
                if len(text.strip()) >= 20:
                    out.append((session, start, "turn", ts, branch, text))

        for _, _, _, at, n, line, _ in sorted((r for r in rows if r[1] == session), key=lambda r: r[3]):
            try:
                e = json.loads(line)
            except ValueError:
                continue
            if not isinstance(e, dict):
                continue
            branch, ts = e.get("gitBranch") or branch, e.get("timestamp") or ts
            content = (e.get("message") or {}).get("content")
            if e.get("type") == "summary":
                close()
                prompt = None
                if e.get("summary"):
                    out.append((session, at + n - len(line.strip().encode()), "summary", ts, branch, "Session Summary: " + e["summary"]))
            elif e.get("type") == "user" and isinstance(content, str) and content.strip() and not e.get("isMeta"):
                close()
                prompt, start, replies = content.strip(), at, []
            elif e.get("type") == "assistant" and isinstance(content, list):
                replies += [b["text"].strip() for b in content if isinstance(b, dict) and b.get("type") == "text" and b.get("text", "").strip()]
        close()
    return sorted((*t, f"{t[0]}::{hashlib.sha256(f'{t[1]}:{t[5]}'.encode()).hexdigest()[:16]}") for t in out)


def _random_lines(rng):
    out = []
    for _ in range(rng.randint(0, 30)):
        e = {"type": rng.choice(["user", "user", "assistant", "assistant", "summary", "system", "progress", "other", None])}
        if rng.random() < 0.5:
            e["timestamp"] = rng.choice(["", f"2026-01-{rng.randint(10, 28)}T00:00:00Z"])
        if rng.random() < 0.3:
            e["gitBranch"] = rng.choice(["", "main", "dev"])
        if e["type"] == "summary":
            e["summary"] = rng.choice(["", "what was done"])
        elif e["type"] == "user":
            e["message"] = {"content": rng.choice(["hi", "  a longer question of a user \n", "", " 　", [{"type": "text", "text": "no"}], {"type": "text"}, None, "é" * 9000])}
            e["isMeta"] = rng.choice([True, False, None])
        elif e["type"] == "assistant":
            e["message"] = {"content": rng.choice([[{"type": "text", "text": " answer "}, {"type": "tool_use"}, "x"], "plain", [], [{"type": "text", "text": " "}], [{"type": "text", "text": "one"}, {"type": "text", "text": "two"}]])}
        line = json.dumps(e, ensure_ascii=rng.random() < 0.5)
        out.append(rng.choice([line] * 8 + ["", "  ", "{bad", "123", f" {line} "]))
    return out


def test_against_a_fold_with_small_blocks(spark):
    rng = random.Random(11)
    rows = [r for i in range(40) for r in golden.rows(_random_lines(rng), f"s{i}")]
    want = _fold(rows)
    assert len(want) > 25 and _assembled(spark, rows) == want
    assert _assembled(spark, rng.sample(rows, len(rows)) + rows[:50], replace(Settings(), block_bytes=300)) == want


def test_head_cwd(spark):
    lines = ["", "{bad", '{"cwd":"/"}', '{"cwd":"/home"}', '{"cwd":"/home/x"}', '{"cwd":"/other/y"}']
    rows = [*golden.rows(lines, "a"), *golden.rows(lines[:4], "b")]
    got = {r.path: r.cwd for r in turns.head_cwd(spark.createDataFrame(rows, golden.SCHEMA)).collect()}
    assert got == {"/t/a.jsonl": "/home/x", "/t/b.jsonl": ""}
    assert {r.cwd for r in turns.head_cwd(spark.createDataFrame(rows, golden.SCHEMA), 4).collect()} == {""}


def test_empty_table(spark):
    assert turns.assemble(spark.createDataFrame([], golden.SCHEMA)).count() == 0
