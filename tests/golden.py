"""A transcript with every kind of entry and the turns it makes."""

LINES = [
    '{"type":"file-history-snapshot","timestamp":"2026-04-01T09:59:00.000Z"}',
    '{"type":"user","cwd":"/home/x/proj","gitBranch":"main","timestamp":"2026-04-01T10:00:00.000Z","message":{"content":"How do I fix the déploy script?"}}',
    '{"type":"assistant","timestamp":"2026-04-01T10:00:05.000Z","message":{"content":[{"type":"thinking","thinking":"hmm"},{"type":"text","text":"Use set -e."},{"type":"tool_use","name":"Bash"}]}}',
    '{"type":"user","timestamp":"2026-04-01T10:00:06.000Z","message":{"content":[{"type":"tool_result","content":"ok"}]}}',
    '{"type":"assistant","timestamp":"2026-04-01T10:00:07.000Z","message":{"content":[{"type":"text","text":" Then rerun it. "}]}}',
    '{"type":"user","isMeta":true,"timestamp":"2026-04-01T10:00:08.000Z","message":{"content":"meta"}}',
    '{"type":"user","gitBranch":"dev","timestamp":"2026-04-01T10:05:00.000Z","message":{"content":"ok"}}',
    '{"type":"summary","summary":"Deploy fix"}',
    '{"type":"user", bad',
    '{"type":"user","timestamp":"2026-04-01T10:06:00.000Z","message":{"content":"' + "x" * 8100 + '"}}',
    '{"type":"system","timestamp":"2026-04-01T10:07:00.000Z"}',
]
#: (turn_index, chunk_type, timestamp, git_branch, chars, doc_id)
TURNS = [
    (72, "turn", "2026-04-01T10:05:00.000Z", "dev", 77, "s1::d622da31dcbe09b2"),
    (858, "summary", "2026-04-01T10:05:00.000Z", "dev", 27, "s1::e72290cb63fea2ef"),
    (919, "turn", "2026-04-01T10:07:00.000Z", "dev", 8013, "s1::ce83fd47ba8ebb13"),
]
IDS = [998854178401182074, 990442551636101763, 1086642151659229649]
SCHEMA = "path string, session_id string, transcript_file string, byte_start bigint, byte_len bigint, line string, seen_at timestamp"


def rows(lines=LINES, session="s1"):
    at = 0
    for line in lines:
        n = len(line.encode()) + 1
        yield (f"/t/{session}.jsonl", session, f"{session}.jsonl", at, n, line, None)
        at += n
