import random

import pytest

from threadmill.llm.conversations import conversations, kahn, transcript_messages, verdicts

SCHEMA = "conversation string, node bigint, next array<bigint>, ts string, role string, broken boolean, text string"


def _m(c, node, following, role=None, ts=None, broken=False):
    return (c, node, following, ts, role, broken, f"{c}{node}" if role else None)


def _dropped(spark, rows, width, origin=0):
    df = spark.createDataFrame(rows, SCHEMA)
    return {r.conversation: r.dropped for r in verdicts(df, width, origin).collect()}


def test_kahn_breaks_ties_by_time():
    order, roots = kahn([0, 1, 2, 3, 4], [[1, 2, 3], [4], [4], [4], []], ["a", "d", "b", "c", None])
    assert order == [0, 2, 3, 1, 4] and roots == [0]
    assert kahn([0, 1, 2], [[1], [2], [1]], [None] * 3)[0] == [0]


CASES = {
    "chain": ([(0, [1], "user"), (1, [2], None), (2, [3], "assistant"), (3, [4], "user"), (4, [5], "assistant")], False),
    "branches": ([(0, [1, 2], "user"), (1, [3], "assistant"), (2, [3], "assistant"), (3, [4], "user"), (4, [], "assistant")], False),
    "branch over a border": ([(0, [1, 5], "user"), (1, [4], "assistant"), (4, [6], None), (5, [6], None), (6, [7], "user"), (7, [], "assistant")], False),
    "gap": ([(0, [1], "user"), (1, [2], "assistant"), (3, [4], "user"), (4, [], "assistant")], True),
    "no first": ([(1, [2], "user"), (2, [], "assistant")], True),
    "cycle": ([(0, [1], "user"), (1, [2, 3], "assistant"), (2, [1], None), (3, [], None)], True),
    "cycle over a border": ([(0, [1], "user"), (1, [4], "assistant"), (4, [1], None)], True),
    "own follower": ([(0, [0], "user"), (1, [], "assistant")], True),
    "broken": ([(0, [1], "user", None, True), (1, [], "assistant")], True),
    "unanswered": ([(0, [1], "user"), (1, [4], None), (4, [5], "user"), (5, [], "assistant")], True),
    "open end": ([(0, [1], "user"), (1, [2], "assistant"), (2, [], "user")], True),
    "reply first": ([(0, [1], "assistant"), (1, [2], "user"), (2, [], "assistant")], True),
    "no roles": ([(0, [1], None), (1, [], None)], True),
    "repeated": ([(0, [1], "user"), (1, [], "assistant"), (1, [], "assistant")], True),
    "null follower": ([(0, [1, None], "user"), (1, None, "assistant")], False),
}


@pytest.mark.parametrize("width", [2, 4, 1000])
def test_verdicts(spark, width):
    rows = [_m(name, *m) for name, (messages, _) in CASES.items() for m in messages]
    assert _dropped(spark, rows, width) == {name: bad for name, (_, bad) in CASES.items()}


def test_any_origin(spark):
    rows = [_m("a", 7, [8], "user"), _m("a", 8, [], "assistant")]
    assert _dropped(spark, rows, 4) == {"a": True} and _dropped(spark, rows, 4, None) == {"a": False}


@pytest.mark.parametrize("width", [3, 1000])
def test_conversations_are_rebuilt_in_order(spark, width):
    rng = random.Random(1)
    rows, want = [], {}
    for c in "abc":
        n = rng.randint(4, 12) * 2
        rows += [_m(c, i, [i + 1] if i + 1 < n else [], ("user", "assistant")[i % 2], f"t{rng.randint(0, 9)}") for i in range(n)]
        want[c] = [f"{c}{i}" for i in range(n)]
    rng.shuffle(rows)
    got = conversations(spark.createDataFrame(rows, SCHEMA), width).orderBy("conversation", "position").collect()
    assert {c: [r.text for r in got if r.conversation == c] for c in "abc"} == want
    assert all([r.position for r in got if r.conversation == c] == list(range(len(want[c]))) for c in "abc")


def test_transcripts(spark):
    lines = "path string, session_id string, byte_start bigint, byte_len bigint, line string, seen_at timestamp"
    user, reply = '{"type":"user","message":{"content":"q"}}', '{"type":"assistant","message":{"content":[{"type":"text","text":"a"}]}}'
    rows = [("p", "s", 0, 5, user, None), ("p", "s", 5, None, reply, None), ("q", "t", 0, 5, user, None), ("q", "t", 5, 5, "{bad", None), ("r", None, 0, 5, user, None), (None, "u", 0, 5, user, None)]
    messages = transcript_messages(spark.createDataFrame(rows, lines))
    assert {r.conversation: r.dropped for r in verdicts(messages).collect()} == {"s": False, "t": True}
    assert [(r.role, r.text) for r in conversations(messages).orderBy("position").collect()] == [("user", "q"), ("assistant", "a")]
    assert verdicts(messages.limit(0)).count() == 0
