import random

import pytest

from threadmill.llm.splitting import BARE, LIMIT, OVERLAP, boundaries, oversized, split


def _checked(text, limit=LIMIT, overlap=OVERLAP):
    found = split(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in found)
    assert found[0][0] == 0 and found[-1][1] == len(text)
    assert all(a < c <= b < d for (a, b, _), (c, d, _) in zip(found, found[1:]))
    return found


@pytest.mark.parametrize(
    "text",
    [
        "x" * 8000 + " " + "y" * 300,
        "x" * 7999 + "\n\n" + "y" * 300,
        "x" * 7000 + " " * 1500 + "y" * 300,
        "x" * 8000 + " " * 5000 + "y" * 300,
        "x" * 8000 + "。" + "y" * 300,
        "a b " + "x" * 7999 + "  " + "y" * 8000 + " " + "z" * 8000 + " ",
    ],
)
def test_run_whose_white_space_passes_the_limit_is_cut_soft(text):
    assert not any(hard for _, _, hard in _checked(text))


def test_such_a_run_does_not_hide_a_hard_cut(spark):
    tight = "x" * 8000 + " " + "y" * 300
    df = spark.createDataFrame([("soft", tight), ("hard", tight + " " + "z" * 8001), ("short", "a")], "doc_id string, content string")
    assert {tuple(r) for r in oversized(df, "doc_id", "content").collect()} == {("soft", "soft"), ("hard", "hard")}


def _least(text, limit, overlap):
    """The least cost over all boundaries, by plain dynamic programming."""
    ends, penalty, _ = boundaries(text, limit, overlap, every=True)
    starts, top = [], 0
    for e in ends:
        want = max(e - overlap, 0)
        near = [p for p in ends if p < e and abs(p - want) <= overlap // 4]
        top = max(top, min(near, key=lambda p: (abs(p - want), p)) if near else want)
        starts.append(top)
    best = []
    for j, e in enumerate(ends):
        ways = [((limit - e) / limit) ** 2] if e <= limit else [best[i] + extra + ((limit - e + s[i]) / limit) ** 2 for s, extra in ((starts, 0), (ends, BARE)) for i in range(j) if e - s[i] <= limit]
        best.append(penalty[j] + min(ways))
    return best[-1], dict(zip(ends.tolist(), penalty)), dict(zip(ends.tolist(), starts))


def test_cost_is_least_over_all_boundaries():
    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["a", "bc", "def", "x" * rng.choice([9, 9, 70, 95, 130])]) + rng.choice([" ", " ", ". ", "\n", "\n\n", "。"]) for _ in range(rng.randint(10, 60)))
        limit, overlap = 60, 12
        if len(text) <= limit:
            continue
        found = _checked(text, limit, overlap)
        least, penalty, starts = _least(text, limit, overlap)
        cost = sum(penalty[b] + ((limit - b + a) / limit) ** 2 for a, b, _ in found) + sum(BARE for (_, b, _), (c, _, _) in zip(found, found[1:]) if c == b)
        assert cost == pytest.approx(least)


def test_hard_cuts_are_no_more_than_needed():
    assert sum(hard for _, _, hard in split("x" * 15_700)) == 1
    assert any(" " in text[a - 1 : a] for text in [("word " * 4000)] for a, _, _ in split(text)[1:])
