import random
from collections import Counter, defaultdict

import pytest

from threadmill.llm import packing, tokens

MODELS = [("a", 768, 100), ("b", 768, 37), (None, 1, 5)]


def _check(found, sizes, capacity):
    """Every token of every text is in one input, no input is too large, only oversized texts are cut."""
    per, parts = defaultdict(list), defaultdict(list)
    for r in found:
        per[r.input_id].append(r)
        parts[r.row].append((r.token_start, r.n_tokens))
    assert all(sum(r.n_tokens for r in x) <= capacity and sorted(r.position for r in x) == list(range(len(x))) for x in per.values())
    for row, n in sizes.items():
        got, at = sorted(parts.pop(row, [])), 0
        assert len(got) == (0 if n == 0 else 1 if n <= capacity else -(-n // capacity))
        for start, size in got:
            assert start == at
            at += size
        assert at == n
    assert not parts
    return len(per)


@pytest.mark.parametrize("shard", [10_000, 40])
def test_inputs_hold_every_text_once(spark, shard):
    rng = random.Random(3)
    rows = [(i, rng.choice(["chat"] * 4 + ["web", "code", None]), rng.choice([0, 1, 5, rng.randint(1, 60), 37, 100, 250])) for i in range(900)]
    sizes, models = spark.createDataFrame(rows, "row bigint, source string, n_tokens int"), spark.createDataFrame(MODELS, "model_key string, dim int, max_tokens int")
    found = packing.inputs(sizes, models, shard=shard, fan=3).cache()
    total = sum(n for _, _, n in rows)
    for key, capacity in (("a", 100), ("b", 37)):
        n = _check(found.where(f"model_key = '{key}'").collect(), {i: n for i, _, n in rows}, capacity)
        assert n <= -(-total // capacity) * 1.08 + 1
    assert {r.model_key for r in packing.usage(found, models).collect()} == {"a", "b"}


def test_windows_keep_the_mixture():
    rng = random.Random(5)
    items = {s: [(rng.randint(1, 60), i, 0) for i in range(n)] for s, n in (("x", 3000), ("y", 1500), ("z", 500))}
    total = {s: sum(x[0] for x in v) for s, v in items.items()}
    shares = {s: n / sum(total.values()) for s, n in total.items()}
    made = packing.windows({s: list(v) for s, v in items.items()}, shares, {}, 1000)
    body = made[: len(made) * 9 // 10]
    for s in shares:
        assert all(abs(sum(x[0] for x in w if x[3] == s) / 1000 - shares[s]) < 0.12 for w in body)
        running = 0
        for k, w in enumerate(body, 1):  # carried deficits keep the running mixture near its target
            running += sum(x[0] for x in w if x[3] == s)
            assert abs(running - k * 1000 * shares[s]) < 150
    assert sum(sum(x[0] for x in w) for w in made[:-1]) / (1000 * (len(made) - 1)) > 0.995
    assert Counter((x[3], x[1]) for w in made for x in w) == Counter((s, x[1]) for s, v in items.items() for x in v)


def test_contents_are_the_tokens_of_the_texts(spark):
    rows = [(1, "one two three", "s"), (2, None, "s"), (3, "", None), (4, "word " * 120, "t"), (1, "one two three", "s"), (5, "数据 and more", None)]
    df, models = spark.createDataFrame(rows, "doc_id bigint, text string, source string"), spark.createDataFrame(MODELS, "model_key string, dim int, max_tokens int")
    got = packing.pack(df, "doc_id", "text", "source", models).collect()
    encode = tokens.loaded(tokens.FOLDER, "byte_bpe_50k").encode
    want = {t: encode([t]).to_pylist()[0] for _, t, _ in rows if t}
    assert all(len(r.ids) <= {"a": 100, "b": 37}[r.model_key] and sum(r.lengths) == len(r.ids) for r in got)
    for key in "ab":
        parts = defaultdict(list)
        for r in (x for x in got if x.model_key == key):
            at = 0
            for k, n in zip(r["keys"], r.lengths):
                parts[k].append(r.ids[at : at + n])
                at += n
        assert sorted(parts[1]) == [want["one two three"]] * 2 and parts[5] == [want["数据 and more"]] and 2 not in parts and 3 not in parts
        assert sum(map(len, parts[4])) == len(want["word " * 120]) and len(parts[4]) == (2 if key == "a" else 4)
    assert packing.pack(df.limit(0), "doc_id", "text", "source", models).count() == 0
    assert packing.pack(df, "doc_id", "text", "source", models, contents=False).columns == ["model_key", "input_id", "position", "doc_id", "token_start", "n_tokens"]
