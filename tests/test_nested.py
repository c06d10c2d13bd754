import json
import random

from threadmill.operators import nested
from threadmill.operators.nested import blocks_of_lines, flat_tables


def test_nested_fields_and_further_arrays_are_flattened(spark):
    usage = {"input": 3, "rate": 0.5, "cache": {"tiers": [{"name": "a", "sub": [{"z": 1}]}, 7, {"name": "b"}]}}
    entry = {"type": "assistant", "message": {"role": "assistant", "usage": usage, "content": [{"type": "tool_use", "input": {"edits": [{"old": "x"}]}}, {"type": "text", "content": [{"type": "text"}]}]}}
    texts = [json.dumps(entry), json.dumps({"type": "user", "message": {"content": {"type": "x", "content": [{"type": "text"}]}}, "Type": 1}), "bad"]
    lines = spark.createDataFrame([("p", i, 1, t, None) for i, t in enumerate(texts)], "path string, byte_start bigint, byte_len bigint, line string, seen_at timestamp")
    tables = flat_tables(lines)
    assert set(tables) == {"entries", "blocks", "entries.message.usage.cache.tiers", "entries.message.usage.cache.tiers.sub", "blocks.input.edits"}
    first = tables["entries"].where("byte_start = 0").first()
    assert (first["f_type"], first["f_message.role"], first["f_message.usage.input"], first["f_message.usage.rate"]) == ("assistant", "assistant", 3, 0.5)
    assert sorted(c for c in tables["entries"].columns if c.lower().startswith("f_type")) == ["f_Type_", "f_type"] or {"f_Type", "f_type_"} <= set(tables["entries"].columns)
    tiers = tables["entries.message.usage.cache.tiers"].orderBy("ordinal").collect()
    assert [(r.ordinal, r["f_name"], r.parent_key) for r in tiers] == [(0, "a", first.entry_key), (2, "b", first.entry_key)]
    sub = tables["entries.message.usage.cache.tiers.sub"].first()
    assert (sub.parent_key, sub.ordinal, sub["f_z"]) == (tiers[0].row_key, 0, 1)
    edit = tables["blocks.input.edits"].first()
    block = tables["blocks"].where("block_path = '0'").first()
    assert (edit.parent_key, edit["f_old"]) == (block.block_key, "x")


LINES = "path string, byte_start bigint, byte_len bigint, line string, seen_at timestamp"


def _walk(value, parent=""):
    """(block_path, parent_path) of all blocks below a content."""
    for i, b in enumerate([value] if isinstance(value, dict) else value if isinstance(value, list) else ()):
        if isinstance(b, dict):
            path = f"{parent}.{i}" if parent else str(i)
            yield path, parent
            own = b.get("content")
            yield from _walk(own if isinstance(own, (dict, list)) else (b["source"].get("content") if isinstance(b.get("source"), dict) else None), path)


def _random(rng, depth=0):
    kind = rng.choice(["text", "none", "object", "list", "list", "source"]) if depth < 4 else "text"
    block = {"type": "x"}
    if kind in ("object", "list"):
        block["content"] = _random(rng, depth + 1) if kind == "object" else [rng.choice([7, "s", None, _random(rng, depth + 1)]) for _ in range(rng.randint(0, 3))]
    elif kind == "source":
        block |= {"source": rng.choice(["url", {"content": [_random(rng, depth + 1)]}]), "content": rng.choice([None, "text"])}
    elif kind == "text":
        block["content"] = "plain"
    return block


def test_blocks_against_a_walk(spark):
    rng = random.Random(4)
    contents = [rng.choice([_random(rng), [_random(rng) for _ in range(3)], "plain", None, [], [1, _random(rng)]]) for _ in range(80)]
    df = spark.createDataFrame([("p", i, 1, json.dumps({"message": {"content": c}}), None) for i, c in enumerate(contents)], LINES)
    rows = blocks_of_lines(df).collect()
    assert sorted((r.byte_start, r.block_path, r.parent_path) for r in rows) == sorted((i, *x) for i, c in enumerate(contents) for x in _walk(c))
    keys = {(r.byte_start, r.block_path): r.block_key for r in rows}
    assert len(set(keys.values())) == len(rows)
    assert all(r.parent_key == keys[r.byte_start, r.parent_path] for r in rows if r.parent_path) and all(r.ordinal == int(r.block_path.split(".")[-1]) for r in rows)
    assert blocks_of_lines(df.limit(0)).count() == 0 and blocks_of_lines(df.where("byte_start < 0"), keep=False).count() == 0


def test_maps_stay_whole(spark, monkeypatch):
    monkeypatch.setattr(nested, "MOST_KEYS", 5)
    texts = [json.dumps({"files": {f"f{i}": {"v": i}}, "message": {"content": [{"a": 1}]}}) for i in range(9)]
    tables = flat_tables(spark.createDataFrame([("p", i, 1, t, None) for i, t in enumerate(texts)], LINES))
    assert not any(c.startswith("f_files.") for c in tables["entries"].columns) and tables["blocks"].where("f_a = 1").count() == 9
