"""Problem 4: conversations from message rows.

Every message names those that follow it, so replies form a graph: a message may have several replies and follow
several. The graph of each conversation is sorted topologically by Kahn's algorithm, the earlier timestamp first where
several messages are free; messages never freed lie on or behind a cycle. Long conversations are sorted segment by
segment (ranges of the message number). A segment leaves one summary row, its roots and the edges that leave it; roots
and edges of all segments are matched by a join, so no task ever holds a whole long conversation. An edge back into an
earlier segment could close a cycle and counts as one.
"""

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadmill.functions.json import decoded_object, elements
from threadmill.functions.text import is_blank
from threadmill.operators.lines import held_lines
from threadmill.operators.turns import text_of
from threadmill.session import cut

#: Message numbers (bytes of a transcript) of a segment.
SEGMENT = 4 << 20


def transcript_messages(lines: DataFrame, with_text: bool = True) -> DataFrame:
    """The lines that hold as messages: conversation, node, next (array), ts, role, broken and, if wanted, text.

    A line's number is its byte_start; the line that begins where it ends follows it (a line without length is
    followed by none). role is 'user' for prompts, 'assistant' for replies, null for other lines; broken: not blank,
    but no JSON object. Lines without session_id belong to no conversation and are left out. Lines are decoded before
    the deliveries are compared, so that only what is kept of them is shuffled.
    """
    v, content = F.col("v"), F.try_variant_get("v", "$.message.content", "variant")
    kind = F.try_variant_get("v", "$.type", "string")
    meta = F.coalesce((F.schema_of_variant(F.try_variant_get("v", "$.isMeta", "variant")) == "BOOLEAN") & F.try_variant_get("v", "$.isMeta", "boolean"), F.lit(False))
    texts = F.filter(F.transform(F.filter(elements(content), lambda b: F.try_variant_get(b, "$.type", "string") == "text"), lambda b: text_of(F.try_variant_get(b, "$.text", "variant"))), lambda t: t.isNotNull())
    text = F.when((kind == "user") & ~meta, text_of(content)).when((kind == "assistant") & (F.size(texts) > 0), F.array_join(texts, "\n\n"))
    end = F.col("byte_start") + F.coalesce("byte_len", F.lit(0))
    rows = lines.select("path", "session_id", "byte_start", "byte_len", "line", "seen_at").withColumn("v", decoded_object("line")).withColumn("text", text).select(
        "path", "session_id", "byte_start", "byte_len", "seen_at", F.sha2("line", 256).alias("digest"),
        F.when(end != F.col("byte_start"), F.array(end)).otherwise(F.array().cast("array<bigint>")).alias("next"),
        F.try_variant_get("v", "$.timestamp", "string").alias("ts"),
        F.when(F.col("text").isNotNull(), kind).alias("role"),
        (v.isNull() & ~F.coalesce(is_blank("line"), F.lit(True))).alias("broken"),
        *["text"] * with_text,
    )
    held = held_lines(rows, "digest").where("session_id is not null")
    return held.select(F.col("session_id").alias("conversation"), F.col("byte_start").alias("node"), "next", "ts", "role", "broken", *["text"] * with_text)


_ROWS = "conversation string, segment bigint, local bigint, node bigint, role string, text string"
_SUMMARY = "conversation string, segment bigint, roots array<bigint>, exits array<bigint>, back boolean, messages bigint, placed bigint, broken boolean, first_role string, last_role string, unanswered boolean"


def kahn(nodes: list[int], following: list[list[int]], stamps: list[str | None]) -> tuple[list[int], list[int]]:
    """The order of the messages (as positions) and those that no message here precedes.

    A message is freed when all messages it follows are placed; of the free ones the earliest goes first (no
    timestamp: before all others), then the least number. Positions missing from the order are on or behind a
    cycle.
    """
    at: dict[int, list[int]] = {}
    for i, n in enumerate(nodes):
        at.setdefault(n, []).append(i)
    waits = [0] * len(nodes)
    for targets in following:
        for f in targets:
            for j in at.get(f, ()):
                waits[j] += 1
    roots = [i for i, n in enumerate(waits) if n == 0]
    free = [(stamps[i] or "", nodes[i], i) for i in roots]
    heapq.heapify(free)
    order = []
    while free:
        i = heapq.heappop(free)[2]
        order.append(i)
        for f in following[i]:
            for j in at.get(f, ()):
                waits[j] -= 1
                if waits[j] == 0:
                    heapq.heappush(free, (stamps[j] or "", nodes[j], j))
    return order, roots


def _segment(key: tuple, rows: pa.Table, width: int, summary: bool) -> pa.Table:
    conversation, segment = key[0].as_py(), key[1].as_py()
    nodes, following, stamps, roles, broken = (rows.column(c).to_pylist() for c in ("node", "next", "ts", "role", "broken"))
    following = [sorted({f for f in x or () if f is not None}) for x in following]
    order, roots = kahn(nodes, following, stamps)
    if not summary:
        texts = rows.column("text").to_pylist()
        return pa.table(
            [[conversation] * len(order), [segment] * len(order), list(range(len(order))), [nodes[i] for i in order], [roles[i] for i in order], [texts[i] for i in order]],
            schema=pa.schema([("conversation", pa.string()), ("segment", pa.int64()), ("local", pa.int64()), ("node", pa.int64()), ("role", pa.string()), ("text", pa.string())]),
        )
    own = set(nodes)
    out = [f for x in following for f in x if f not in own]
    said = [roles[i] for i in order if roles[i]]
    values = [
        conversation, segment, [nodes[i] for i in roots], [f for f in out if f // width != segment], any(f // width < segment for f in out), len(nodes), len(order), any(broken) or len(own) < len(nodes),
        said[0] if said else None, said[-1] if said else None, any(a == b == "user" for a, b in zip(said, said[1:])),
    ]
    numbers = pa.list_(pa.int64())
    kinds = [pa.string(), pa.int64(), numbers, numbers, pa.bool_(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
    names = [x.split()[0] for x in _SUMMARY.split(", ")]
    return pa.table([pa.array([v], k) for v, k in zip(values, kinds)], names=names)


def _grouped(messages: DataFrame, width: int, *more: str):
    return messages.select("conversation", F.floor(F.col("node") / F.lit(width)).cast("bigint").alias("segment"), "node", "next", "ts", "role", "broken", *more).groupBy("conversation", "segment")


def segments(messages: DataFrame, width: int = SEGMENT) -> DataFrame:
    """One summary row per conversation and segment. Only numbers, stamps and roles are shuffled, no texts."""
    return _grouped(messages, width).applyInArrow(lambda key, rows: _segment(key, rows, width, True), _SUMMARY)


def verdicts(messages: DataFrame, width: int = SEGMENT, origin: int | None = 0) -> DataFrame:
    """(conversation, dropped): whether a conversation is broken, empty or lacks a reply.

    Whole is a conversation with one root, the message numbered ``origin`` (None: any), from which all others are
    reached without a cycle. In its order prompts and replies must take turns: none is unanswered, none comes first.
    """
    rows = cut(segments(messages, width))
    roots = rows.select("conversation", F.explode("roots").alias("node"))
    edges = rows.select("conversation", F.explode("exits").alias("node")).distinct()
    begun = roots.join(edges, ["conversation", "node"], "left_anti").groupBy("conversation").agg(F.count("*").alias("starts"), F.min("node").alias("first"))
    w = Window.partitionBy("conversation").orderBy("segment")
    rows = rows.withColumn("spoke", F.last("last_role", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    torn = (F.col("placed") < F.col("messages")) | F.col("broken") | F.col("back")
    wrong = F.col("unanswered") | F.coalesce(F.col("spoke").isNull() & (F.col("first_role") == "assistant"), F.lit(False)) | F.coalesce((F.col("spoke") == "user") & (F.col("first_role") == "user"), F.lit(False))
    per = rows.groupBy("conversation").agg(F.max(torn | wrong).alias("bad"), F.max_by("last_role", F.when(F.col("last_role").isNotNull(), F.col("segment"))).alias("end"))
    per = per.join(begun, "conversation", "left")
    lost = F.coalesce(F.col("starts") != 1, F.lit(True)) | (F.lit(False) if origin is None else F.coalesce(F.col("first") != origin, F.lit(True)))
    return per.select("conversation", (F.col("bad") | lost | F.col("end").isNull() | (F.col("end") != "assistant")).alias("dropped"))


def conversations(messages: DataFrame, width: int = SEGMENT, origin: int | None = 0) -> DataFrame:
    """The kept conversations: (conversation, position, node, role, text), positions from 0.

    Null roles and texts take no position. Repeated message numbers, gaps, cycles and broken messages drop the
    whole conversation. An empty table gives no rows.
    """
    kept = verdicts(messages, width, origin).where("not dropped").select("conversation")
    rows = _grouped(messages.join(kept, "conversation", "left_semi"), width, "text").applyInArrow(lambda key, part: _segment(key, part, width, False), _ROWS)
    rows = rows.where("role is not null")
    sizes = rows.groupBy("conversation", "segment").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conversation").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    local = F.row_number().over(Window.partitionBy("conversation", "segment").orderBy("local")) - 1
    return rows.withColumn("local", local).join(sizes, ["conversation", "segment"]).select("conversation", (F.col("base") + F.col("local")).alias("position"), "node", "role", "text")
