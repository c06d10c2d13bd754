"""Problem 9: texts of varying length in model inputs of fixed capacity.

Mixture-controlled packing: every source has a queue and a deficit, the tokens that it is behind its share. A window
(one model input) adds to each deficit the source's share of the capacity, then serves the sources round by round,
the one furthest behind first, with the largest text that its deficit and the room allow; when no deficit suffices,
the largest text that fits closes the gap and its source goes into debt. Deficits are carried from window to window.

Rows are spread over shards of a bounded size, whatever their source. Each shard packs by itself and hands on the
texts of its badly filled last windows and its deficits; these meet in ever fewer shards until one is left.
"""

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadmill.llm import tokens
from threadmill.session import cut

#: Texts of a shard, shards that meet in one of the next round, and the share of a window below which it is handed on.
SHARD, FAN, FULL = 50_000, 32, 0.98
#: Models that are packed for at once; their table is broadcast.
MOST_MODELS = 1000
_ITEM = "model_key string, capacity int, shard bigint, kind string, source string, row bigint, token_start bigint, size bigint, share double"
_OUT = "model_key string, capacity int, shard bigint, kind string, source string, row bigint, token_start bigint, size bigint, window bigint, position int, deficit double"


class Queue:
    """The texts of a source, by size."""

    def __init__(self, items: list[tuple]):
        self.items = sorted(items)

    def most(self, limit: float) -> int:
        """The place of the largest text of at most ``limit`` tokens, -1 where there is none."""
        return bisect_right(self.items, (limit, float("inf"))) - 1


def windows(items: dict[str, list[tuple]], shares: dict[str, float], deficits: dict[str, float], capacity: int) -> list[list[tuple]]:
    """Windows of (size, row, token_start, source), filled in place of ``deficits``. Sizes are 1 to capacity."""
    queues = {s: Queue(x) for s, x in items.items() if x}
    out = []
    while queues:
        whole = sum(shares[s] for s in queues)
        for s in queues:
            deficits[s] = deficits.get(s, 0.0) + capacity * shares[s] / whole
        room, window = capacity, []
        behind = sorted((-deficits[s], s) for s in queues)
        while room:
            served = False
            for k, (_, s) in enumerate(behind):
                if deficits[s] < 1:
                    break  # nothing is due to the rest
                at = queues[s].most(min(room, deficits[s]))
                if at >= 0:
                    served = True
                    break
            if not served:  # nothing is due: what fits best, of the source furthest behind where equal
                best = [(queues[s].items[at][0], deficits[s], s, at) for s in queues if (at := queues[s].most(room)) >= 0]
                if not best:
                    break
                _, _, s, at = max(best)
            size, row, start = queues[s].items.pop(at)
            window.append((size, row, start, s))
            if not served:
                k = bisect_left(behind, (-deficits[s], s))
            del behind[k]
            deficits[s] -= size
            room -= size
            if queues[s].items:
                insort(behind, (-deficits[s], s))
            else:
                del queues[s]
        if room:
            room = _exchange(window, room, queues, deficits)
        out.append(window)
    return out


def _exchange(window: list[tuple], room: int, queues: dict[str, Queue], deficits: dict[str, float]) -> int:
    """Swap a text of the window for a larger one of its own source that takes up more of the room left."""
    for i, (size, row, start, s) in enumerate(window):
        if s in queues and (at := queues[s].most(size + room)) >= 0 and queues[s].items[at][0] > size:
            new = queues[s].items.pop(at)
            insort(queues[s].items, (size, row, start))
            window[i] = (*new, s)
            deficits[s] -= new[0] - size
            room -= new[0] - size
            if not room:
                break
    return room


def _pack(rows: pa.Table, last: bool) -> pa.Table:
    """One shard: rows of kind item and deficit in; packed items, items that are handed on, and deficits out."""
    d = rows.to_pydict()
    capacity, shard, model = d["capacity"][0], d["shard"][0], d["model_key"][0]
    items, shares, deficits = {}, {}, {}
    for kind, s, row, start, size, share in zip(*(d[c] for c in ("kind", "source", "row", "token_start", "size", "share"))):
        shares[s] = share if kind == "item" else shares.get(s, 0.0)
        if kind == "item":
            items.setdefault(s, []).append((size, row, start))
        else:
            deficits[s] = deficits.get(s, 0.0) + share
    out = {c.split()[0]: [] for c in _OUT.split(", ")}

    def put(kind, source, row, start, size, window=None, position=None, deficit=None):
        for name, v in zip(out, (model, capacity, shard, kind, source, row, start, size, window, position, deficit)):
            out[name].append(v)

    for w, window in enumerate(windows(items, shares, deficits, capacity)):
        full = last or sum(x[0] for x in window) >= FULL * capacity
        for p, (size, row, start, s) in enumerate(window):
            if not full:
                deficits[s] += size
            put("packed" if full else "item", s, row, start, size, w if full else None, p if full else None)
    for s, x in sorted(deficits.items()):
        put("deficit", s, None, None, None, deficit=x)
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64()}
    return pa.table({n: pa.array(out[n], kinds[t]) for n, t in (c.split() for c in _OUT.split(", "))})


def _open(rows: pa.Table) -> pa.Table:
    return _pack(rows, False)


def _closing(rows: pa.Table) -> pa.Table:
    return _pack(rows, True)


def inputs(sizes: DataFrame, models: DataFrame, shard: int = SHARD, fan: int = FAN, shares: dict[str, float] | None = None) -> DataFrame:
    """(model_key, input_id, position, row, token_start, n_tokens): the texts of each model input.

    sizes: (row, source, n_tokens), row unique; models: (model_key, max_tokens). A text longer than max_tokens is cut
    into parts of max_tokens tokens and a rest; no other is cut. Texts without tokens are in no input. A null source
    is a source. ``shares`` are the target shares by source, default: those of all tokens. Empty tables: no rows.
    """
    source = F.coalesce("source", F.lit("")).alias("source")
    sized = sizes.where("n_tokens > 0").select("row", source, F.col("n_tokens").cast("bigint").alias("n"))
    models = models.where("model_key is not null and max_tokens > 0").select("model_key", F.col("max_tokens").alias("capacity")).distinct()
    if models.limit(MOST_MODELS + 1).count() > MOST_MODELS:
        raise ValueError(f"over {MOST_MODELS} models")
    total = sized.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    per = sized.groupBy("source").agg((F.sum("n") / F.lit(max(total["n"] or 1, 1))).alias("share"))  # a row a source
    if shares is not None:
        given = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair]) if shares else F.create_map()
        per = per.withColumn("share", F.coalesce(given[F.col("source")].cast("double"), F.lit(0.0)) + 1e-9)
    count = max(1, -(-total["rows"] // shard))
    rows = sized.join(per, "source").crossJoin(F.broadcast(models))  # a row a model
    rows = rows.withColumn("token_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.col("capacity").cast("bigint"))))
    size = F.least(F.col("n") - F.col("token_start"), F.col("capacity"))
    rows = rows.select("model_key", "capacity", F.pmod(F.xxhash64("row"), F.lit(count)).alias("shard"), F.lit("item").alias("kind"), "source", "row", "token_start", size.alias("size"), "share")
    whole = rows.where("size = capacity").select("model_key", F.concat(F.lit("w-"), F.col("row"), F.lit("-"), F.col("token_start")).alias("input_id"), F.lit(0).alias("position"), "row", "token_start", F.col("size").alias("n_tokens"))
    out, rows, number = whole, rows.where("size < capacity"), 0
    while True:
        last = count == 1
        done = cut(rows.groupBy("model_key", "shard").applyInArrow(_closing if last else _open, _OUT))
        name = F.concat(F.lit(f"{number}-"), F.col("shard"), F.lit("-"), F.col("window"))
        out = out.unionByName(done.where("kind = 'packed'").select("model_key", name.alias("input_id"), "position", "row", "token_start", F.col("size").alias("n_tokens")))
        if last:
            return out
        number, count = number + 1, -(-count // fan)
        left = done.where("kind = 'item'").join(per, "source").select(*[c.split()[0] for c in _ITEM.split(", ")])
        owed = done.where("kind = 'deficit'").withColumn("share", F.col("deficit")).select(*[c.split()[0] for c in _ITEM.split(", ")])
        rows = left.unionByName(owed).withColumn("shard", F.floor(F.col("shard") / F.lit(fan)).cast("bigint"))


def pack(df: DataFrame, key: str, text: str, source: str, models: DataFrame, name: str = "byte_bpe_50k", folder: str = tokens.FOLDER, contents: bool = True, shard: int = SHARD) -> DataFrame:
    """Model inputs of the texts of ``df``.

    With contents: (model_key, input_id, keys array, lengths array<int>, ids array<int>), a row an input, ids in the
    order of the texts; an input is no larger than max_tokens. Without: inputs() with the key in place of the row.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(text).cast("string").alias("__text"), F.col(source).cast("string").alias("source"))
    kind = rows.schema["__key"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in tokens.portions(batch, 1):
                ids = tokens.loaded(folder, name).encode(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), ids if contents else pa.nulls(part.num_rows, pa.list_(pa.int32())), pa.array(ids.offsets.to_numpy()[1:] - ids.offsets.to_numpy()[:-1], pa.int32())], ["k", "source", "ids", "n_tokens"])

    encoded = rows.mapInArrow(run, f"k {kind}, source string, ids array<int>, n_tokens int")
    encoded = cut(encoded.withColumn("row", F.monotonically_increasing_id()))  # written, so a row keeps its number
    found = inputs(encoded.select("row", "source", "n_tokens"), models, shard=shard)
    if not contents:
        return found.join(encoded.select("row", F.col("k").alias(key)), "row").select("model_key", "input_id", "position", key, "token_start", "n_tokens")
    parts = found.join(encoded.select("row", "k", "ids"), "row").select("model_key", "input_id", "position", "k", F.slice("ids", F.col("token_start").cast("int") + 1, F.col("n_tokens").cast("int")).alias("ids"))
    whole = parts.groupBy("model_key", "input_id").agg(F.array_sort(F.collect_list(F.struct("position", "k", "ids"))).alias("p"))  # at most max_tokens
    field = lambda c: F.transform("p", lambda x: x[c])
    return whole.select("model_key", "input_id", field("k").alias("keys"), F.transform("p", lambda x: F.size(x["ids"])).alias("lengths"), F.flatten(field("ids")).alias("ids"))


def usage(found: DataFrame, models: DataFrame) -> DataFrame:
    """(model_key, inputs, tokens, unused): how many inputs there are and which share of their room is empty; ``found`` as inputs() gives it."""
    per = found.groupBy("model_key").agg(F.count_distinct("input_id").alias("inputs"), F.sum("n_tokens").alias("tokens"))
    return per.join(models.select("model_key", "max_tokens"), "model_key").select("model_key", "inputs", "tokens", (1 - F.col("tokens") / (F.col("inputs") * F.col("max_tokens"))).alias("unused"))


def mixture(found: DataFrame, sizes: DataFrame) -> DataFrame:
    """(model_key, input_id, source, share): the share of each source in the tokens of each input."""
    rows = found.join(sizes.select("row", F.coalesce("source", F.lit("")).alias("source")), "row").groupBy("model_key", "input_id", "source").agg(F.sum("n_tokens").alias("n"))
    whole = rows.groupBy("model_key", "input_id").agg(F.sum("n").alias("all"))
    return rows.join(whole, ["model_key", "input_id"]).select("model_key", "input_id", "source", (F.col("n") / F.col("all")).alias("share"))
