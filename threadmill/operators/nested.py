"""Problem 7: nested records as flat tables with parent links."""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadmill.functions.json import decoded, elements, is_object
from threadmill.operators.lines import held_lines
from threadmill.session import cut


def _elements(v: Column) -> Column:
    """The elements of an array; an object counts as an array of one; else null."""
    return F.when(is_object(v), F.array(v)).otherwise(elements(v))


#: Where blocks lie in an entry and in a block: at the first of these paths that has elements.
ENTRY_BLOCKS, BLOCK_BLOCKS = (("message", "content"),), (("content",), ("source", "content"))


def _children(value: Column, paths: list[tuple[str, ...]]) -> Column:
    return F.coalesce(*[_elements(F.try_variant_get(value, _at(p), "variant")) for p in paths]) if paths else F.lit(None).cast("array<variant>")


def key(*parts: Column | str) -> Column:
    """A surrogate key of 128 bits: the hash of a row's place."""
    return F.md5(F.concat_ws("\0", *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts]))


_TYPES = {"BIGINT": "bigint", "STRING": "string", "BOOLEAN": "boolean"}
MOST_KEYS = 1000
_NUMBERS = {"BIGINT", "DECIMAL", "DOUBLE", "FLOAT"}


@dataclass(frozen=True)
class Field:
    path: tuple[str, ...]
    kind: str
    listed: bool  # somewhere it is an array that holds objects
    single: bool  # somewhere it is an object


def merged_schema(df: DataFrame, value: str, wanted: tuple[tuple[str, ...], ...] | None = None) -> list[Field]:
    """Every field of an object column, through nested objects, or those on the way to the ``wanted`` paths.

    The type is what the values have in common: mixed numbers are double, other mixtures and arrays variant;
    a field of objects only is 'object'. Each depth is one aggregation; one row per distinct path reaches the driver.
    An object that has over MOST_KEYS different keys in the data is a map, whose keys are no fields: it stays whole.
    """
    level, out = df.select(F.array().cast("array<string>").alias("p"), F.col(value).alias("v")).where(is_object(F.col("v"))), []
    deep = 0
    while True:
        fields = level.select("p", F.explode(F.map_entries(F.expr("try_variant_get(v, '$', 'map<string,variant>')"))).alias("e")).select(F.concat("p", F.array("e.key")).alias("p"), F.col("e.value").alias("v"))
        if wanted is not None:
            heads = sorted({p[: deep + 1] for p in wanted if len(p) > deep})
            fields = fields.where(reduce(lambda a, b: a | b, [F.col("p") == F.array(*map(F.lit, p)) for p in heads]))
        deep += 1
        kinds = fields.withColumn("t", F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)).where("t <> 'VOID'")
        listed = F.coalesce(F.exists(elements(F.col("v")), is_object), F.lit(False))
        per = kinds.groupBy("p").agg(F.collect_set("t").alias("t"), F.max(listed).alias("listed"), F.count("*").alias("n"))
        few = per.groupBy(F.slice("p", 1, F.size("p") - 1).alias("of")).agg(F.count("*").alias("keys")).where(F.col("keys") <= MOST_KEYS).drop("keys")
        per = per.join(few, F.slice("p", 1, F.size("p") - 1) == F.col("of"), "left_semi").collect()
        for r in sorted(per, key=lambda r: (-r.n, r.p)):
            t = set(r.t)
            kind = "object" if t == {"OBJECT"} else _TYPES.get(*t, "variant") if len(t) == 1 and t <= _TYPES.keys() else "double" if t <= _NUMBERS else "variant"
            out.append(Field(tuple(r.p), kind, r.listed, "OBJECT" in t))
        if not any("OBJECT" in r.t for r in per) or wanted is not None and deep >= max(map(len, wanted)):
            return out
        level = fields.where(is_object(F.col("v")))


def nested_paths(df: DataFrame, value: str, wanted: tuple[tuple[str, ...], ...]) -> list[tuple[str, ...]]:
    """Those of the wanted paths at which the merged schema has objects, alone or in arrays, in the order wanted."""
    there = {f.path for f in merged_schema(df, value, wanted) if f.listed or f.single}
    return [p for p in wanted if p in there]


def blocks_of_lines(lines: DataFrame, keep: bool = True) -> DataFrame:
    """Every block of each decodable line that holds, one level of nesting after another.

    Columns: path, byte_start, block_path, parent_path, depth, ordinal, block_key, parent_key and, if ``keep``, the
    block itself (variant). block_key is a surrogate of the place, parent_key that of the enclosing block or, at the
    top, of the entry. The merged schema of a level says at which of the block paths there are objects; these are
    exploded into the next level, until there are none. A level is written to the shared folder before the next one
    is taken from it. Lines that are null, blank, not JSON or have no blocks give no rows; elements that are no
    objects keep their position.
    """
    held = held_lines(lines.select("path", "byte_start", "byte_len", "line", "seen_at"))
    entries = held.select("path", "byte_start", decoded("line").alias("v")).where(is_object(F.col("v")))
    message = F.when(is_object(F.try_variant_get("v", "$.message", "variant")), F.try_variant_get("v", "$.message.content", "variant"))
    slim = entries.select("path", "byte_start", F.lit("").alias("at"), key("path", "byte_start", F.lit("")).alias("own"), message.alias("block"))  # of an entry only what may hold blocks
    level = slim.select("path", "byte_start", F.col("at").alias("parent_path"), F.col("own").alias("parent_key"), F.posexplode(_elements(F.col("block"))).alias("ordinal", "block"))
    out, depth = None, 0
    while True:
        path = F.concat_ws(".", F.nullif("parent_path", F.lit("")), F.col("ordinal").cast("string"))
        level = level.where(is_object(F.col("block"))).withColumn("block_path", path)
        level = level.select("path", "byte_start", "block_path", "parent_path", F.lit(depth).alias("depth"), "ordinal", key("path", "byte_start", "block_path").alias("block_key"), "parent_key", "block")
        level = cut(level)
        flat = level if keep else level.drop("block")
        out = flat if out is None else out.unionByName(flat)
        paths = nested_paths(level, "block", BLOCK_BLOCKS)
        if not paths:
            return out
        below = level.select("path", "byte_start", F.col("block_path").alias("parent_path"), F.col("block_key").alias("parent_key"), _children(F.col("block"), paths).alias("c")).where(F.size("c") > 0)
        level = below.select("path", "byte_start", "parent_path", "parent_key", F.posexplode("c").alias("ordinal", "block"))
        depth += 1


def flat_tables(lines: DataFrame) -> dict[str, DataFrame]:
    """``entries``, ``blocks`` and a child table for every further array of objects: one column per field of the merged schema.

    blocks.parent_key is the block_key of the enclosing block, or the entry_key of the entry at the top. A child
    table is called after its parent and the path of the array (``entries.message.usage.tiers``), with parent_key
    (the parent's key), ordinal and row_key. Field columns carry the prefix ``f_`` and so never clash with the
    keys; fields of nested objects are joined by dots. ``value`` keeps the whole object.
    """
    held = held_lines(lines.select("path", "byte_start", "byte_len", "line", "seen_at"))
    entries = held.select("path", "byte_start", key("path", "byte_start", F.lit("")).alias("entry_key"), decoded("line").alias("value")).where(is_object(F.col("value")))
    blocks = blocks_of_lines(lines).withColumnRenamed("block", "value")
    own = F.try_variant_get("value", "$.content", "variant")  # where it has elements, source.content holds no blocks
    return _tables("entries", cut(entries), "entry_key", {("message", "content"): F.lit(False)}) | _tables("blocks", blocks, "block_key", {("content",): F.lit(False), ("source", "content"): _elements(own).isNotNull()})


def _at(path: tuple[str, ...]) -> str:
    return "$" + "".join("['" + k.replace("\\", "\\\\").replace("'", "\\'") + "']" for k in path)


def _tables(name: str, df: DataFrame, own: str, blocks: dict[tuple, Column]) -> dict[str, DataFrame]:
    """A table and its child tables; what lies at ``blocks`` is in the table of blocks already, except in the rows given there."""
    columns, seen = {}, set()
    schema = merged_schema(df, "value")
    for path, kind in ((f.path, f.kind) for f in schema):
        column = "f_" + ".".join(path)
        while column.lower() in seen:  # names that differ in case only, or by where the dots are
            column += "_"
        seen.add(column.lower())
        if kind != "object":
            columns[column] = F.try_variant_get("value", _at(path), kind)
    out = {name: df.withColumns(columns) if columns else df}
    for path, listed in ((f.path, f.listed) for f in schema):
        if listed:
            rest = next((c for b, c in blocks.items() if path[: len(b)] == b), F.lit(True))
            child = df.where(rest).select("path", "byte_start", F.col(own).alias("parent_key"), F.posexplode(elements(F.try_variant_get("value", _at(path), "variant"))).alias("ordinal", "value")).where(is_object(F.col("value")))
            child = child.withColumn("row_key", key("parent_key", F.lit(".".join(path)), "ordinal"))
            child = cut(child)
            if not child.isEmpty():
                out |= _tables(f"{name}.{'.'.join(path)}", child, "row_key", {})
    return out
