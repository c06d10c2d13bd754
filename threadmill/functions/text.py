"""Scalar expressions of the data model; all stay in the JVM."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

_LEADING, _TRAILING = r"(?U)^[\s\x1c-\x1f\x85]+", r"(?U)[\s\x1c-\x1f\x85]+$"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def strip(x: Column | str) -> Column:
    """FN5: strip every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(F.regexp_replace(col(x), _LEADING, ""), _TRAILING, "")


def is_blank(x: Column | str) -> Column:
    return F.length(strip(x)) == 0


def or_empty(x: Column | str) -> Column:
    return F.coalesce(col(x), F.lit(""))


def none_if_empty(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(""))


def sha16(x: Column | str) -> Column:
    """FN1: the first 16 hex digits of SHA-256."""
    return F.substring(F.sha2(col(x), 256), 1, 16)


def key60(x: Column | str) -> Column:
    """FN2: the 60-bit key of a doc_id."""
    return F.conv(F.substring(F.sha2(col(x), 256), 1, 15), 16, 10).cast("bigint")


def utf8_bytes(x: Column | str) -> Column:
    """FN3."""
    return F.octet_length(col(x))


def truncated(x: Column | str, limit: int) -> Column:
    """FN4: cut after ``limit`` code points and say so."""
    return F.when(F.length(col(x)) > limit, F.concat(F.substring(col(x), 1, limit), F.lit("\n\n[truncated]"))).otherwise(col(x))


def slug_of(root: Column | str) -> Column:
    """FN10."""
    return F.translate(col(root), "/.", "--")


def base_name(path: Column | str) -> Column:
    """FN9."""
    return F.element_at(F.split(col(path), "/"), -1)


def stem(path: Column | str) -> Column:
    """FN9: the base name without its last suffix (a leading dot starts no suffix)."""
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]*$", "")


def slug_of_path(path: Column | str, base: str) -> Column:
    """FN11: the first folder below ``base``; null where the path lies elsewhere."""
    prefix = base.rstrip("/") + "/"
    rest = F.substring(col(path), len(prefix) + 1, 1 << 30)
    return F.when(F.startswith(col(path), F.lit(prefix)) & F.contains(rest, F.lit("/")), F.substring_index(rest, "/", 1))


def equal_filters(**wanted: str | None) -> Column:
    """FL1: the conjunction of those equality filters whose value is neither None nor ''."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in wanted.items() if v], F.lit(True))


def date_filters(column: str, date_from: str | None = None, date_to: str | None = None) -> Column:
    """FL2, FL3: lexicographic bounds; the upper one ends at the last whole second of the day."""
    out = F.lit(True)
    if date_from:
        out &= F.col(column) >= F.lit(date_from)
    if date_to:
        out &= F.col(column) <= F.lit(date_to + "T23:59:59")
    return out


_COMPARE = {"gte": lambda c, v: c >= v, "lte": lambda c, v: c <= v, "gt": lambda c, v: c > v, "lt": lambda c, v: c < v}


def operator_filters(filters: dict | None) -> Column:
    """FL4: ``{"timestamp_gte": (">=", x)}`` or plain equality; None is skipped. The tuple's operator decides."""
    out = F.lit(True)
    sign = {">=": "gte", "<=": "lte", ">": "gt", "<": "lt"}
    for key, value in (filters or {}).items():
        if value is None:
            continue
        if isinstance(value, tuple):
            name = key.rpartition("_")[0] if key.rpartition("_")[2] in _COMPARE else key
            out &= _COMPARE[sign[value[0]]](F.col(name), F.lit(value[1]))
        else:
            out &= F.col(key) == F.lit(value)
    return out
