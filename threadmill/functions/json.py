"""JSON lines as variants, without the parser's leniency."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_object(v: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), F.lit(False))


def is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def elements(v: Column) -> Column:
    """An array's elements, else null."""
    return F.try_variant_get(v, "$", "array<variant>")


def decoded(line: Column | str) -> Column:
    """The JSON value that the whole text is, or null.

    The parser stops at the end of the first value, so ``{..}{..}`` would pass. Between brackets such a text
    fails, unless it goes on with a closing bracket or a comma; between braces those fail.
    """
    text = F.col(line) if isinstance(line, str) else line
    one = elements(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))))
    whole = F.try_parse_json(F.concat(F.lit('{"a":'), text, F.lit("}"))).isNotNull()
    return F.when((F.size(one) == 1) & whole, F.get(one, 0))


def decoded_object(line: Column | str) -> Column:
    """The JSON object that the whole text is, or null."""
    v = decoded(line)
    return F.when(is_object(v), v)
