"""The lines that hold: the last delivery of every place in a transcript."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def held_lines(lines: DataFrame, digest: str | None = None) -> DataFrame:
    """One row per (path, byte_start): the one with the latest seen_at.

    Ties of seen_at go to the greater text, then to the longer byte_len. Rows without path or byte_start name
    no place and are left out; a null seen_at is earlier than any other. Extra columns are kept. ``digest`` names a
    column with the SHA-256 of the text where the text itself is not among the columns.
    """
    w = Window.partitionBy("path", "byte_start").orderBy(F.desc_nulls_last("seen_at"), F.desc_nulls_last(F.col(digest) if digest else F.sha2("line", 256)), F.desc_nulls_last("byte_len"))
    placed = lines.where(F.col("path").isNotNull() & F.col("byte_start").isNotNull())
    return placed.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
