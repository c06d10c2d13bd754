"""Ordered scans that no single task has to hold.

A window over one key puts all rows of that key into one task. Here each key is first split into blocks of
its order column; every block is scanned by itself, one summary row per block is carried across blocks, and
the carry is joined back. A key with a third of all rows is thus spread over as many tasks as it has blocks.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "__block"


def with_block(df: DataFrame, order: str, width: int) -> DataFrame:
    return df.withColumn(BLOCK, F.floor(F.coalesce(F.col(order), F.lit(0)) / F.lit(width)).cast("bigint"))


def scan(df: DataFrame, keys: list[str], order: str, last: dict[str, Column], running: dict[str, Column], width: int) -> DataFrame:
    """WN1: for each name of ``last`` the last non-null value up to and including the row, for each of ``running`` the sum so far.

    Rows of equal order count together.
    """
    inner = Window.partitionBy(*keys, BLOCK).orderBy(order)
    local = with_block(df, order, width)
    local = local.withColumns({f"__v_{n}": c for n, c in (last | running).items()})
    summary = local.groupBy(*keys, BLOCK).agg(
        *[F.max_by(f"__v_{n}", F.when(F.col(f"__v_{n}").isNotNull(), F.col(order))).alias(f"__c_{n}") for n in last],
        *[F.sum(f"__v_{n}").alias(f"__c_{n}") for n in running],
    )
    before = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(
        *[F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)],
        F.col(BLOCK).alias("__kb"),
        *[F.last(f"__c_{n}", ignorenulls=True).over(before).alias(f"__b_{n}") for n in last],
        *[F.sum(f"__c_{n}").over(before).alias(f"__b_{n}") for n in running],
    )
    some = [F.col(f"__b_{n}").isNotNull() for n in last | running]
    for other in some[1:]:
        some[0] = some[0] | other
    carried = carried.where(some[0])  # first blocks have nothing to carry
    local = local.withColumns(
        {f"__l_{n}": F.last(f"__v_{n}", ignorenulls=True).over(inner) for n in last} | {f"__l_{n}": F.sum(f"__v_{n}").over(inner) for n in running}
    )
    on = [F.col(k).eqNullSafe(F.col(f"__k_{i}")) for i, k in enumerate(keys)] + [F.col(BLOCK) == F.col("__kb")]
    joined = local.join(carried, on, "left")
    out = {n: F.coalesce(F.col(f"__l_{n}"), F.col(f"__b_{n}")) for n in last} | {n: F.coalesce(F.col(f"__l_{n}"), F.lit(0)) + F.coalesce(F.col(f"__b_{n}"), F.lit(0)) for n in running}
    return joined.select(*df.columns, *[c.alias(n) for n, c in out.items()])
