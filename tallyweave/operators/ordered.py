"""Positions and running sums over a whole ordered table, without one task that sees all rows.

Rows are parted by ranges of their order; each range counts or adds up its own rows, and one row per range tells what lies
before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import checkpointed


def _offsets(parts: DataFrame, sums: DataFrame) -> DataFrame:
    """`parts` with `_before`: the total `n` of the ranges before each row's own. One row per range comes to the driver."""
    before, total = [], 0
    for part, n in sorted((r["_part"], r["n"]) for r in sums.collect()):
        before.append((part, total))
        total += n
    # A small table, not literals: with many ranges these would make a plan of that size.
    shift = parts.sparkSession.createDataFrame(before, "_part int, _before bigint")
    return parts.join(F.broadcast(shift), "_part")


def numbered(df: DataFrame, *order: str) -> DataFrame:
    """`df` sorted by `order` with its position `pos` from 0: row numbers within range partitions plus the rows before them."""
    parts = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()).withColumn("_nth", F.monotonically_increasing_id() % (1 << 33)))
    x = _offsets(parts, parts.groupBy("_part").agg(F.count("*").alias("n")))
    return x.withColumn("pos", (F.col("_nth") + F.col("_before")).cast("bigint")).drop("_part", "_nth", "_before")


def running_sum(df: DataFrame, value: str, *order: str) -> DataFrame:
    """`df` with `before`: the sum of the whole-number column `value` over the rows before each, in `order`. Null values count as 0."""
    parts = checkpointed(df.orderBy(*order).withColumn("_part", F.spark_partition_id()))
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = _offsets(parts.withColumn("_own", own), parts.groupBy("_part").agg(F.coalesce(F.sum(value), F.lit(0)).cast("bigint").alias("n")))
    return x.withColumn("before", (F.col("_own") + F.col("_before")).cast("bigint")).drop("_part", "_own", "_before")
