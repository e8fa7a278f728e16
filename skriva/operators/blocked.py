"""Ordered computations over groups of any size.

A window over a whole group runs in one task. Here a group is cut into blocks of its order number; windows run within
blocks, and what a block needs from the ones before it is taken from one row per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Order numbers in a block.
BLOCK = 4096


def _block(order: str) -> Column:
    return F.floor(F.col(order) / BLOCK)


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the sum of `value` over the rows of the group up to and including each; order[0] is a whole number."""
    df = df.withColumn("_v", value).withColumn("_b", _block(order[0]))
    sums = df.groupBy(*keys, "_b").agg(F.sum("_v").alias("_s"))
    before = F.sum("_s").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sums.select(*keys, "_b", F.coalesce(before, F.lit(0)).alias("_o"))
    within = F.sum("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_w", within).join(offsets, [*keys, "_b"]).withColumn(name, F.col("_o") + F.col("_w")).drop("_v", "_b", "_w", "_o")


def previous_value(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """`df` with the last non-null `value` before each row of the group, or null; order[0] is a whole number."""
    df = df.withColumn("_v", value).withColumn("_b", _block(order[0]))
    last = df.where("_v IS NOT NULL").groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_l"))
    # A row for each block, also for those without a value.
    blocks = df.select(*keys, "_b").distinct().join(last, [*keys, "_b"], "left")
    carried = F.last("_l", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    carried = blocks.select(*keys, "_b", carried.alias("_c"))
    within = F.last("_v", ignorenulls=True).over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("_w", within).join(carried, [*keys, "_b"]).withColumn(name, F.coalesce("_w", "_c")).drop("_v", "_b", "_w", "_c")
