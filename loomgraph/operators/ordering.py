"""Running sums, numbers and joins over all rows without bringing them together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.store import settled


#: Rows of a part of a join or group; rows of a key from which its one partner goes to all tasks.
PART_ROWS, MANY = 2_000_000, 200_000


def parts_of(rows: int) -> int:
    return max(1, -(-rows // PART_ROWS))


def joined_once(rows: DataFrame, table: DataFrame, key: str, count: int) -> DataFrame:
    """rows (count of them) with the columns of table, which has each key once and in k how many rows have it. What table has of keys of MANY
    rows goes to all tasks (count over MANY rows at most); the others meet in parts whose number grows with the rows."""
    many = F.broadcast(table.where(F.col("k") >= MANY).drop("k"))
    parts = parts_of(count)
    few = rows.join(many.select(key), key, "left_anti").repartition(parts, key).join(table.where(F.col("k") < MANY).drop("k").repartition(parts, key), key)
    return few.unionByName(rows.join(many, key))


def running_sum(rows: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """rows with the sum of value up to each row in the order, itself included. Rows are dealt by ranges of the order;
    each range is summed by itself and gets what the ranges before it hold, a number a range. Rows that are
    alike in the order stay together in one range, so an order with many of a kind should be grouped first."""
    parts = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()).withColumn("__value", value)
    parts = settled(parts, "ranges")
    sums = parts.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sums = sums.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = parts.join(F.broadcast(sums), "__part").withColumn(name, F.col("__before") + F.sum("__value").over(inside))
    return joined.drop("__part", "__value", "__before")


def numbered_rows(rows: DataFrame, name: str, *order: str) -> DataFrame:
    """rows with their number from 1 in the order."""
    return running_sum(rows, F.lit(1).cast("long"), name, *order)
