"""Running totals and row numbers over a whole table, without a window that holds all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut


def running_total(df: DataFrame, value: Column, name: str, *order: str) -> DataFrame:
    """Adds the sum of ``value`` over the rows before each, in an order that has no ties. Ranges of the order sum
    up their own rows; only a row a range meets in one place."""
    rows = cut(df.withColumn("_v", value.cast("long")).orderBy(*order).withColumn("_p", F.spark_partition_id()))
    before = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy("_p").agg(F.sum("_v").alias("_s"))
    ranges = ranges.select("_p", F.coalesce(F.sum("_s").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    out = rows.withColumn("_o", F.coalesce(F.sum("_v").over(before), F.lit(0))).join(F.broadcast(ranges), "_p")
    return out.withColumn(name, (F.col("_o") + F.col("_b")).cast("long")).drop("_v", "_p", "_o", "_b")


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """Adds row numbers from 1, in an order that has no ties."""
    return running_total(df, F.lit(1), name, *order).withColumn(name, F.col(name) + 1)
