"""Consecutive numbers in a global order, without a window over everything."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from procura.workspace import materialise, shuffle_partitions


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df`` with the place of each row, from 0 on, in an order that has no ties.

    Rows are range partitioned; a partition begins at the number of rows before it.
    """
    part = f"__part_{name}"
    ordered = materialise(df.repartitionByRange(shuffle_partitions(df.sparkSession), *order).withColumn(part, F.spark_partition_id()), "numbered")
    before = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    # One row a partition.
    starts = ordered.groupBy(part).agg(F.count(F.lit(1)).alias("n")).select(part, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy(part).orderBy(*order))
    return ordered.withColumn("__inside", inside).join(starts, part).withColumn(name, F.col("__start") + F.col("__inside") - 1).drop(part, "__start", "__inside")
