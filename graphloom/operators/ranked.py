"""Gapless ranks over a whole table without moving it to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.sources.shared import saved

PARTITION_ROWS = 100_000


def running_rank(df: DataFrame, order: list[Column], name: str = "rank") -> DataFrame:
    """Add the row's place from 0 in the order over all rows.

    Rows are range-partitioned by the order and kept, since a range
    partitioning drawn again may differ; each partition's count gives the
    next one's start, and a window ranks inside it.
    """
    parts = max(1, df.count() // PARTITION_ROWS + 1)
    ranged = saved(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranked")
    counts = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(*order)
    return ranged.join(starts, "_part").withColumn(name, F.col("_start") + F.row_number().over(inside) - 1).drop("_part", "_start")
