"""Distributed running sums: no key, however hot, is gathered into one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 1 << 32
ROWS_PER_BUCKET = 2_000


def hash_position(key: Column) -> Column:
    """An even position in [0, 2**32) from the first 32 bits of the MD5 of ``key``."""
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def running_sums(
    df: DataFrame,
    keys: list[str],
    position: str,
    order: list[Column],
    sums: dict[str, Column],
    rows: int,
) -> DataFrame:
    """Add, for each ``name: value`` of ``sums``, the total of the rows before this one.

    Rows of a key are ordered by ``position`` (a long in [0, 2**32), monotone in
    the wanted order) and then ``order``.  Each key's rows are cut by position
    into buckets of about ``ROWS_PER_BUCKET`` of ``rows`` in all; one window adds
    bucket totals, another works inside each bucket.
    """
    buckets = max(1, math.ceil(rows / ROWS_PER_BUCKET))
    cut = df.withColumn("_bucket", F.floor(F.col(position) * F.lit(buckets) / F.lit(SPAN)).cast("long"))
    by = [*keys, "_bucket"]
    parts = cut.groupBy(*by).agg(*(F.sum(v).alias(f"_before_{k}") for k, v in sums.items()))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(*by, *(F.coalesce(F.sum(f"_before_{k}").over(earlier), F.lit(0)).alias(f"_before_{k}") for k in sums))
    inside = Window.partitionBy(*by).orderBy(position, *order).rowsBetween(Window.unboundedPreceding, -1)
    out = cut.join(offsets, by)
    for k, v in sums.items():
        out = out.withColumn(k, F.coalesce(F.sum(v).over(inside), F.lit(0)) + F.col(f"_before_{k}"))
    return out.drop("_bucket", *(f"_before_{k}" for k in sums))
