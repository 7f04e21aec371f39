"""Running sums along an order, without putting a whole key into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_sum(rows: DataFrame, keys: list[str], bucket: str, order: list[Column], value: Column, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``value`` up to and including the row, along (bucket, order) within
    the keys. ``bucket`` is a column that never falls along the order; sums run within (keys, bucket) and
    add the totals of earlier buckets, of which there is one row each. ``order`` must be total."""
    within = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("_local", F.sum(value).over(within))
    totals = rows.groupBy(*keys, bucket).agg(F.sum(value).alias("_total"))
    earlier = totals.select(*keys, bucket, F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_earlier"))
    return local.join(earlier, [*keys, bucket]).withColumn(out, F.col("_local") + F.col("_earlier")).drop("_local", "_earlier")
