"""Numbers 0, 1, ... over many rows, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, name: str, order: Column, bucket: Column, within: list[str] | None = None) -> DataFrame:
    """rows with a column `name`: the place by `order`, for each value of `within`.

    bucket: a column that never falls along the order, and by whose values the rows fall into groups that a task can hold.
    Counts of buckets are summed up first; rows are sorted only inside their bucket.
    """
    keys = within or []
    rows = rows.withColumn("__bucket", bucket)
    one = [F.lit(0)] if not keys else [F.col(k) for k in keys]
    before = Window.partitionBy(*one).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy(*keys, "__bucket").agg(F.count(F.lit(1)).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    inside = Window.partitionBy(*keys, "__bucket").orderBy(order)
    out = rows.withColumn("__nth", F.row_number().over(inside)).join(base, [*keys, "__bucket"])
    return out.withColumn(name, (F.col("__base") + F.col("__nth") - 1).cast("long")).drop("__bucket", "__base", "__nth")
