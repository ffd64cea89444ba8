"""Facet counts: for every dimension, how many of the filtered records have each value.

Scalar and list dimensions are counted by one scan and one shuffle: a record becomes its (dimension, value) pairs,
which are added up on each side of the shuffle. The result has one row for each value:
(dimension, didx, dvidx, value, count, min_value, max_value); the last two are a bucket's ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Field, Schema
from .dictionary import LONGEST, pairs


def _named(counts: DataFrame, dimensions: list[Field]) -> DataFrame:
    name = F.create_map(*[x for f in dimensions for x in (F.lit(f.didx).cast("long"), F.lit(f.name))])
    steps = {f.didx: f.numeric_break for f in dimensions if f.numeric_break}
    low, high = F.lit(None).cast("long"), F.lit(None).cast("long")
    for didx, step in steps.items():
        at = F.expr("try_cast(value as bigint)")
        low = F.when(F.col("didx") == didx, at).otherwise(low)
        high = F.when(F.col("didx") == didx, at + step).otherwise(high)
    return counts.select(F.element_at(name, F.col("didx")).alias("dimension"), "didx", "dvidx", "value", "count", low.alias("min_value"), high.alias("max_value"))


def counts(records: DataFrame, dictionary: DataFrame, dimensions: list[Field], include_empty: bool = False) -> DataFrame:
    """Facets of the records. include_empty: known values that no record has, with count 0."""
    if not dimensions:
        return _named_empty(records)
    found = pairs(records, dimensions).groupBy("didx", "value").agg(F.count(F.lit(1)).alias("count"))
    ids = dictionary.filter(F.col("didx").isin([f.didx for f in dimensions])).select("didx", "dvidx", F.substring("value", 1, LONGEST).alias("value"))
    rows = ids.join(found, ["didx", "value"], "left").withColumn("count", F.coalesce("count", F.lit(0))) if include_empty else found.join(ids, ["didx", "value"], "left")
    return _named(rows, dimensions)


def _named_empty(records: DataFrame) -> DataFrame:
    return records.sparkSession.createDataFrame([], "dimension string, didx long, dvidx long, value string, count long, min_value long, max_value long")


def hierarchy(found: DataFrame, schema: Schema) -> DataFrame:
    """Without dimensions whose parent still has several values, over and over. The driver sees one number for each dimension."""
    parents = {f.didx: schema[f.parent].didx for f in schema.dimensions if f.parent}
    if not parents:
        return found
    several = {r["didx"]: r["n"] for r in found.groupBy("didx").agg(F.count(F.lit(1)).alias("n")).collect()}
    hidden: set[int] = set()
    while more := {d for d, p in parents.items() if d not in hidden and (several.get(p, 0) > 1 or p in hidden)}:
        hidden |= more
    return found.filter(~F.col("didx").isin(list(hidden))) if hidden else found


def totals(found: DataFrame) -> DataFrame:
    """Values and their counts' sum, by dimension."""
    return found.groupBy("dimension").agg(F.count(F.lit(1)).alias("n_values"), F.sum("count").alias("records"))
