"""The dictionary of facet values: (didx, dvidx, value), grown, listed, renamed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ranking import numbered
from ..functions.scalar import facet_text
from ..schema import Field, Kind, Schema

COLUMNS = T.StructType([T.StructField("didx", T.LongType()), T.StructField("dvidx", T.LongType()), T.StructField("value", T.StringType())])
#: Longer values are cut.
LONGEST = 500


def value_texts(f: Field) -> Column:
    """The facet values of a record in one dimension, as an array of texts without NULL and without repeats."""
    c = F.col(f"`{f.name}`")
    if f.kind == Kind.LIST:
        return F.array_distinct(F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull()))
    text = facet_text(f, c)
    return F.when(text.isNotNull(), F.array(text)).otherwise(F.array().cast("array<string>"))


def pairs(records: DataFrame, dimensions: list[Field]) -> DataFrame:
    """(didx, value) for each record and value: one scan for all dimensions, lists among them."""

    def tagged(f: Field) -> Column:
        return F.transform(value_texts(f), lambda v: F.struct(F.lit(f.didx).cast("long").alias("didx"), F.substring(v, 1, LONGEST).alias("value")))

    each = [tagged(f) for f in dimensions]
    return records.select(F.explode(F.concat(*each)).alias("p")).select("p.didx", "p.value")


def grow(records: DataFrame, schema: Schema, known: DataFrame | None = None) -> DataFrame:
    """The dictionary with the records' new values, which get the next ids of their dimension by order of their text."""
    spark = records.sparkSession
    if known is None:
        known = spark.createDataFrame([], COLUMNS)
    if not schema.dimensions:
        return known
    fresh = pairs(records, schema.dimensions).distinct().join(known.select("didx", "value"), ["didx", "value"], "left_anti")
    fresh = numbered(fresh, "nth", F.col("value"), F.substring("value", 1, 3), ["didx"])
    first = F.create_map(*[x for d, n in schema.first_value.items() for x in (F.lit(d).cast("long"), F.lit(n).cast("long"))])
    last = known.groupBy("didx").agg(F.max("dvidx").alias("last"))
    fresh = fresh.join(F.broadcast(last), "didx", "left")  # one row for each dimension
    fresh = fresh.select("didx", (F.coalesce(F.col("last") + 1, F.element_at(first, F.col("didx"))) + F.col("nth")).alias("dvidx"), "value")
    return known.select("didx", "dvidx", "value").unionByName(fresh)


def combined(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The dictionary of a child repository: its own values and its parent's."""
    return parent.select("didx", "dvidx", "value").union(child.select("didx", "dvidx", "value")).distinct()


def dump(dictionary: DataFrame) -> DataFrame:
    return dictionary.select("didx", "dvidx", "value").orderBy("didx", "value")


def rename(records: DataFrame, dictionary: DataFrame, f: Field, dvidx: int, old: str, new: str | None) -> tuple[DataFrame, DataFrame]:
    """Records and dictionary with a value under another name, or with new=None without it."""
    name, c = f"`{f.name}`", F.col(f"`{f.name}`")
    here = F.col("dvidx") == dvidx
    if f.kind == Kind.LIST:
        changed = F.array_remove(c, old) if new is None else F.array_distinct(F.transform(c, lambda x: F.when(x == old, F.lit(new)).otherwise(x)))
    else:
        value = F.lit(None) if new is None else F.lit(new).cast(records.schema[f.name].dataType)
        changed = F.when(facet_text(f, c) == old, value).otherwise(c)
    records = records.withColumn(name.strip("`"), changed)
    if new is None:
        return records, dictionary.filter(~here)
    return records, dictionary.withColumn("value", F.when(here, F.lit(new)).otherwise(F.col("value")))
