"""Counts, aggregates, groups and cross-tabs of the filtered records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.scalar import facet_text
from ..query import Derived
from ..schema import Kind, Schema


def measure(schema: Schema, d: Derived, grouped: bool = False) -> Column:
    """Sum and count of nothing are 0, least and greatest NULL; a list has no measures but 0 in a group."""
    if d.name == "*":
        if d.action != "count":
            raise QueryError(f"{d.action} is of a field")
        return F.count(F.lit(1)).alias(d.alias)
    f = schema[d.name]
    if f.kind in (Kind.LIST, Kind.GEO):
        if grouped:
            return F.max(F.lit(0)).alias(d.alias)
        raise QueryError(f"{f.name}: no {d.action} for this kind")
    c = F.col(f"`{f.name}`")
    if d.action == "sum":
        if f.kind not in (Kind.INT, Kind.LONG, Kind.FLOAT):
            raise QueryError(f"{f.name}: no sum for this kind")
        out = F.sum(c if f.kind == Kind.FLOAT else c.cast("long"))
        return F.coalesce(out, F.lit(0).cast("double" if f.kind == Kind.FLOAT else "long")).alias(d.alias)
    if d.action == "count_distinct":
        if grouped:
            raise QueryError("groups have no distinct counts")
        return F.count_distinct(c).alias(d.alias)
    return {"min": F.min, "max": F.max, "count": F.count}[d.action](c).alias(d.alias)


def totals(records: DataFrame, schema: Schema, derived: tuple[Derived, ...], compat: bool = False) -> DataFrame:
    """One row with all aggregates, in one pass. compat: leaves out those of unknown fields."""
    some = [d for d in derived if not compat or d.name == "*" or schema.find(d.name)]
    return records.agg(*[measure(schema, d) for d in some])


def grouped(records: DataFrame, schema: Schema, keys: tuple[str, ...], derived: tuple[Derived, ...]) -> DataFrame:
    """A row for each combination of keys, NULL among them, ordered by the keys."""
    fields = [schema[k] for k in keys]
    if not fields or any(not f.sortable for f in fields):
        raise QueryError("groups are by scalar fields")
    names = [f"`{f.name}`" for f in fields]
    return records.groupBy(*names).agg(*[measure(schema, d, True) for d in derived or (Derived("count"),)]).orderBy(*names)


def cross_tab(records: DataFrame, schema: Schema, keys: tuple[str, ...], across: str, values: list[str]) -> DataFrame:
    """Rows by keys, a column with the count for each value of a scalar dimension; NULL keys count too."""
    fields, d = [schema.find(k) for k in keys], schema.find(across)
    if not fields or any(f is None or not f.sortable for f in fields):
        raise QueryError("no group field, or one that can't group")
    if d is None or not d.dimension or d.kind == Kind.LIST:
        raise QueryError("a cross-tab is over a scalar dimension")
    names = [f"`{f.name}`" for f in fields]
    rows = records.withColumn("__across", facet_text(d, F.col(f"`{d.name}`")))
    return rows.groupBy(*names).pivot("__across", values).agg(F.count(F.lit(1))).na.fill(0, [v for v in values]) if values else rows.select(*names).distinct()


def cross_counts(records: DataFrame, schema: Schema, keys: tuple[str, ...], across: str) -> DataFrame:
    """(keys, value, count) of the values that records have, in order."""
    fields, d = [schema.find(k) for k in keys], schema.find(across)
    if not fields or any(f is None or not f.sortable for f in fields):
        raise QueryError("no group field, or one that can't group")
    if d is None or not d.dimension or d.kind == Kind.LIST:
        raise QueryError("a cross-tab is over a scalar dimension")
    names = [f"`{f.name}`" for f in fields]
    rows = records.select(*names, facet_text(d, F.col(f"`{d.name}`")).alias("value")).filter("value is not null")
    return rows.groupBy(*names, "value").agg(F.count(F.lit(1)).alias("count")).orderBy(*names, "value")


def last_timestamp(records: DataFrame) -> DataFrame:
    return records.agg(F.coalesce(F.max("__timestamp"), F.lit(0)).alias("last_timestamp"))
