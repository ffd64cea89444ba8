"""Changes to records, as new DataFrames: upsert, update, delete. Storing them is the snapshot table's part."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import QueryError, SchemaError
from ..functions.ranking import numbered
from ..functions.scalar import row_hash
from ..schema import Kind, Schema
from .predicates import coerce, literal

#: New rows get their numbers in buckets of this many on average.
BUCKET = 100_000


def _columns(rows: DataFrame, schema: Schema) -> list[Column]:
    have, out = {c.lower(): c for c in rows.columns}, []
    for f in schema.struct().fields:
        own = schema[f.name]
        c = F.col(f"`{have[f.name.lower()]}`").cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)
        if own.kind == Kind.STRING and own.length > 0:
            c = F.substring(c, 1, own.length)
        out.append((F.array_distinct(c) if own.kind == Kind.LIST else c).alias(f.name))
    return out


def conform(rows: DataFrame, schema: Schema) -> DataFrame:
    """rows with just the schema's columns and types; strings cut to their length, lists without repeats, fields that are missing NULL."""
    if not schema.parent and schema.key.name.lower() not in {c.lower() for c in rows.columns}:
        raise SchemaError(f"rows lack the key {schema.key.name}")
    return rows.select(*_columns(rows, schema))


def misfits(rows: DataFrame, schema: Schema) -> DataFrame:
    """(field, problem, n): values of rows that conform() would change or lose, fields that it would leave out, keys that are NULL."""
    have, checks = {c.lower(): c for c in rows.columns}, []
    for f in schema.struct().fields:
        name, own = have.get(f.name.lower()), schema[f.name]
        if name is None:
            if own.primary_key or not own.nullable:
                checks.append((f.name, "missing", F.lit(1)))
            continue
        c = F.col(f"`{name}`")
        if rows.schema[name].dataType != f.dataType:
            lost = F.expr(f"try_cast(`{name}` as {f.dataType.simpleString()})").isNull() & c.isNotNull()
            checks.append((f.name, f"not {own.kind.value}", F.sum(lost.cast("long"))))
        if own.primary_key or not own.nullable:
            checks.append((f.name, "null", F.sum(c.isNull().cast("long"))))
        if own.kind == Kind.STRING and own.length > 0:
            checks.append((f.name, "too long", F.sum((F.length(c.cast("string")) > own.length).cast("long"))))
    checks += [(name, "unknown", F.lit(1)) for low, name in have.items() if schema.find(low) is None]
    found = F.array(*[F.struct(F.lit(n).alias("field"), F.lit(p).alias("problem"), F.coalesce(F.max(x) if p in ("missing", "unknown") else x, F.lit(0)).cast("long").alias("n")) for n, p, x in checks])
    return rows.agg(found.alias("x")).select(F.inline("x")).filter("n > 0")


def hashed(rows: DataFrame, schema: Schema) -> DataFrame:
    return rows.withColumn("__hash", row_hash([F.col(f"`{f.name}`") for f in schema.fields]))


def upsert(old: DataFrame, batch: DataFrame, schema: Schema, now: int, ordinal: str | None = None) -> DataFrame:
    """old with the batch's rows, by key. Of rows with one key the last by `ordinal` counts (without one: any).

    A row whose content is unchanged only gets the time; another is replaced and keeps its record id; new ones get the next ids.
    """
    key = schema.key.name
    order = [F.col(f"`{ordinal}`").desc()] if ordinal else [F.lit(0).asc()]
    last = Window.partitionBy(F.col(f"`{key}`")).orderBy(*order)
    kept = batch.withColumn("__place", F.row_number().over(last)).filter("__place = 1")
    new = hashed(conform(kept, schema), schema)
    names = [f.name for f in schema.fields]
    ids = old.select(F.col(f"`{key}`").alias("__key"), "__record_idx")
    with_ids = new.join(ids, new[key] == ids["__key"], "left").drop("__key")
    top = old.agg(F.coalesce(F.max("__record_idx"), F.lit(-1)).alias("__top")).withColumn("__one", F.lit(1))  # one row
    added = with_ids.filter("__record_idx is null").drop("__record_idx")
    place = F.col(f"`{key}`")
    coarse = F.substring(place, 1, 4) if schema.key.kind == Kind.STRING else F.floor(place / BUCKET) if schema.key.kind in (Kind.INT, Kind.LONG, Kind.FLOAT) else place
    added = numbered(added, "__rank", place, coarse)
    added = added.withColumn("__one", F.lit(1)).join(F.broadcast(top), "__one").withColumn("__record_idx", F.col("__top") + 1 + F.col("__rank")).drop("__one", "__top", "__rank")
    changed = with_ids.filter("__record_idx is not null")
    columns = [*[F.col(f"`{n}`") for n in names], "__record_idx", F.lit(now).cast("int").alias("__timestamp"), "__hash"]
    untouched = old.join(new.select(F.col(f"`{key}`").alias("__key")), old[key] == F.col("__key"), "left_anti")
    return untouched.select(*[F.col(f"`{n}`") for n in names], "__record_idx", "__timestamp", "__hash").unionByName(changed.select(*columns)).unionByName(added.select(*columns))


def update(old: DataFrame, schema: Schema, where: Column, changes: dict[str, Any], now: int) -> DataFrame:
    """Fields set on the records where the predicate holds; they get hash 0 and the time."""
    if not changes:
        raise QueryError("nothing to change")
    hit, columns = F.coalesce(where, F.lit(False)), {}
    for name, value in changes.items():
        f = schema[name]
        if f.kind in (Kind.LIST, Kind.GEO) or f.primary_key:
            raise QueryError(f"{f.name}: can't be set")
        value = coerce(f.kind, value)
        if f.kind == Kind.STRING and value is not None and f.length > 0:
            value = value[: f.length]
        new = F.lit(None).cast(schema.struct()[f.name].dataType) if value is None else literal(f.kind, value)
        columns[f.name] = F.when(hit, new).otherwise(F.col(f"`{f.name}`"))
    columns |= {"__hash": F.when(hit, F.lit(0).cast("long")).otherwise(F.col("__hash")), "__timestamp": F.when(hit, F.lit(now).cast("int")).otherwise(F.col("__timestamp"))}
    return old.withColumns(columns)


def delete_where(old: DataFrame, where: Column) -> DataFrame:
    """Records where the predicate is false or NULL."""
    return old.filter(~F.coalesce(where, F.lit(False)))


def delete_keys(old: DataFrame, schema: Schema, keys: DataFrame) -> DataFrame:
    key = schema.key.name
    gone = keys.select(F.col(keys.columns[0]).alias("__gone")).distinct()
    return old.join(gone, old[key] == gone["__gone"], "left_anti")


def inherited(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The view of a child repository: the parent's records with the child's own fields."""
    own = [c for c in child.columns if c not in ("__timestamp", "__hash")]
    return parent.join(child.select(*own), "__record_idx", "inner")


def synced(parent: DataFrame, child: DataFrame) -> DataFrame:
    """The child's rows, one for each record of the parent: those missing are added empty, those without a parent go."""
    ids = parent.select("__record_idx")
    kept = child.join(ids, "__record_idx", "left_semi")
    missing = ids.join(child.select("__record_idx"), "__record_idx", "left_anti")
    return kept.unionByName(missing.select(*[F.col(c) if c == "__record_idx" else F.lit(None).cast(child.schema[c].dataType).alias(c) for c in child.columns]))


def reshaped(old: DataFrame, schema: Schema) -> DataFrame:
    """Records under an evolved schema: new fields NULL, dropped ones gone, strings cut anew."""
    system = [c for c in ("__record_idx", "__timestamp", "__hash") if c in old.columns]
    return old.select(*_columns(old, schema), *system)
