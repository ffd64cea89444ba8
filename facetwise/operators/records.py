"""Projection, order and pages of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..query import Sort
from ..schema import SYSTEM, Kind, Schema

NO_LIMIT = 2**31 - 1


def order(schema: Schema, sorts: tuple[Sort, ...], tie: str = "__record_idx") -> list[Column]:
    """Sort columns, the record id last. NULL is least. Unknown and unsortable fields and repeats are left out."""
    out, seen = [], set()
    for s in sorts:
        f = schema.find(s.name)
        name = f.name if f and f.sortable else s.name.lower() if s.name.lower() in SYSTEM else None
        if name and name not in seen:
            seen.add(name)
            c = F.col(f"`{name}`")
            out.append(c.desc_nulls_last() if s.descending else c.asc_nulls_first())
    return out if tie in seen else [*out, F.col(tie).asc()]


def project(records: DataFrame, schema: Schema, fields: tuple[str, ...], system: bool = True) -> DataFrame:
    """The fields asked for with the key, or all; lists never NULL."""
    chosen = [schema[n] for n in fields] or list(schema.fields)
    if fields and (key := next((f for f in schema.fields if f.primary_key), None)) is not None and key not in chosen:
        chosen.insert(0, key)
    columns = [F.coalesce(F.col(f"`{f.name}`"), F.array().cast("array<string>")).alias(f.name) if f.kind == Kind.LIST else F.col(f"`{f.name}`") for f in dict.fromkeys(chosen)]
    return records.select(*columns, *[n for n in SYSTEM if system and n in records.columns])


def page(records: DataFrame, columns: list[Column], number: int, size: int) -> DataFrame:
    """One page in order: a top-k, not a sort of everything; size <= 0: all."""
    rows = records.orderBy(*columns)
    if size <= 0 or size >= NO_LIMIT:
        return rows
    skip = (max(1, number) - 1) * size
    return rows.limit(size) if not skip else rows.offset(skip).limit(size)
