"""Filters as Column predicates: one for each kind of field and comparer.

All filters are joined by AND, those on one field too. Scalar comparisons drop NULL, `not equal` included; a list
that is `not equal` to some values keeps records without values. compat=True ignores filters on unknown fields and values
that can't be read, instead of raising an error.
"""

from __future__ import annotations

import re
from datetime import datetime
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import QueryError
from ..functions.scalar import METRES_A_MILE, miles
from ..query import NO_VALUES, Comparer, Filter, GeoFilter
from ..schema import SYSTEM, Field, Kind, Schema

C = Comparer
ORDERED = {C.LT: "__lt__", C.LE: "__le__", C.GT: "__gt__", C.GE: "__ge__", C.EQ: "__eq__", C.NE: "__ne__"}
SETS = (C.ANY, C.ALL, C.NONE)
#: Metres around a distance within which it is equal.
GEO_SLACK = 25


class Unreadable(QueryError):
    pass


def coerce(kind: Kind, value: Any) -> Any:
    """A value, or its text, as the field's kind."""
    if value is None:
        return None
    if isinstance(value, Enum):
        value = value.value
    try:
        if kind == Kind.BOOL:
            if isinstance(value, bool):
                return value
            return {"true": True, "1": True, "false": False, "0": False}[str(value).strip().lower()]
        if kind in (Kind.INT, Kind.LONG):
            n = int(value if isinstance(value, (int, float)) else str(value).strip())
            top = 2**31 if kind == Kind.INT else 2**63
            if not -top <= n < top:
                raise ValueError(n)
            return n
        if kind == Kind.FLOAT:
            return float(value)
        if kind == Kind.DATETIME:
            return value if isinstance(value, datetime) else datetime.strptime(str(value), "%Y-%m-%d %H:%M:%S")
        return str(value)
    except (ValueError, KeyError, TypeError) as e:
        raise Unreadable(f"{value!r} is no {kind.value}") from e


def literal(kind: Kind, value: Any) -> Column:
    if kind == Kind.DATETIME:
        return F.lit(value.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz")
    return F.lit(value).cast({Kind.INT: "int", Kind.LONG: "bigint", Kind.FLOAT: "double", Kind.BOOL: "boolean"}.get(kind, "string"))


def like(c: Column, value: str) -> Column:
    """A leading and a trailing * stand for anything; other * go. Without one the whole value has to match."""
    body = value.replace("*", "")
    pattern = "%" * value.startswith("*") + re.sub(r"([\\%_])", r"\\\1", body) + "%" * (value.endswith("*") and value != "*")
    return c.like(pattern)


def several(value: Any) -> list:
    if isinstance(value, (list, tuple, set, frozenset)):
        return list(value)
    return str(value).split("^")


def scalar(f: Field, c: Column, comparer: Comparer, value: Any) -> Column:
    if comparer in SETS:
        if f.kind in (Kind.FLOAT, Kind.DATETIME):
            raise QueryError(f"{f.name}: no {comparer.value} for this kind")
        values = several(value)
        if f.kind == Kind.STRING:
            parts = [c.contains(str(v).replace("*", "").replace("%", "")) for v in values]
        else:
            parts = [c == literal(f.kind, coerce(f.kind, v)) for v in values]
        if not parts:
            return F.lit(comparer != C.ANY)
        if comparer == C.NONE:
            return reduce(Column.__and__, [~p for p in parts])
        return reduce(Column.__or__ if comparer == C.ANY else Column.__and__, parts)
    if comparer == C.LIKE:
        if f.kind != Kind.STRING:
            raise QueryError(f"{f.name}: Like is for strings")
        return like(c, str(value))
    if f.kind == Kind.BOOL and comparer not in (C.EQ, C.NE):
        raise QueryError(f"{f.name}: a boolean has no order")
    value = coerce(f.kind, value)
    if value is None:
        if comparer not in (C.EQ, C.NE):
            raise QueryError(f"{f.name}: NULL has no order")
        return c.isNull() if comparer == C.EQ else c.isNotNull()
    return getattr(c, ORDERED[comparer])(literal(f.kind, value))


def listed(f: Field, c: Column, comparer: Comparer, value: Any) -> Column:
    empty = F.coalesce(F.size(c), F.lit(0)) == 0
    if comparer in (C.EQ, C.NE):
        if value is None or value == NO_VALUES:
            return empty if comparer == C.EQ else ~empty
        if isinstance(value, (list, tuple, set, frozenset)):
            found = F.coalesce(F.arrays_overlap(c, F.array(*[F.lit(str(v)) for v in value])), F.lit(False)) if value else F.lit(False)
        else:  # a single text is sought inside the elements, whatever their case
            found = F.coalesce(F.exists(c, lambda x: F.lower(x).contains(str(value).lower())), F.lit(False))
        return found if comparer == C.EQ else ~found
    if comparer == C.LIKE:
        pattern = re.sub(r"([\\%_])", r"\\\1", str(value)).replace("*", "%")
        return F.coalesce(F.exists(c, lambda x: x.like(pattern)), F.lit(False))
    raise QueryError(f"{f.name}: no {comparer.value} for a list")


def distance(c: Column, q: GeoFilter) -> Column:
    """Points within or outside of a distance; a box of degrees, which a scan can use, goes first for those within."""
    far = miles(c["lat"], c["lon"], q.lat, q.lon)
    slack = GEO_SLACK / METRES_A_MILE
    if q.comparer in (C.LT, C.LE, C.EQ):
        reach = q.miles + (slack if q.comparer == C.EQ else 0)
        within = (far <= reach) if q.comparer != C.EQ else ((far >= q.miles - slack) & (far <= reach))
        degrees = reach / 69.0 * 1.02 + 1e-6  # a degree of latitude is over 68.7 miles
        return (c["lat"] >= q.lat - degrees) & (c["lat"] <= q.lat + degrees) & within
    if q.comparer in (C.GT, C.GE):
        return far >= q.miles
    if q.comparer == C.NE:
        return (far < q.miles - slack) | (far > q.miles + slack)
    raise QueryError(f"{q.name}: no {q.comparer.value} for points")


def predicate(schema: Schema, q: Filter | GeoFilter, compat: bool = False, collation: str | None = None) -> Column | None:
    """The filter as a predicate; None if it is to be ignored."""
    try:
        if q.name.lower() in SYSTEM and not isinstance(q, GeoFilter):
            kind = Kind.LONG if q.name.lower() != "__timestamp" else Kind.INT
            return scalar(Field(q.name.lower(), kind), F.col(q.name.lower()), q.comparer, q.value)
        f = schema.find(q.name)
        if f is None:
            raise Unreadable(f"no field {q.name}")
        c = F.col(f"`{f.name}`")
        if isinstance(q, GeoFilter) != (f.kind == Kind.GEO):
            raise QueryError(f"{f.name}: points are filtered by distance, and only they")
        if isinstance(q, GeoFilter):
            return distance(c, q)
        if f.kind == Kind.LIST:
            return listed(f, c, q.comparer, q.value)
        if f.kind == Kind.STRING and collation:
            c = F.collate(c, collation)
        return scalar(f, c, q.comparer, q.value)
    except Unreadable:
        if compat:
            return None
        raise


def all_of(schema: Schema, filters, compat: bool = False, collation: str | None = None) -> Column:
    parts = [p for q in filters if (p := predicate(schema, q, compat, collation)) is not None]
    return reduce(Column.__and__, parts, F.lit(True))
