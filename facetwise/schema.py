"""Typed schemas of repositories: fields, facet dimensions, validation, evolution, JSON and XML."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass, field, replace
from enum import Enum
from xml.etree import ElementTree

from pyspark.sql import types as T

from .errors import SchemaError

#: Facet ids: the first dimension's, and how many value ids each dimension has; a child repository's own dimensions have smaller ones.
FIRST_DIMENSION, VALUES_EACH = 1_000_000, 10_000_000
CHILD_FIRST_DIMENSION, CHILD_VALUES_EACH = 1, 10_000
SYSTEM = {"__record_idx": T.LongType(), "__timestamp": T.IntegerType(), "__hash": T.LongType()}


class Kind(str, Enum):
    STRING = "string"
    INT = "int"
    LONG = "long"
    FLOAT = "float"
    BOOL = "bool"
    DATETIME = "datetime"
    GEO = "geo"
    LIST = "list"


GEO_TYPE = T.StructType([T.StructField("lat", T.DoubleType()), T.StructField("lon", T.DoubleType())])
SPARK_TYPES = {Kind.STRING: T.StringType(), Kind.INT: T.IntegerType(), Kind.LONG: T.LongType(), Kind.FLOAT: T.DoubleType(), Kind.BOOL: T.BooleanType(), Kind.DATETIME: T.TimestampNTZType(), Kind.GEO: GEO_TYPE, Kind.LIST: T.ArrayType(T.StringType())}


@dataclass(frozen=True)
class Field:
    """length: of a string, longer values are cut on write; 0: no limit."""

    name: str
    kind: Kind
    primary_key: bool = False
    nullable: bool = True
    length: int = 100
    text_search: bool = False
    indexed: bool = True
    data_grouping: bool = False
    dimension: bool = False
    didx: int = 0
    parent: str = ""
    numeric_break: int = 0

    @property
    def sortable(self) -> bool:
        return self.kind not in (Kind.LIST, Kind.GEO)


def dimension(name: str, kind: Kind, parent: str = "", numeric_break: int = 0, **more) -> Field:
    return Field(name, kind, dimension=True, parent=parent, numeric_break=numeric_break, **more)


def clean_name(name: str) -> str:
    """Characters that a name can't have become underscores."""
    return re.sub(r"[^A-Za-z0-9_]", "_", name)


@dataclass(frozen=True)
class Schema:
    """permission_field: the field that row-level grants speak of. parent: of an inherited repository."""

    name: str
    fields: tuple[Field, ...]
    permission_field: str = ""
    parent: str = ""
    alias: str = ""

    def __post_init__(self):
        first = CHILD_FIRST_DIMENSION if self.parent else FIRST_DIMENSION
        known, numbered = max([first - 1, *(f.didx for f in self.fields if f.dimension)]), []
        for f in self.fields:
            if f.dimension and not f.didx:
                known += 1
                f = replace(f, didx=known)
            numbered.append(f)
        object.__setattr__(self, "fields", tuple(numbered))
        self.validate()

    def validate(self) -> None:
        names = [f.name.lower() for f in self.fields]
        if not names:
            raise SchemaError("a schema has at least one field")
        if len(set(names)) < len(names):
            raise SchemaError("field names differ by more than case")
        if len({clean_name(n) for n in names}) < len(names):
            raise SchemaError("field names clash once they are cleaned")
        keys = [f for f in self.fields if f.primary_key]
        if len(keys) != 1 and not self.parent:
            raise SchemaError("a schema has exactly one primary key")
        if any(f.primary_key and (f.dimension or f.kind in (Kind.LIST, Kind.GEO)) for f in self.fields):
            raise SchemaError("a primary key is a plain scalar field")
        if any(not k.indexed for k in keys):
            raise SchemaError("the primary key is indexed")
        if sum(f.data_grouping for f in self.fields) > 1:
            raise SchemaError("at most one field groups the data")
        for f in self.fields:
            if f.kind == Kind.LIST and not f.dimension:
                raise SchemaError(f"{f.name}: a list is a dimension")
            if f.dimension and f.kind in (Kind.FLOAT, Kind.GEO):
                raise SchemaError(f"{f.name}: no dimension of this kind")
            if f.numeric_break and (f.kind not in (Kind.INT, Kind.LONG) or f.numeric_break < 0 or not f.dimension):
                raise SchemaError(f"{f.name}: breaks are positive and for integer dimensions")
            if f.parent and (f.parent.lower() not in names or f.parent.lower() == f.name.lower() or not self[f.parent].dimension):
                raise SchemaError(f"{f.name}: its parent is another dimension")
        if self.permission_field and self[self.permission_field].kind not in (Kind.INT, Kind.LONG, Kind.STRING):
            raise SchemaError("the permission field is an integer or a string")
        if self.parent and not self.alias:
            raise SchemaError("a child repository has an alias")

    def find(self, name: str) -> Field | None:
        return next((f for f in self.fields if f.name.lower() == str(name).lower()), None)

    def __getitem__(self, name: str) -> Field:
        if (f := self.find(name)) is None:
            raise SchemaError(f"no field {name}")
        return f

    @property
    def key(self) -> Field:
        return next(f for f in self.fields if f.primary_key)

    @property
    def dimensions(self) -> list[Field]:
        return [f for f in self.fields if f.dimension]

    @property
    def first_value(self) -> dict[int, int]:
        """Of each dimension, the first id for its values."""
        if self.parent:
            return {f.didx: f.didx * CHILD_VALUES_EACH for f in self.dimensions}
        return {f.didx: (f.didx - FIRST_DIMENSION + 1) * VALUES_EACH for f in self.dimensions}

    def struct(self, system: bool = False) -> T.StructType:
        own = [T.StructField(f.name, SPARK_TYPES[f.kind], f.nullable and not f.primary_key, {"facet": _plain(f)}) for f in self.fields]
        return T.StructType(own + [T.StructField(n, t) for n, t in SYSTEM.items()] * system)

    def version_hash(self) -> str:
        return hashlib.sha256(json.dumps([_plain(f) for f in self.fields], sort_keys=True).encode()).hexdigest()[:16]

    def evolve(self, new: Schema) -> Schema:
        """The schema after a change to `new`, with the ids of dimensions that stay.

        Fields may come and go, strings change their length, text search be switched, and a field become a dimension or
        the other way round with the same kind; any other change is refused as a whole.
        """
        ids = {f.name.lower(): f.didx for f in self.dimensions}
        top, fields = max([*ids.values(), FIRST_DIMENSION - 1]), []
        for f in new.fields:
            old = self.find(f.name)
            if old and (old.kind != f.kind or old.primary_key != f.primary_key or old.numeric_break != f.numeric_break and old.dimension and f.dimension):
                raise SchemaError(f"{f.name}: can't become {f.kind.value}" + (" and the key" if f.primary_key else ""))
            if old and old.dimension != f.dimension and old.length != f.length:
                raise SchemaError(f"{f.name}: changes its length and whether it is a dimension")
            if f.dimension:
                if f.name.lower() not in ids:
                    top += 1
                f = replace(f, didx=ids.get(f.name.lower(), top))
            fields.append(f)
        return replace(new, fields=tuple(fields))

    def merge(self, child: Schema) -> Schema:
        """Parent's fields, then the child's own."""
        own = tuple(f for f in child.fields if self.find(f.name) is None)
        return Schema(child.name, self.fields + own, self.permission_field)

    def subtract(self, parent: Schema) -> tuple[Field, ...]:
        return tuple(f for f in self.fields if parent.find(f.name) is None)

    def to_json(self) -> str:
        return json.dumps({"name": self.name, "permission_field": self.permission_field, "parent": self.parent, "alias": self.alias, "fields": [_plain(f) for f in self.fields]})

    @staticmethod
    def from_json(text: str) -> Schema:
        d = json.loads(text)
        return Schema(d["name"], tuple(Field(**{**f, "kind": Kind(f["kind"])}) for f in d["fields"]), d["permission_field"], d["parent"], d["alias"])

    def to_xml(self) -> str:
        root = ElementTree.Element("schema", name=self.name, permission_field=self.permission_field, parent=self.parent, alias=self.alias)
        for f in self.fields:
            ElementTree.SubElement(root, "field", {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in _plain(f).items()})
        return ElementTree.tostring(root, encoding="unicode")

    @staticmethod
    def from_xml(text: str) -> Schema:
        root = ElementTree.fromstring(text)
        fields = []
        for x in root.iter("field"):
            d = dict(x.attrib)
            d |= {k: d[k] == "true" for k in ("primary_key", "nullable", "text_search", "indexed", "data_grouping", "dimension") if k in d}
            d |= {k: int(d[k]) for k in ("length", "didx", "numeric_break") if k in d}
            fields.append(Field(**{**d, "kind": Kind(d["kind"])}))
        return Schema(root.get("name"), tuple(fields), root.get("permission_field", ""), root.get("parent", ""), root.get("alias", ""))


def _plain(f: Field) -> dict:
    return {k: v.value if isinstance(v, Kind) else v for k, v in vars(f).items()}
