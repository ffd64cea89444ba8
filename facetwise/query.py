"""The logical query: plain frozen data that the builder and the URL reader make and the repository runs."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import Enum
from typing import Any

from .errors import QueryError


class Comparer(str, Enum):
    LT = "LessThan"
    GT = "GreaterThan"
    LE = "LessThanOrEq"
    GE = "GreaterThanOrEq"
    EQ = "Equals"
    LIKE = "Like"
    NE = "NotEqual"
    ANY = "ContainsAny"
    ALL = "ContainsAll"
    NONE = "ContainsNone"


#: The value that asks a list for having no elements.
NO_VALUES = "{null}"


@dataclass(frozen=True)
class Filter:
    name: str
    comparer: Comparer
    value: Any = None


@dataclass(frozen=True)
class GeoFilter:
    """Distance from a point, in miles."""

    name: str
    comparer: Comparer
    lat: float
    lon: float
    miles: float


@dataclass(frozen=True)
class Sort:
    name: str
    descending: bool = False


@dataclass(frozen=True)
class Derived:
    """An aggregate: sum, min, max, count or count_distinct of a field (count of "*": of records)."""

    action: str
    name: str = "*"
    alias: str = ""

    ACTIONS = ("sum", "min", "max", "count", "count_distinct")

    def __post_init__(self):
        if self.action not in self.ACTIONS:
            raise QueryError(f"no aggregate {self.action}")
        if not self.alias:
            object.__setattr__(self, "alias", self.action if self.name == "*" else f"{self.action}_{self.name}")


@dataclass(frozen=True)
class Query:
    filters: tuple[Filter | GeoFilter, ...] = ()
    dimension_values: tuple[int, ...] = ()
    keyword: str = ""
    users: tuple[int, ...] = ()
    sorts: tuple[Sort, ...] = ()
    fields: tuple[str, ...] = ()
    groups: tuple[str, ...] = ()
    derived: tuple[Derived, ...] = ()
    skip_dimensions: tuple[int, ...] = ()
    page: int = 1
    per_page: int = 10
    include_records: bool = True
    include_dimensions: bool = True
    include_all_dimensions: bool = False
    include_empty_dimensions: bool = False
    exclude_count: bool = False
    exclude_dimension_count: bool = False
    extras: tuple[tuple[str, str], ...] = ()

    MOST_VALUES = 1000

    def __post_init__(self):
        if len(self.dimension_values) > self.MOST_VALUES:
            raise QueryError(f"at most {self.MOST_VALUES} dimension values")
        if sum(isinstance(f, GeoFilter) for f in self.filters) > 1:
            raise QueryError("at most one filter by distance")

    def with_(self, **changes) -> Query:
        return replace(self, **changes)

    def unfiltered(self) -> Query:
        return replace(self, filters=(), dimension_values=(), keyword="")


@dataclass(frozen=True)
class SliceQuery:
    """A cross-tab: groups down, a dimension's values across."""

    query: Query = field(default_factory=Query)
    dimension: str = ""
