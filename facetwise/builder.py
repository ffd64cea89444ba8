"""The fluent way to a query. Builders are immutable: every method gives a new one."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from typing import TYPE_CHECKING, Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import url
from .query import Comparer, Derived, Filter, GeoFilter, Query, SliceQuery, Sort

_writer = ThreadPoolExecutor(1)

if TYPE_CHECKING:
    from .repository import CommitResult, Repository, Results


class Terms(tuple):
    """Filters joined by &; there is no other way to join them."""

    def __and__(self, other) -> Terms:
        return Terms((*self, *as_terms(other)))


def as_terms(x) -> Terms:
    if isinstance(x, Terms):
        return x
    if isinstance(x, (Filter, GeoFilter)):
        return Terms((x,))
    if isinstance(x, Member):  # a bare boolean
        return x == True  # noqa: E712
    raise TypeError("filters are comparisons joined by &")


class Member:
    """A field in an expression: m("price") < 5, 5 > m("price"), ~m("paid"), m("name").startswith("a")."""

    __hash__ = None

    def __init__(self, name: str):
        self.name = name

    def _is(self, comparer: Comparer, value: Any) -> Terms:
        return Terms((Filter(self.name, comparer, tuple(value) if isinstance(value, (list, set)) else value),))

    def __lt__(self, v):
        return self._is(Comparer.LT, v)

    def __le__(self, v):
        return self._is(Comparer.LE, v)

    def __gt__(self, v):
        return self._is(Comparer.GT, v)

    def __ge__(self, v):
        return self._is(Comparer.GE, v)

    def __eq__(self, v):
        return self._is(Comparer.EQ, v)

    def __ne__(self, v):
        return self._is(Comparer.NE, v)

    def __invert__(self):
        return self._is(Comparer.EQ, False)

    def __and__(self, other):
        return as_terms(self) & other

    def like(self, pattern: str):
        return self._is(Comparer.LIKE, pattern)

    def startswith(self, text: str):
        return self._is(Comparer.LIKE, text + "*")

    def endswith(self, text: str):
        return self._is(Comparer.LIKE, "*" + text)

    def contains(self, text: str):
        return self._is(Comparer.LIKE, f"*{text}*")

    def isin(self, values):
        return self._is(Comparer.ANY, tuple(values))

    def contains_any(self, *values):
        return self._is(Comparer.ANY, values)

    def contains_all(self, *values):
        return self._is(Comparer.ALL, values)

    def contains_none(self, *values):
        return self._is(Comparer.NONE, values)

    def within(self, miles: float, lat: float, lon: float):
        return Terms((GeoFilter(self.name, Comparer.LE, lat, lon, miles),))

    def beyond(self, miles: float, lat: float, lon: float):
        return Terms((GeoFilter(self.name, Comparer.GE, lat, lon, miles),))

    def at_distance(self, miles: float, lat: float, lon: float):
        return Terms((GeoFilter(self.name, Comparer.EQ, lat, lon, miles),))

    def not_at_distance(self, miles: float, lat: float, lon: float):
        return Terms((GeoFilter(self.name, Comparer.NE, lat, lon, miles),))


def m(name: str) -> Member:
    return Member(name)


def _merged(old: Query, new: Query) -> Query:
    """A URL's or another query's parts taken over: lists are added, other values that it sets replace."""
    default, changes = Query(), {}
    for name in vars(default):
        mine, theirs = getattr(old, name), getattr(new, name)
        if theirs != getattr(default, name):
            changes[name] = tuple(dict.fromkeys([*mine, *theirs])) if isinstance(mine, tuple) else theirs
    return old.with_(**changes)


class _Base:
    def __init__(self, repository: Repository, query: Query | None = None):
        self.repository, self.q = repository, query or Query()

    def _with(self, **changes):
        out = object.__new__(type(self))
        out.__dict__ = self.__dict__ | {"q": self.q.with_(**changes)}
        return out

    def where(self, *terms) -> _Base:
        return self._with(filters=(*self.q.filters, *(f for t in terms for f in as_terms(t))))

    add_field_filter = where

    def remove_field_filter(self, name: str):
        return self._with(filters=tuple(f for f in self.q.filters if f.name.lower() != name.lower()))

    def clear_filters(self):
        return self._with(filters=())

    def where_url(self, text: str):
        return self._with(**vars(_merged(self.q, url.parse(text))))

    def from_query(self, query: Query):
        return self._with(**vars(_merged(self.q, query)))

    def note(self, name: str, value: str):
        """An extra that travels with the query."""
        return self._with(extras=(*((k, v) for k, v in self.q.extras if k != name), (name, value)))

    add_non_parsed_field = note

    def remove_non_parsed_field(self, name: str):
        return self._with(extras=tuple((k, v) for k, v in self.q.extras if k != name))

    def include_ip_address(self, address: str):
        return self.note("ip", address)

    def to_query(self) -> Query:
        return self.q

    def to_url(self) -> str:
        return url.to_url(self.q)


class _Paged(_Base):
    def records_per_page(self, n: int):
        return self._with(per_page=n)

    def page_offset(self, n: int):
        return self._with(page=n)

    def where_user(self, *users: int):
        return self._with(users=tuple(dict.fromkeys([*self.q.users, *users])))

    def where_dimension_value(self, *ids: int):
        return self._with(dimension_values=tuple(dict.fromkeys([*self.q.dimension_values, *ids])))

    def remove_dimension_value(self, *ids: int):
        return self._with(dimension_values=tuple(i for i in self.q.dimension_values if i not in ids))

    def clear_dimensions(self):
        return self._with(dimension_values=())

    def order_by(self, name: str, descending: bool = False):
        return self if any(s.name.lower() == name.lower() for s in self.q.sorts) else self._with(sorts=(*self.q.sorts, Sort(name, descending)))

    then_by = order_by

    def order_by_descending(self, name: str):
        return self.order_by(name, True)

    then_by_descending = order_by_descending

    def remove_sort(self, name: str):
        return self._with(sorts=tuple(s for s in self.q.sorts if s.name.lower() != name.lower()))

    def clear_sorts(self):
        return self._with(sorts=())

    def group_by(self, *names: str):
        return self._with(groups=(*self.q.groups, *names))


class Builder(_Paged):
    def where_keyword(self, text: str):
        return self._with(keyword=text)

    def select(self, *names: str):
        return self._with(fields=(*self.q.fields, *names))

    def skip_dimension(self, *didx: int):
        return self._with(skip_dimensions=tuple(dict.fromkeys([*self.q.skip_dimensions, *didx])))

    def include_records(self, on: bool = True):
        return self._with(include_records=on)

    def include_dimensions(self, on: bool = True):
        return self._with(include_dimensions=on)

    def include_all_dimensions(self, on: bool = True):
        return self._with(include_all_dimensions=on)

    def include_empty_dimensions(self, on: bool = True):
        return self._with(include_empty_dimensions=on)

    def exclude_count(self, on: bool = True):
        return self._with(exclude_count=on)

    def exclude_dimension_count(self, on: bool = True):
        return self._with(exclude_dimension_count=on)

    def dimensions_only(self):
        return self._with(include_records=False, include_dimensions=True, exclude_count=True)

    def records_only(self):
        return self._with(include_dimensions=False, include_all_dimensions=False, exclude_count=True)

    def single_item(self):
        return self.records_only()._with(page=1, per_page=1)

    def _derive(self, action: str, name: str = "*", alias: str = ""):
        return self._with(derived=(*self.q.derived, Derived(action, name, alias)))

    def field_sum(self, name: str, alias: str = ""):
        return self._derive("sum", name, alias)

    def field_min(self, name: str, alias: str = ""):
        return self._derive("min", name, alias)

    def field_max(self, name: str, alias: str = ""):
        return self._derive("max", name, alias)

    def field_count(self, name: str = "*", alias: str = ""):
        return self._derive("count", name, alias)

    def field_count_distinct(self, name: str, alias: str = ""):
        return self._derive("count_distinct", name, alias)

    # what a query gives

    def results(self) -> Results:
        return self.repository.results(self.q)

    def records(self) -> DataFrame:
        return self.results().records

    def computed(self, **columns) -> DataFrame:
        """The page with columns computed by the engine from expressions."""
        return self.results().records.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])

    def everything(self) -> DataFrame:
        return self.results().all_records

    def items(self, size: int = 1000):
        """All filtered records in order, lists of so many at a time."""
        from .sources.export import items

        return items(self._with(per_page=0).results().records, size)

    def facets(self) -> DataFrame:
        return self.results().facets

    def all_dimensions(self) -> DataFrame:
        return self.results().all_facets

    def groups(self) -> DataFrame:
        return self.results().records

    def aggregate(self) -> DataFrame:
        return self.results().derived

    def count(self) -> int:
        return self.results().count.first()[0]

    def any(self) -> bool:
        return bool(self.results().filtered.take(1))

    def _one(self, action: str, name: str):
        return self.results().repository.results(self.q.with_(derived=(Derived(action, name, "x"),))).derived.first()["x"]

    def min(self, name: str):
        return self._one("min", name)

    def max(self, name: str):
        return self._one("max", name)

    def sum(self, name: str):
        return self._one("sum", name)

    def count_distinct(self, name: str):
        return self._one("count_distinct", name)

    def results_async(self, path: str, kind: str = "parquet"):
        """All filtered records in order, written on a thread."""
        from .sources.export import export_async

        return export_async(self._with(per_page=0).results().records, path, kind)


class Slice(_Paged):
    dimension = ""

    def group_field(self, *names: str):
        return self.group_by(*names)

    def slice_dimension(self, name: str):
        out = self._with()
        out.dimension = name
        return out

    def to_slice(self) -> DataFrame:
        return self.repository.cross_tab(SliceQuery(self.q, self.dimension))


class Change(_Base):
    def __init__(self, repository: Repository, kind: str):
        super().__init__(repository)
        self.kind, self.changes = kind, {}

    def field(self, name: str, value: Any) -> Change:
        out = self._with()
        out.changes = self.changes | {name: value}
        return out

    def commit(self) -> CommitResult:
        if self.kind == "delete":
            return self.repository.delete_where(self.q)
        return self.repository.update_where(self.q, self.changes)

    def commit_async(self):
        """commit() on a thread; the handle gives its result. Changes made so follow one another."""
        return _writer.submit(self.commit)


def lookup(facets: DataFrame, dvidx: int | None = None, value: str | None = None, dimension: str | None = None, min_value: int | None = None) -> DataFrame:
    """Facet rows by id, value, dimension or the lower end of their bucket."""
    for name, x in (("dvidx", dvidx), ("value", value), ("dimension", dimension), ("min_value", min_value)):
        if x is not None:
            facets = facets.filter(F.col(name) == x)
    return facets


__all__ = ["Builder", "Change", "Member", "Slice", "lookup", "m"]
