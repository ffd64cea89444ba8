"""A repository: typed records with facets, and what a query over them gives."""

from __future__ import annotations

import time
from collections import OrderedDict, deque
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .builder import Builder, Change, Slice
from .errors import QueryError
from .functions.scalar import facet_text, seconds_since_epoch
from .operators import aggregate, dictionary, dml, facets, keyword, predicates, records, security
from .query import Query, SliceQuery
from .schema import Kind, Schema
from .sources.storage import SnapshotTable


@dataclass
class CommitResult:
    success: bool
    count: int = 0
    version: int | None = None
    errors: tuple[str, ...] = ()


class Results:
    """What a query gives, each part a DataFrame that is computed when asked for, all from one filtered set."""

    def __init__(self, repository: Repository, query: Query):
        self.repository, self.query = repository, query

    @cached_property
    def chosen(self) -> list[tuple[int, int, str]]:
        """The query's dimension values that are known: (didx, dvidx, value)."""
        ids = list(self.query.dimension_values)
        if not ids:
            return []
        rows = self.repository.dictionary.filter(F.col("dvidx").isin(ids)).collect()  # at most Query.MOST_VALUES
        return sorted((r["didx"], r["dvidx"], r["value"]) for r in rows)

    @cached_property
    def filtered(self) -> DataFrame:
        return self.repository.filtered(self.query, self.chosen)

    @property
    def records(self) -> DataFrame:
        """A page of records, or of groups."""
        q, schema = self.query, self.repository.schema
        if q.groups:
            rows = self.groups
            return rows if q.per_page <= 0 else rows.offset((max(1, q.page) - 1) * q.per_page).limit(q.per_page)
        order = records.order(schema, q.sorts)
        return records.project(records.page(self.filtered, order, q.page, q.per_page), schema, q.fields)

    @property
    def all_records(self) -> DataFrame:
        """Every filtered record, unpaged and in no order."""
        return records.project(self.filtered, self.repository.schema, self.query.fields)

    def ordinals(self) -> DataFrame:
        """The page with __ordinal_position, the place among all filtered records."""
        from pyspark.sql import Window

        q = self.query
        order = records.order(self.repository.schema, q.sorts)
        page = records.page(self.filtered, order, q.page, q.per_page)
        if not 0 < q.per_page < records.NO_LIMIT:
            raise QueryError("places are given by page")
        place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) - 1 + (max(1, q.page) - 1) * q.per_page  # of one page
        rows = page.withColumn("__ordinal_position", place.cast("long"))
        return records.project(rows, self.repository.schema, q.fields).join(rows.select("__record_idx", "__ordinal_position"), "__record_idx")

    @property
    def groups(self) -> DataFrame:
        return aggregate.grouped(self.filtered, self.repository.schema, self.query.groups, self.query.derived)

    @property
    def count(self) -> DataFrame:
        """total_count of records, or of groups."""
        rows = self.filtered
        if self.query.groups:
            rows = rows.select(*[f"`{self.repository.schema[g].name}`" for g in self.query.groups]).distinct()
        return rows.agg(F.count(F.lit(1)).alias("total_count"))

    @property
    def derived(self) -> DataFrame:
        return aggregate.totals(self.filtered, self.repository.schema, self.query.derived, self.repository.compat)

    @property
    def applied(self) -> DataFrame:
        """The chosen values with their counts among the filtered records."""
        didx = {d for d, _, _ in self.chosen}
        dims = [f for f in self.repository.schema.dimensions if f.didx in didx]
        found = facets.counts(self.filtered, self.repository.dictionary, dims, include_empty=True)
        return found.filter(F.col("dvidx").isin([v for _, v, _ in self.chosen]))

    @property
    def facets(self) -> DataFrame:
        """Facets of the filtered records, without the chosen values.

        A scalar dimension that a value of is chosen isn't counted, unless all or empty ones are asked for. A dimension is
        hidden while its parent has several values, unless the extra `masterresults` is set.
        """
        q, schema = self.query, self.repository.schema
        chosen = {d for d, _, _ in self.chosen}
        keep_all = q.include_all_dimensions or q.include_empty_dimensions
        dims = [f for f in schema.dimensions if f.didx not in q.skip_dimensions and (keep_all or f.kind == Kind.LIST or f.didx not in chosen)]
        found = facets.counts(self.filtered, self.repository.dictionary, dims, q.include_empty_dimensions)
        if self.chosen:
            found = found.filter(F.col("dvidx").isNull() | ~F.col("dvidx").isin([v for _, v, _ in self.chosen]))
        return found if "masterresults" in dict(q.extras) else facets.hierarchy(found, schema)

    @property
    def all_facets(self) -> DataFrame:
        """Facets of the whole repository."""
        r = self.repository
        return facets.counts(r.records, r.dictionary, [f for f in r.schema.dimensions if f.didx not in self.query.skip_dimensions])

    def fetch(self) -> dict[str, list]:
        """All parts that the query asks for, computed side by side over the filtered set held once."""
        q = self.query
        wanted = {"records": q.include_records, "count": not q.exclude_count, "facets": q.include_dimensions and not q.exclude_dimension_count, "derived": bool(q.derived) and not q.groups, "applied": bool(self.chosen), "all_facets": q.include_all_dimensions}
        names = [n for n, w in wanted.items() if w]
        held = len(names) > 1
        if held:
            self.filtered.persist()
        try:
            with ThreadPoolExecutor(max(1, len(names))) as pool:
                return dict(zip(names, pool.map(lambda n: getattr(self, n).collect(), names)))
        finally:
            if held:
                self.filtered.unpersist()

    @property
    def pages(self) -> int:
        total = self.count.first()[0]
        return -(-total // self.query.per_page) if self.query.per_page > 0 else 1


class Repository:
    """Records of a schema with their dictionary and grants; over a table it can be changed.

    compat: filters on unknown fields or with unreadable values are ignored. collation: of string comparisons, e.g. UTF8_LCASE.
    """

    #: Results that fetch() keeps, entries of its log, columns of a cross-tab.
    CACHED, LOGGED, COLUMNS = 64, 1000, 10_000

    def __init__(self, schema: Schema, rows: DataFrame | None = None, dictionary_: DataFrame | None = None, grants: DataFrame | None = None, table: SnapshotTable | None = None, compat: bool = False, collation: str | None = None):
        self.schema, self.table, self.compat, self.collation = schema, table, compat, collation
        self._rows, self._dictionary, self._grants = rows, dictionary_, grants
        self._cache: OrderedDict = OrderedDict()
        self.log: deque = deque(maxlen=self.LOGGED)  # what fetch() was asked, and how long it took

    @staticmethod
    def open(table: SnapshotTable, **options) -> Repository:
        return Repository(table.schema, table=table, **options)

    @property
    def records(self) -> DataFrame:
        return self.table.read() if self.table else self._rows

    @property
    def dictionary(self) -> DataFrame:
        if self.table:
            return self.table.read("dictionary")
        if self._dictionary is None:
            # held, as facets, chosen values and cross-tabs all look it up; a lost part is computed again
            self._dictionary = dictionary.grow(self._rows, self.schema).persist()
        return self._dictionary

    @property
    def grants(self) -> DataFrame | None:
        return self.table.read("grants") if self.table else self._grants

    # queries

    def query(self) -> Builder:
        return Builder(self)

    def slice(self) -> Slice:
        return Slice(self)

    def results(self, query: Query) -> Results:
        return Results(self, query)

    def fetch(self, query: Query) -> dict[str, list]:
        """results(query).fetch(), kept for the query while the table has the same version."""
        at, began = (query, self.table.version if self.table else None), time.time()
        cached = at in self._cache
        if not cached:
            self._cache[at] = self.results(query).fetch()
            while len(self._cache) > self.CACHED:
                self._cache.popitem(last=False)
        self._cache.move_to_end(at)
        self.log.append({"query": query, "seconds": time.time() - began, "cached": cached, "count": next((r["total_count"] for r in self._cache[at].get("count", ())), None)})
        return self._cache[at]

    def filtered(self, query: Query, chosen: list[tuple[int, int, str]] | None = None) -> DataFrame:
        """The records that a query is about. Values of one dimension are joined by OR, all else by AND."""
        chosen = Results(self, query).chosen if chosen is None else chosen
        rows = self.records.filter(predicates.all_of(self.schema, query.filters, self.compat, self.collation))
        by_dimension: dict[int, list[str]] = {}
        for didx, _, value in chosen:
            by_dimension.setdefault(didx, []).append(value)
        for f in self.schema.dimensions:
            values = by_dimension.get(f.didx)
            if not values or len(values) > 2 and self._covers(f.didx, len(values)):
                continue
            c = F.col(f"`{f.name}`")
            if f.kind == Kind.LIST:
                rows = rows.filter(F.coalesce(F.arrays_overlap(c, F.array(*map(F.lit, values))), F.lit(False)))
            else:
                rows = rows.filter(facet_text(f, c).isin(values))
        if query.keyword and (words := keyword.predicate(self.schema, query.keyword)) is not None:
            rows = rows.filter(words)
        return security.visible(rows, self.schema, self.grants, query.users)

    def _covers(self, didx: int, n: int) -> bool:
        """Whether n values are all that a dimension has: then they select nothing, and records without a value pass too."""
        return self.dictionary.filter(F.col("didx") == didx).limit(n + 1).count() <= n

    def cross_tab(self, q: SliceQuery) -> DataFrame:
        f = self.schema.find(q.dimension)
        values = [] if f is None or f.kind == Kind.LIST else [r["value"] for r in self.dictionary.filter(F.col("didx") == f.didx).orderBy("value").limit(self.COLUMNS + 1).collect()]
        if len(values) > self.COLUMNS:
            raise QueryError(f"{q.dimension} has over {self.COLUMNS} values; cross_counts() gives them as rows")
        rows = aggregate.cross_tab(self.filtered(q.query), self.schema, q.query.groups, q.dimension, values)
        keys = [self.schema[g].name for g in q.query.groups]
        order = []
        for s in q.query.sorts:
            name = next((k for k in [*keys, *values] if k.lower() == s.name.lower()), None)
            if name is None:
                raise QueryError(f"no column {s.name}")
            order.append(F.col(f"`{name}`").desc_nulls_last() if s.descending else F.col(f"`{name}`").asc_nulls_first())
        rows = rows.orderBy(*order, *[F.col(f"`{k}`") for k in keys])
        return rows if q.query.per_page <= 0 else rows.offset((max(1, q.query.page) - 1) * q.query.per_page).limit(q.query.per_page)

    def cross_counts(self, q: SliceQuery) -> DataFrame:
        """The cross-tab in its long form, for dimensions with any number of values: keys, value, count; no rows for counts of 0."""
        return aggregate.cross_counts(self.filtered(q.query), self.schema, q.query.groups, q.dimension)

    def last_timestamp(self, query: Query | None = None) -> DataFrame:
        return aggregate.last_timestamp(self.filtered(query or Query()))

    def dimension_dump(self) -> DataFrame:
        return dictionary.dump(self.dictionary)

    # changes; each is a new version of the table

    def _write(self, rows: DataFrame, words: DataFrame | None = None, expected: str | None = None, count: int = 0) -> CommitResult:
        if self.table is None:
            self._rows, self._dictionary = rows, words if words is not None else self._dictionary
            return CommitResult(True, count)
        return CommitResult(True, count, self.table.write(self.schema, rows, words, expected=expected))

    def upsert(self, batch: DataFrame, ordinal: str | None = None, now: int | None = None, expected: str | None = None) -> CommitResult:
        """Insert or replace by key; values that are new get their facet ids first."""
        now = seconds_since_epoch() if now is None else now
        words = dictionary.grow(dml.conform(batch, self.schema), self.schema, self.dictionary)
        return self._write(dml.upsert(self.records, batch, self.schema, now, ordinal), words, expected)

    def upsert_items(self, items: list, now: int | None = None, expected: str | None = None) -> CommitResult:
        """upsert() of Python objects or dicts; later ones win. Texts are read as the field's kind, names that the schema lacks left out."""
        rows, struct = [], self.schema.struct()
        for place, item in enumerate(items):
            own = {k.lower(): v for k, v in (item if isinstance(item, dict) else {**vars(item), **getattr(item, "extra_values", {})}).items()}
            row = []
            for f in self.schema.fields:
                value = own.get(f.name.lower())
                if f.kind == Kind.LIST:
                    value = None if value is None else [str(x) for x in value]
                elif f.kind == Kind.GEO:
                    value = None if value is None else tuple(map(float, value))
                else:
                    value = predicates.coerce(f.kind, value)
                row.append(value)
            rows.append((*row, place))
        spark = self.records.sparkSession
        return self.upsert(spark.createDataFrame(rows, T.StructType([*struct.fields, T.StructField("__place_in_batch", T.IntegerType())])), "__place_in_batch", now, expected)

    def update(self) -> Change:
        return Change(self, "update")

    def delete(self) -> Change:
        return Change(self, "delete")

    def update_where(self, query: Query, changes: dict[str, Any], now: int | None = None) -> CommitResult:
        if not changes:
            return CommitResult(False, errors=("no fields",))
        now = seconds_since_epoch() if now is None else now
        where = predicates.all_of(self.schema, query.filters, self.compat, self.collation)
        hit = self.records.filter(F.coalesce(where, F.lit(False))).count()
        rows = dml.update(self.records, self.schema, where, changes, now)
        words = dictionary.grow(rows, self.schema, self.dictionary)
        return self._write(rows, words, count=hit)

    def delete_where(self, query: Query) -> CommitResult:
        where = predicates.all_of(self.schema, query.filters, self.compat, self.collation)
        hit = self.records.filter(F.coalesce(where, F.lit(False))).count()
        return self._write(dml.delete_where(self.records, where), count=hit)

    def delete_keys(self, keys: DataFrame) -> CommitResult:
        return self._write(dml.delete_keys(self.records, self.schema, keys))

    def clear(self) -> CommitResult:
        """No records and no grants; the dictionary stays."""
        if self.table:
            return CommitResult(True, version=self.table.write(self.schema, self.records.limit(0), None, self.grants.limit(0)))
        return self._write(self.records.limit(0))

    def rename_value(self, dvidx: int, new: str | None) -> bool:
        """Another name for a facet value, in the records too; None deletes it. False if there is no such value or the name is empty."""
        row = self.dictionary.filter(F.col("dvidx") == dvidx).first()
        f = next((f for f in self.schema.dimensions if row and f.didx == row["didx"]), None)
        if f is None or new == "":
            return False
        rows, words = dictionary.rename(self.records, self.dictionary, f, dvidx, row["value"], new)
        return self._write(rows, words).success

    def alter(self, new: Schema) -> CommitResult:
        """The schema changed; values of dimensions that went go from the dictionary."""
        old, self.schema = self.schema, self.schema.evolve(new)
        kept = [f.didx for f in self.schema.dimensions]
        words = self.dictionary.filter(F.col("didx").isin(kept))
        rows = dml.reshaped(self.records, self.schema)
        if {f.didx for f in self.schema.dimensions} - {f.didx for f in old.dimensions}:
            words = dictionary.grow(rows, self.schema, words)
        return self._write(rows, words)

    def validate(self, batch: DataFrame) -> DataFrame:
        """(field, problem, n): what is wrong with a batch before it is upserted; no rows: nothing."""
        return dml.misfits(batch, self.schema)

    def _grant(self, grants: DataFrame) -> None:
        if self.table:
            self.table.write(self.schema, grants=grants)
        else:
            self._grants = grants

    def grant(self, rows: list[tuple], reset: bool = False) -> None:
        """Let users see values: (user_id, value) rows. reset: whoever saw these values before no longer does."""
        self._grant(security.grant(self.grants, rows, reset))

    def revoke(self, rows: list[tuple]) -> None:
        self._grant(security.revoke(self.grants, rows))

    def clear_grants(self, user: int | None = None, value=None) -> None:
        self._grant(security.clear(self.grants, user, value))
