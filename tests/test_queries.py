"""Properties of URLs, facets, pages and schemas."""

from dataclasses import replace

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from facetwise import url
from facetwise.builder import lookup, m
from facetwise.errors import QueryError, SchemaError
from facetwise.plans import repositories as R
from facetwise.query import Comparer, Filter, GeoFilter, Query, Sort
from facetwise.schema import Field, Kind, Schema, dimension

name = st.text(st.characters(codec="utf-8", exclude_characters="\x00"), min_size=1, max_size=8)
ids = st.lists(st.integers(0, 10**9), max_size=4, unique=True).map(tuple)
filters = st.lists(st.builds(Filter, name, st.sampled_from(Comparer), name), max_size=3).map(tuple)
geo = st.builds(GeoFilter, name, st.sampled_from(Comparer), st.floats(-90, 90), st.floats(-180, 180), st.floats(0, 9999))


@settings(max_examples=150, deadline=None)
@given(st.builds(Query, filters=st.one_of(filters, geo.map(lambda g: (g,))), dimension_values=ids, keyword=st.one_of(st.just(""), name), users=ids, sorts=st.lists(st.builds(Sort, name, st.booleans()), max_size=3).map(tuple), fields=st.lists(name, max_size=3).map(tuple), groups=st.lists(name, max_size=3).map(tuple), skip_dimensions=ids, page=st.integers(1, 99), per_page=st.integers(0, 999), include_records=st.booleans(), include_all_dimensions=st.booleans(), exclude_count=st.booleans()))
def test_url_round_trip(query):
    assert url.parse(url.to_url(query)) == query


def test_url_keeps_extras_and_drops_nonsense():
    q = url.parse("https://host/path?ff=a,Equals|b,Nope,1|c,Equals,2&zz=7&po=x&d=3+1")
    assert q == Query(filters=(Filter("c", Comparer.EQ, "2"),), dimension_values=(3, 1), extras=(("zz", "7"),))


def test_builder_is_immutable_and_complete(spark, data):
    b = R.parts(spark, data).query()
    c = b.where(m("p_size") > 3).order_by("p_size").order_by("P_SIZE", True).then_by_descending("p_name").where_dimension_value(1, 2, 1).remove_dimension_value(2).skip_dimension(5, 5).note("k", "v")
    assert b.q == Query()
    assert c.q.sorts == (Sort("p_size"), Sort("p_name", True)) and c.q.dimension_values == (1,) and c.q.skip_dimensions == (5,) and c.q.extras == (("k", "v"),)
    assert c.clear_filters().clear_sorts().clear_dimensions().remove_non_parsed_field("k").q == Query(skip_dimensions=(5,))
    assert b.from_query(c.to_query()).q == c.q
    assert b.where((m("a") == 1) & (5 > m("b"))).q.filters == (Filter("a", Comparer.EQ, 1), Filter("b", Comparer.LT, 5))
    assert not b.records_only().q.include_dimensions and b.single_item().q.per_page == 1 and not b.dimensions_only().q.include_records
    with pytest.raises(TypeError):
        b.where(3)
    with pytest.raises(QueryError):
        b.where_dimension_value(*range(1001))


def test_facets_add_up(spark, data):
    r = R.orders(spark, data)
    n = r.query().count()
    sums = {x["dimension"]: x["n"] for x in r.query().note("masterresults", "1").facets().groupBy("dimension").agg({"count": "sum"}).withColumnRenamed("sum(count)", "n").collect()}
    missing = r.records.filter("o_orderstatus is null").count()
    assert sums["c_mktsegment"] == n and sums["o_orderstatus"] == n - missing
    for row in r.query().facets().filter("dimension in ('c_mktsegment', 'flags')").collect():
        assert r.query().where_dimension_value(row["dvidx"]).count() == row["count"]


def test_pages_join_to_the_whole(spark, data):
    b = R.parts(spark, data).query().order_by_descending("p_size").records_per_page(60)
    whole = [r["p_partkey"] for r in b.records_per_page(0).records().collect()]
    n = b.results().pages
    assert [r["p_partkey"] for p in range(1, n + 1) for r in b.page_offset(p).records().collect()] == whole


def test_fetch_gives_all_parts(spark, data):
    r = R.parts(spark, data)
    got = r.fetch(r.query().where(m("p_size") > 20).field_sum("p_retailprice", "s").include_all_dimensions().q)
    assert set(got) == {"records", "count", "facets", "derived", "all_facets"} and len(got["records"]) == 10
    assert r.fetch(r.query().where(m("p_size") > 20).field_sum("p_retailprice", "s").include_all_dimensions().q) is got
    row = got["facets"][0]
    assert lookup(r.query().all_dimensions(), dvidx=row["dvidx"]).first()["value"] == row["value"]


def test_aggregate_terminals(spark, data):
    b = R.parts(spark, data).query()
    assert b.min("p_size") <= b.max("p_size") and b.any() and b.count_distinct("p_partkey") == b.count()
    assert not b.where(m("p_size") < -5).any() and b.where(m("p_size") < -5).sum("p_size") == 0
    with pytest.raises(QueryError):
        b.sum("p_name")
    with pytest.raises(QueryError):
        b.group_by("words").groups()


def test_scan_is_pruned_and_filtered(spark, data):
    from pyspark.sql import functions as F

    plan = R.lines(spark, data).query().where(m("l_returnflag") == "R").results().filtered.agg(F.sum("l_quantity"))._jdf.queryExecution().toString()
    assert "EqualTo(l_returnflag,R)" in plan and "l_extendedprice" not in plan.split("ReadSchema")[1]


KEY = Field("id", Kind.INT, primary_key=True, nullable=False)


@pytest.mark.parametrize(
    "fields",
    [(), (Field("a", Kind.INT),), (KEY, Field("ID", Kind.INT)), (KEY, Field("t", Kind.LIST)), (KEY, dimension("x", Kind.FLOAT)), (KEY, dimension("x", Kind.STRING, numeric_break=5)), (KEY, dimension("x", Kind.INT, parent="x")), (KEY, dimension("x", Kind.INT, parent="gone")), (replace(KEY, indexed=False),), (KEY, Field("a", Kind.INT, data_grouping=True), Field("b", Kind.INT, data_grouping=True)), (KEY, Field("a b", Kind.INT), Field("a_b", Kind.INT))],
)
def test_bad_schemas(fields):
    with pytest.raises(SchemaError):
        Schema("s", fields)


def test_schema_round_trips():
    for s in (R.ORDERS, R.PARTS, R.CUSTOMERS):
        assert Schema.from_json(s.to_json()) == s and Schema.from_xml(s.to_xml()) == s
    assert R.PARTS.dimensions[0].didx == 1_000_000 and R.PARTS.first_value[1_000_001] == 20_000_000


def test_evolution():
    old = Schema("s", (KEY, Field("a", Kind.STRING, length=5), dimension("x", Kind.INT), dimension("y", Kind.STRING)))
    new = old.evolve(Schema("s", (KEY, Field("a", Kind.STRING, length=9), dimension("y", Kind.STRING), dimension("z", Kind.STRING))))
    assert new["y"].didx == old["y"].didx and new["z"].didx == old["y"].didx + 1
    with pytest.raises(SchemaError):
        old.evolve(Schema("s", (KEY, Field("a", Kind.INT))))
    child = Schema("c", (Field("more", Kind.INT),), parent="s", alias="c")
    assert [f.name for f in old.merge(child).fields] == ["id", "a", "x", "y", "more"] and child.subtract(old) == child.fields
