"""The registered queries of the navigation engine and their SQL: name -> (query, SQL).

Each runs over its whole tables; limits are those of pages. SQL names its records `rec`.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from ..builder import m
from ..functions.scalar import STOP_WORDS, word_blob
from ..operators import dictionary, dml
from ..query import Comparer, Filter, GeoFilter, SliceQuery
from ..schema import Field, Kind, Schema, dimension
from ..sources import export
from . import repositories as R

SQL = {"orders": R.ORDERS_SQL, "events": R.EVENTS_SQL, "parts": R.PARTS_SQL, "documents": R.DOCUMENTS_SQL, "customers": R.CUSTOMERS_SQL, "lines": R.LINES_SQL}
SHOWN = {"orders": ("o_orderkey", "o_custkey", "o_totalprice"), "events": ("event_id", "user_id"), "parts": ("p_partkey", "p_name"), "documents": ("doc_id", "lang", "quality"), "customers": ("c_custkey", "c_name"), "lines": ("l_orderkey", "l_quantity")}
FACETS = ["dimension", "value", "count", "min_value", "max_value"]
BASE = datetime(2000, 1, 1)

#: name -> (repository, filters, the same in SQL)
FILTERS = {
    "filter_int_eq": ("orders", m("c_nationkey") == 7, "c_nationkey = 7"),
    "filter_int_ne": ("orders", m("c_nationkey") != 7, "c_nationkey <> 7"),
    "filter_int_lt": ("orders", m("c_nationkey") < 7, "c_nationkey < 7"),
    "filter_int_le": ("orders", m("c_nationkey") <= 7, "c_nationkey <= 7"),
    "filter_int_gt": ("orders", m("c_nationkey") > 7, "c_nationkey > 7"),
    "filter_int_ge": ("orders", m("c_nationkey") >= 7, "c_nationkey >= 7"),
    "filter_long_eq": ("orders", m("o_custkey") == 70, "o_custkey = 70"),
    "filter_long_ne": ("orders", m("o_custkey") != 70, "o_custkey <> 70"),
    "filter_long_lt": ("orders", m("o_custkey") < 70, "o_custkey < 70"),
    "filter_long_le": ("orders", m("o_custkey") <= 70, "o_custkey <= 70"),
    "filter_long_gt": ("orders", m("o_custkey") > 70, "o_custkey > 70"),
    "filter_long_ge": ("orders", m("o_custkey") >= 70, "o_custkey >= 70"),
    "filter_float_eq": ("lines", m("l_quantity") == 10.0, "l_quantity = 10.0"),
    "filter_float_ne": ("orders", m("c_acctbal") != 0.0, "c_acctbal <> 0.0"),
    "filter_float_lt": ("orders", m("o_totalprice") < 20000.5, "o_totalprice < 20000.5"),
    "filter_float_le": ("orders", m("o_totalprice") <= 20000.5, "o_totalprice <= 20000.5"),
    "filter_float_gt": ("orders", m("o_totalprice") > "250000", "o_totalprice > 250000"),
    "filter_float_ge": ("orders", m("o_totalprice") >= "250000", "o_totalprice >= 250000"),
    "filter_string_eq": ("orders", m("c_mktsegment") == "BUILDING", "c_mktsegment = 'BUILDING'"),
    "filter_string_ne": ("orders", m("o_orderstatus") != "F", "o_orderstatus <> 'F'"),
    "filter_string_lt": ("orders", m("n_name") < "NATION_2", "n_name < 'NATION_2'"),
    "filter_string_le": ("orders", m("c_mktsegment") <= "BUILDING", "c_mktsegment <= 'BUILDING'"),
    "filter_string_gt": ("orders", m("c_mktsegment") > "BUILDING", "c_mktsegment > 'BUILDING'"),
    "filter_string_ge": ("orders", m("c_mktsegment") >= "BUILDING", "c_mktsegment >= 'BUILDING'"),
    "filter_datetime_eq": ("orders", m("o_orderdate") == "1996-01-02 00:00:00", "o_orderdate = timestamp '1996-01-02 00:00:00'"),
    "filter_datetime_ne": ("orders", m("o_orderdate") != "1996-01-02 00:00:00", "o_orderdate <> timestamp '1996-01-02 00:00:00'"),
    "filter_datetime_lt": ("orders", m("o_orderdate") < datetime(1995, 3, 15), "o_orderdate < timestamp '1995-03-15 00:00:00'"),
    "filter_datetime_le": ("orders", m("o_orderdate") <= datetime(1995, 3, 15), "o_orderdate <= timestamp '1995-03-15 00:00:00'"),
    "filter_datetime_gt": ("orders", m("o_orderdate") > datetime(1995, 3, 15), "o_orderdate > timestamp '1995-03-15 00:00:00'"),
    "filter_datetime_ge": ("orders", m("o_orderdate") >= datetime(1995, 3, 15), "o_orderdate >= timestamp '1995-03-15 00:00:00'"),
    "filter_bool_eq": ("orders", m("urgent") == "1", "urgent"),
    "filter_bool_ne": ("orders", m("urgent") != True, "urgent <> true"),  # noqa: E712
    "filter_bool_bare": ("orders", m("urgent") & (m("c_nationkey") < 3), "urgent and c_nationkey < 3"),
    "filter_bool_not": ("orders", ~m("urgent"), "not urgent"),
    "filter_null_eq": ("documents", m("quality") == None, "quality is null"),  # noqa: E711
    "filter_null_ne": ("documents", m("quality") != None, "quality is not null"),  # noqa: E711
    "filter_null_dropped_by_ne": ("documents", m("quality") != 1, "quality <> 1"),
    "filter_int_contains_any": ("orders", m("c_nationkey").contains_any(1, 5, 9), "c_nationkey in (1, 5, 9)"),
    "filter_int_contains_all": ("orders", m("c_nationkey").contains_all(5, 5), "c_nationkey = 5 and c_nationkey = 5"),
    "filter_int_contains_none": ("orders", m("c_nationkey").contains_none(1, 5, 9), "c_nationkey not in (1, 5, 9)"),
    "filter_long_contains_any": ("orders", m("o_custkey").isin([10, 20, 30]), "o_custkey in (10, 20, 30)"),
    "filter_long_contains_all": ("orders", Filter("o_custkey", Comparer.ALL, "10^20"), "o_custkey = 10 and o_custkey = 20"),
    "filter_long_contains_none": ("orders", Filter("o_custkey", Comparer.NONE, "10^20"), "o_custkey <> 10 and o_custkey <> 20"),
    "filter_bool_contains_any": ("orders", m("urgent").contains_any("true", "false"), "urgent or not urgent"),
    "filter_bool_contains_all": ("orders", m("urgent").contains_all("true", "1"), "urgent"),
    "filter_bool_contains_none": ("orders", m("urgent").contains_none("true"), "not urgent"),
    "filter_string_contains_any": ("parts", Filter("p_name", Comparer.ANY, "*an*^ed"), "p_name like '%an%' or p_name like '%ed%'"),
    "filter_string_contains_all": ("parts", m("p_name").contains_all("a", "e"), "p_name like '%a%' and p_name like '%e%'"),
    "filter_string_contains_none": ("parts", m("p_name").contains_none("a", "x"), "p_name not like '%a%' and p_name not like '%x%'"),
    "filter_string_like_prefix": ("parts", m("p_name").startswith("b"), "p_name like 'b%'"),
    "filter_string_like_suffix": ("parts", m("p_name").endswith("e"), "p_name like '%e'"),
    "filter_string_like_both": ("parts", m("p_name").contains("re"), "p_name like '%re%'"),
    "filter_string_like_exact": ("orders", m("c_mktsegment").like("BUIL*DING"), "c_mktsegment = 'BUILDING'"),
    "filter_list_eq": ("orders", m("flags") == ["A", "R"], "list_has_any(flags, ['A', 'R'])"),
    "filter_list_ne": ("orders", m("flags") != ["A"], "not coalesce(list_has_any(flags, ['A']), false)"),
    "filter_list_null": ("orders", m("flags") == "{null}", "coalesce(len(flags), 0) = 0"),
    "filter_list_notnull": ("orders", m("flags") != None, "coalesce(len(flags), 0) > 0"),  # noqa: E711
    "filter_list_substring": ("parts", m("words") == "RE", "len(list_filter(words, lambda x: lower(x) like '%re%')) > 0"),
    "filter_list_like": ("parts", m("words").like("b*"), "len(list_filter(words, lambda x: x like 'b%')) > 0"),
    "filter_same_field_and": ("orders", (m("c_nationkey") > 3) & (m("c_nationkey") < 6), "c_nationkey > 3 and c_nationkey < 6"),
    "filter_same_field_empty": ("orders", (m("c_nationkey") == 3) & (m("c_nationkey") == 6), "c_nationkey = 3 and c_nationkey = 6"),
    "filter_reversed_operand": ("orders", 20 < m("c_nationkey"), "c_nationkey > 20"),
    "filter_system_timestamp": ("orders", m("__timestamp") >= 900, "__timestamp >= 900"),
    "geo_within": ("customers", m("place").within(1500, 40.0, -75.0), "miles <= 1500"),
    "geo_outside": ("customers", m("place").beyond(6000, 40.0, -75.0), "miles >= 6000"),
    "geo_equals": ("customers", GeoFilter("place", Comparer.EQ, 40.0, -75.0, 5548.782), "abs(miles - 5548.782) <= 25 / 1609.344"),  # as far as the customer with key 7
    "geo_not_equal": ("customers", GeoFilter("place", Comparer.NE, 40.0, -75.0, 2000), "abs(miles - 2000) > 25 / 1609.344"),
}


def filtered(repo: str, terms):
    return lambda spark, d: getattr(R, repo)(spark, d).query().where(terms).select(*SHOWN[repo]).everything().select(*SHOWN[repo])


def chosen(r, *values):
    """Ids of (dimension, value) pairs."""
    rows = r.dictionary.collect()  # of the few dimensions here
    return [x["dvidx"] for name, value in values for x in rows if x["didx"] == r.schema[name].didx and x["value"] == value]


def with_values(values, repo="orders"):
    def run(spark, d):
        r = getattr(R, repo)(spark, d)
        return r.query().where_dimension_value(*chosen(r, *values)).everything().select(*SHOWN[repo])

    return run


def facet_sql(repo: str, where: str = "true", normal=(), lists=(), breaks=(), having: str = "") -> str:
    """Counts by UNION ALL, a statement for each dimension."""
    parts = [f"select '{n}' as dimension, cast({n} as varchar) as value, count(*) as count, cast(null as bigint) as min_value, cast(null as bigint) as max_value from rec where ({where}) and {n} is not null group by {n}" for n in normal]
    parts += [f"select '{n}' as dimension, x as value, count(*) as count, cast(null as bigint) as min_value, cast(null as bigint) as max_value from (select unnest({n}) as x from rec where {where}) group by x" for n in lists]
    parts += [f"select '{n}' as dimension, cast(({n} // {s}) * {s} as varchar) as value, count(*) as count, cast(({n} // {s}) * {s} as bigint) as min_value, cast(({n} // {s}) * {s} + {s} as bigint) as max_value from rec where ({where}) and {n} is not null group by {n} // {s}" for n, s in breaks]
    return f"with {SQL[repo]} select * from ({' union all '.join(parts)}) {having}"


NORMAL = ("o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", "n_name", "o_year")
ALL = {"normal": NORMAL, "lists": ("flags",), "breaks": (("price_band", 50000),)}


def facet_rows(build, repo="orders"):
    return lambda spark, d: build(getattr(R, repo)(spark, d)).select(*FACETS)


def _applied(r):
    return r.query().where_dimension_value(*chosen(r, ("c_mktsegment", "BUILDING"), ("c_mktsegment", "MACHINERY"))).results().applied


def _empty(r):
    return r.query().where(m("c_nationkey") == 3).include_empty_dimensions().note("masterresults", "1").facets()


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 2) for n in names})


def page(build):
    return lambda spark, d: build(R.orders(spark, d).query()).records().select("o_orderkey", "c_mktsegment", "o_orderstatus", "o_totalprice")


def page_sql(order: str, limit: str = "", where: str = "true") -> str:
    return f"with {R.ORDERS_SQL} select o_orderkey, c_mktsegment, o_orderstatus, o_totalprice from rec where {where} order by {order} {limit}"


def ordinal(spark, d):
    return R.orders(spark, d).query().order_by_descending("o_totalprice").records_per_page(20).page_offset(2).results().ordinals().select("o_orderkey", "__ordinal_position")


# state after changes: the records as they would be written


KV = Schema("kv", (Field("id", Kind.LONG, primary_key=True, nullable=False), Field("name", Kind.STRING, length=12), Field("price", Kind.FLOAT)))
#: Keys from here on are of no part; divisible by eight.
NEW_KEYS = 8_000_000_000_000
SEEN = ["id", "name", "price", "__record_idx", "__timestamp"]


def _kv(spark, d):
    rows = R.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.substring("p_name", 1, 12).alias("name"), F.col("p_retailprice").alias("price"))
    rows = rows.withColumns({"__record_idx": F.col("id"), "__timestamp": F.lit(100)})
    return dml.hashed(rows, KV)


KV_SQL = "kv as (select p_partkey as id, substr(p_name, 1, 12) as name, p_retailprice as price, p_partkey as __record_idx, 100 as __timestamp from part)"


def upsert_state(spark, d):
    """Each part comes twice: first as another, then as it is; a third of them under keys that are new."""
    key = F.col("p_partkey") + F.when(F.col("p_partkey") % 3 == 0, NEW_KEYS).otherwise(0)
    part = R.read(spark, d, "part").select(key.alias("id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    later = part.withColumn("price", F.when(F.col("id") % 8 == 0, F.col("price") + 1).otherwise(F.col("price"))).withColumn("o", F.lit(2))
    batch = part.withColumn("name", F.lit("first")).withColumn("o", F.lit(1)).unionByName(later)
    return dml.upsert(_kv(spark, d), batch, KV, 200, "o").select(*SEEN)


UPSERT_SQL = f"""
with {KV_SQL}, batch as (select p_partkey + (case when p_partkey % 3 = 0 then {NEW_KEYS} else 0 end) as id, substr(p_name, 1, 12) as name, p_retailprice + (case when p_partkey % 8 = 0 then 1 else 0 end) as price from part),
added as (select b.*, (select max(__record_idx) from kv) + row_number() over (order by id) as idx from batch b where id not in (select id from kv))
select id, name, price, __record_idx, __timestamp from kv where id not in (select id from batch)
union all select b.id, b.name, b.price, kv.__record_idx, 200 from batch b join kv on kv.id = b.id
union all select id, name, price, idx, 200 from added"""


def update_where_state(spark, d):
    r = R.Repository(KV, _kv(spark, d))
    r.update().where(m("price") < 1000).field("name", "cheap and far too long").field("price", "1").commit()
    return r.records.withColumn("__timestamp", F.col("__timestamp") > 100).withColumnRenamed("__timestamp", "changed").select("id", "name", "price", "changed")


def delete_pk_state(spark, d):
    keys = spark.range(0, 500).select(F.col("id"))
    return dml.delete_keys(_kv(spark, d), KV, keys).select(*SEEN)


def delete_where_state(spark, d):
    """Unknown quality isn't 0, so it stays."""
    r = R.documents(spark, d)
    r.delete().where(m("quality") == 0).commit()
    return r.records.select("doc_id", "quality")


def rename_state(spark, d, new="CONSTRUCTION"):
    r = R.orders(spark, d)
    r.rename_value(chosen(r, ("c_mktsegment", "BUILDING"))[0], new)
    return r.results(r.query().q).facets.filter("dimension = 'c_mktsegment'").select("value", "count")


def rename_list_state(spark, d):
    r = R.orders(spark, d)
    r.rename_value(chosen(r, ("flags", "A"))[0], None)
    return r.query().facets().filter("dimension = 'flags'").select("value", "count")


def inherited_view(spark, d):
    """Customers with orders are a child of customers: their own field is what they spent."""
    parent = R.customers(spark, d).records.select("c_custkey", "c_mktsegment", "__record_idx", "__timestamp", "__hash")
    spent = R.read(spark, d, "orders").groupBy(F.col("o_custkey").alias("__record_idx")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    return dml.inherited(parent, dml.synced(parent, spent)).select("c_custkey", "c_mktsegment", "spent")


def combined_dictionary(spark, d):
    """A child's own values and its parent's."""
    child = Schema("child", (Field("note", Kind.STRING), dimension("o_year", Kind.INT)), parent="orders", alias="c")
    own = dictionary.grow(R.orders(spark, d).records.select("o_year"), child)
    return dictionary.combined(R.parts(spark, d).dictionary.filter("didx = 1000000"), own).select("didx", "dvidx", "value")


def child_sync(spark, d):
    """One row for each order: notes of orders that are gone go, missing ones come empty."""
    parent = R.orders(spark, d).records.filter("o_orderkey % 3 <> 0")
    notes = R.orders(spark, d).records.filter("o_orderkey % 2 = 0").select("__record_idx", F.col("n_name").alias("note"))
    return dml.synced(parent, notes)


def granted(spark, d):
    r = R.orders(spark, d)
    r.grant([(3, "0"), (11, "24")], reset=True)
    r.revoke([(3, "8")])
    r.clear_grants(user=4)
    return r.grants.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


GRANTED_SQL = """
with g as (select u.user_id, n from range(1, 11) u(user_id), range(0, 25) v(n) where n % 5 = user_id % 5),
kept as (select user_id, n from g where n not in (0, 24) union select * from (values (3, 0), (11, 24)) t(user_id, n))
select cast(user_id as int) as user_id, count(*) as n from kept where not (user_id = 3 and n = 8) and user_id <> 4 group by user_id"""


def misfit_rows(spark, d):
    """Names over 12 characters, and a field that the schema doesn't have."""
    return R.Repository(KV, _kv(spark, d)).validate(R.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", F.lit("!!!")).alias("name"), F.col("p_size").alias("more")))


def _fresh(spark, name: str) -> str:
    """A path in the folder that driver and executors share; one of our own only where all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set")
        root = "file://" + tempfile.mkdtemp(prefix="facetwise-")
    return f"{root.rstrip('/')}/{name}-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def exported(spark, d):
    """Written as compressed JSON and read back."""
    rows = R.read(spark, d, "events").select("event_id", "event_type", "value")
    path = _fresh(spark, "events")
    export.export(rows, path, "json")
    return export.read(spark, path, rows.schema, "json")


def altered(spark, d):
    """A field goes, another comes."""
    r = R.Repository(KV, _kv(spark, d))
    r.alter(Schema("kv", (*KV.fields[:2], Field("note", Kind.STRING))))
    return r.records.select("id", "name", "note", "__record_idx")


def cleared(spark, d):
    """A table that is cleared: no records and no grants, but its facet names."""
    from ..repository import Repository
    from ..sources.storage import SnapshotTable

    r = Repository.open(SnapshotTable(spark, _fresh(spark, "cleared"), R.PARTS))
    r.upsert(R.parts(spark, d).records, now=1)
    r.grant([(1, "x")])
    r.clear()
    left = r.records.select(F.lit("records").alias("part"), F.lit("").alias("value")).unionByName(r.grants.select(F.lit("grants").alias("part"), F.col("fk_field").alias("value")))
    return left.unionByName(r.dictionary.filter("didx = 1000000").select(F.lit("names").alias("part"), "value"))


def upsert_table(spark, d):
    """Through a snapshot table: created, filled twice, read back as facets."""
    from ..repository import Repository
    from ..sources.storage import SnapshotTable

    table = SnapshotTable(spark, _fresh(spark, "parts"), R.PARTS)
    rows = R.parts(spark, d).records
    r = Repository.open(table)
    r.upsert(rows.filter("p_partkey % 2 = 0"), now=1)
    r.upsert(rows, now=2)
    return r.query().facets().select(*FACETS)


def registered() -> dict[str, tuple]:
    out = {n: (filtered(repo, t), f"with {SQL[repo]} select {', '.join(SHOWN[repo])} from rec where {w}") for n, (repo, t, w) in FILTERS.items()}
    o, rec = R.ORDERS_SQL, f"with {R.ORDERS_SQL} select o_orderkey, o_custkey, o_totalprice from rec where "
    q = lambda build: lambda spark, d: build(R.orders(spark, d).query())
    out |= {
        "scan_all": (q(lambda b: b.everything().select("o_orderkey", "o_custkey", "c_mktsegment", "n_name", F.array_join(F.sort_array("flags"), ",").alias("flags"), "__timestamp")), f"with {o} select o_orderkey, o_custkey, c_mktsegment, n_name, array_to_string(list_sort(coalesce(flags, [])), ',') as flags, __timestamp from rec"),
        "field_select": (q(lambda b: b.select("n_name", "c_acctbal").everything().select("o_orderkey", "n_name", "c_acctbal")), f"with {o} select o_orderkey, n_name, c_acctbal from rec"),
        "computed_projection": (q(lambda b: b.records_per_page(0).computed(o_orderkey="o_orderkey", cents="cast(round(o_totalprice * 100) as bigint)", label="concat(n_name, '/', c_mktsegment)")), f"with {o} select o_orderkey, cast(round(o_totalprice * 100) as bigint) as cents, concat(n_name, '/', c_mktsegment) as label from rec"),
        "ignored_unknown_field": (lambda spark, d: R.orders(spark, d, compat=True).query().where((m("nothing") == 1) & (m("c_nationkey") == "x") & (m("c_nationkey") < 2)).everything().select(*SHOWN["orders"]), rec + "c_nationkey < 2"),
        "collated_equals": (lambda spark, d: R.orders(spark, d, collation="UTF8_LCASE").query().where(m("c_mktsegment") == "building").everything().select(*SHOWN["orders"]), rec + "lower(c_mktsegment) = 'building'"),
        "dim_filter_single": (with_values([("c_mktsegment", "BUILDING")]), rec + "c_mktsegment = 'BUILDING'"),
        "dim_filter_multi": (with_values([("c_mktsegment", "BUILDING"), ("c_mktsegment", "MACHINERY")]), rec + "c_mktsegment in ('BUILDING', 'MACHINERY')"),
        "dim_filter_cross": (with_values([("c_mktsegment", "BUILDING"), ("o_orderstatus", "F"), ("price_band", "100000")]), rec + "c_mktsegment = 'BUILDING' and o_orderstatus = 'F' and price_band // 50000 = 2"),
        "dim_filter_list": (with_values([("flags", "A"), ("flags", "R")]), rec + "list_has_any(flags, ['A', 'R'])"),
        "dim_filter_all_elided": (with_values([("flags", "A"), ("flags", "N"), ("flags", "R")]), rec + "true"),
        "facet_normal": (facet_rows(lambda r: r.query().note("masterresults", "1").facets().filter(F.col("dimension").isin(*NORMAL))), facet_sql("orders", normal=NORMAL)),
        "facet_list": (facet_rows(lambda r: r.query().facets().filter("dimension = 'flags'")), facet_sql("orders", lists=("flags",))),
        "facet_numeric_break": (facet_rows(lambda r: r.query().facets().filter("dimension in ('quantity', 'l_returnflag')"), "lines"), facet_sql("lines", normal=("l_returnflag",), breaks=(("quantity", 10),))),
        "facet_filtered": (facet_rows(lambda r: r.query().where((m("o_totalprice") > 100000) & (m("o_orderdate") >= datetime(1996, 1, 1))).note("masterresults", "1").facets()), facet_sql("orders", "o_totalprice > 100000 and o_orderdate >= timestamp '1996-01-01'", **ALL)),
        "facet_selected_left_out": (facet_rows(lambda r: r.query().where_dimension_value(*chosen(r, ("c_mktsegment", "BUILDING"), ("flags", "A"))).note("masterresults", "1").facets()), facet_sql("orders", "c_mktsegment = 'BUILDING' and list_has_any(flags, ['A'])", tuple(n for n in NORMAL if n != "c_mktsegment"), ("flags",), ALL["breaks"], "where not (dimension = 'flags' and value = 'A')")),
        "facet_skip": (facet_rows(lambda r: r.query().skip_dimension(*[r.schema[n].didx for n in ("flags", "n_name", "o_year")]).facets()), facet_sql("orders", "true", ("o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name"), (), ALL["breaks"])),
        "facet_empty_included": (facet_rows(_empty), f"with {o}, every as ({facet_sql('orders', 'true', **ALL).partition(o)[2]}), here as ({facet_sql('orders', 'c_nationkey = 3', **ALL).partition(o)[2]}) select dimension, value, coalesce(here.count, 0) as count, every.min_value, every.max_value from every left join here using (dimension, value)"),
        "facet_all_dimensions": (facet_rows(lambda r: r.query().where(m("c_nationkey") == 3).all_dimensions()), facet_sql("orders", "true", **ALL)),
        "facet_applied": (facet_rows(_applied), facet_sql("orders", "c_mktsegment in ('BUILDING', 'MACHINERY')", ("c_mktsegment",))),
        "facet_hierarchy": (facet_rows(lambda r: r.query().facets()), facet_sql("orders", "true", tuple(n for n in NORMAL if n != "n_name"), ("flags",), ALL["breaks"])),
        "facet_hierarchy_open": (facet_rows(lambda r: r.query().where(m("r_name") == "ASIA").facets()), facet_sql("orders", "r_name = 'ASIA'", **ALL)),
        "facet_events": (facet_rows(lambda r: r.query().facets(), "events"), facet_sql("events", normal=("event_type",), breaks=(("value_band", 50),))),
        "facet_words": (facet_rows(lambda r: r.query().where(m("p_retailprice") > 950).facets().filter("dimension in ('words', 'p_size')"), "parts"), facet_sql("parts", "p_retailprice > 950", (), ("words",), (("p_size", 10),))),
        "dimension_dump": (lambda spark, d: dictionary.dump(R.orders(spark, d).dictionary).select("didx", "dvidx", "value").filter("didx = 1000002"), f"with {o} select cast(1000002 as bigint) as didx, cast(30000000 + row_number() over (order by c_mktsegment) - 1 as bigint) as dvidx, c_mktsegment as value from (select distinct c_mktsegment from rec)"),
        "total_count": (q(lambda b: b.where(m("c_nationkey") < 5).results().count), f"with {o} select count(*) as total_count from rec where c_nationkey < 5"),
        "group_count": (q(lambda b: b.group_by("n_name", "o_year").results().count), f"with {o} select count(*) as total_count from (select distinct n_name, o_year from rec)"),
        "agg_sum": (q(lambda b: rounded(b.field_sum("o_totalprice", "s").field_sum("price_band", "b").aggregate(), "s")), f"with {o} select round(sum(o_totalprice), 2) as s, cast(sum(price_band) as bigint) as b from rec"),
        "agg_min": (q(lambda b: b.field_min("o_totalprice", "x").field_min("n_name", "y").aggregate()), f"with {o} select min(o_totalprice) as x, min(n_name) as y from rec"),
        "agg_max": (q(lambda b: b.field_max("o_totalprice", "x").field_max("n_name", "y").aggregate()), f"with {o} select max(o_totalprice) as x, max(n_name) as y from rec"),
        "agg_count": (q(lambda b: b.field_count("o_orderstatus", "n").field_count(alias="all_rows").aggregate()), f"with {o} select count(o_orderstatus) as n, count(*) as all_rows from rec"),
        "agg_count_distinct": (q(lambda b: b.field_count_distinct("o_custkey", "n").aggregate()), f"with {o} select count(distinct o_custkey) as n from rec"),
        "agg_multi": (lambda spark, d: rounded(R.lines(spark, d).query().where(m("l_returnflag") == "R").field_sum("l_quantity", "q").field_sum("l_extendedprice", "p").field_min("l_discount", "least").field_max("l_discount", "most").field_count(alias="n").field_count_distinct("l_orderkey", "orders").aggregate(), "q", "p"), f"with {R.LINES_SQL} select round(sum(l_quantity), 2) as q, round(sum(l_extendedprice), 2) as p, min(l_discount) as least, max(l_discount) as most, count(*) as n, count(distinct l_orderkey) as orders from rec where l_returnflag = 'R'"),
        "agg_empty_set": (q(lambda b: b.where(m("c_nationkey") < -1).field_sum("o_totalprice", "s").field_min("o_totalprice", "least").field_count(alias="n").aggregate()), "select cast(0 as double) as s, cast(null as double) as least, cast(0 as bigint) as n"),
        "group_by_single": (q(lambda b: rounded(b.group_by("c_mktsegment").field_count(alias="n").field_sum("o_totalprice", "s").field_max("o_totalprice", "most").records_per_page(0).groups(), "s")), f"with {o} select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as s, max(o_totalprice) as most from rec group by 1"),
        "group_by_multi": (q(lambda b: b.group_by("o_orderstatus", "o_year").field_count(alias="n").records_per_page(0).groups()), f"with {o} select o_orderstatus, o_year, count(*) as n from rec group by all"),
        "group_by_paged": (q(lambda b: b.group_by("n_name", "o_year").field_count(alias="n").records_per_page(10).page_offset(3).groups()), f"with {o} select n_name, o_year, count(*) as n from rec group by all order by n_name nulls first, o_year nulls first limit 10 offset 20"),
        "slice_basic": (lambda spark, d: R.orders(spark, d).slice().group_field("n_name").slice_dimension("o_orderpriority").records_per_page(0).to_slice(), slice_sql("n_name")),
        "slice_filtered": (lambda spark, d: R.orders(spark, d).slice().where(m("urgent") == True).group_field("o_orderstatus", "o_year").slice_dimension("o_orderpriority").records_per_page(0).to_slice(), slice_sql("o_orderstatus, o_year", "urgent")),  # noqa: E712
        "slice_sorted_by_value": (lambda spark, d: R.orders(spark, d).slice().group_field("n_name").slice_dimension("o_orderpriority").order_by_descending("1-URGENT").records_per_page(7).to_slice(), slice_sql("n_name") + ' order by "1-URGENT" desc nulls last, n_name limit 7'),
        "sort_multi": (page(lambda b: b.order_by("o_orderstatus").then_by_descending("o_totalprice").records_per_page(50)), page_sql("o_orderstatus nulls first, o_totalprice desc nulls last, o_orderkey", "limit 50")),
        "page_first": (page(lambda b: b.order_by_descending("o_totalprice")), page_sql("o_totalprice desc nulls last, o_orderkey", "limit 10")),
        "page_third": (page(lambda b: b.order_by("c_mktsegment").records_per_page(25).page_offset(3)), page_sql("c_mktsegment nulls first, o_orderkey", "limit 25 offset 50")),
        "page_default_order": (page(lambda b: b.where(m("urgent") == True).records_per_page(15)), page_sql("__record_idx", "limit 15", "urgent")),  # noqa: E712
        "unpaged": (page(lambda b: b.where(m("c_nationkey") == 11).order_by("o_totalprice").records_per_page(0)), page_sql("o_totalprice nulls first, o_orderkey", "", "c_nationkey = 11")),
        "ordinal_position": (ordinal, f"with {o} select o_orderkey, row_number() over (order by o_totalprice desc nulls last, o_orderkey) - 1 as __ordinal_position from rec qualify __ordinal_position between 20 and 39"),
        "keyword_single": (keyword("Apache"), keyword_sql("apache")),
        "keyword_or": (keyword("Apache Creative"), keyword_sql("(apache|creative)")),
        "keyword_phrase": (keyword('"Public License"'), keyword_sql("public\\s+license")),
        "keyword_stop_word": (keyword("the"), f"with {R.DOCUMENTS_SQL} select doc_id from rec where false"),
        "word_blob": (lambda spark, d: R.read(spark, d, "documents").select("doc_id", word_blob(F.col("text")).alias("blob")), "select doc_id, array_to_string(list_filter(string_split(regexp_replace(text, '[\",.!?\\r\\n]', ' ', 'g'), ' '), lambda w: w <> '' and lower(w) not in (" + ", ".join(f"'{w}'" for w in STOP_WORDS) + ")), ' ') as blob from documents"),
        "keyword_accents": (keyword("e"), keyword_sql("e", "strip_accents(text)")),
        "security_single": (q(lambda b: b.where_user(3).everything().select(*SHOWN["orders"])), rec + "c_nationkey % 5 = 3"),
        "security_multi": (q(lambda b: b.where_user(1, 6, 2).everything().select(*SHOWN["orders"])), rec + "c_nationkey % 5 in (1, 2)"),
        "url_query": (q(lambda b: b.where_url("https://x/?ff=c_nationkey,LessThanOrEq,12|c_mktsegment,Like,B*&fs=o_totalprice,0&rpp=30&po=2&fsel=c_mktsegment|o_orderstatus|o_totalprice").records().select("o_orderkey", "c_mktsegment", "o_orderstatus", "o_totalprice")), page_sql("o_totalprice desc nulls last, o_orderkey", "limit 30 offset 30", "c_nationkey <= 12 and c_mktsegment like 'B%'")),
        "last_timestamp": (lambda spark, d: R.orders(spark, d).last_timestamp(R.orders(spark, d).query().where(m("c_nationkey") == 3).q), f"with {o} select coalesce(max(__timestamp), 0) as last_timestamp from rec where c_nationkey = 3"),
        "upsert_state": (upsert_state, UPSERT_SQL),
        "update_where_state": (update_where_state, f"with {KV_SQL} select id, case when price < 1000 then 'cheap and fa' else name end as name, case when price < 1000 then 1.0 else price end as price, price < 1000 as changed from kv"),
        "delete_pk_state": (delete_pk_state, f"with {KV_SQL} select * from kv where id >= 500"),
        "delete_where_state": (delete_where_state, f"with {R.DOCUMENTS_SQL} select doc_id, quality from rec where quality is distinct from 0"),
        "rename_refinement_state": (rename_state, f"with {o} select case when c_mktsegment = 'BUILDING' then 'CONSTRUCTION' else c_mktsegment end as value, count(*) as count from rec group by 1"),
        "delete_refinement_state": (lambda spark, d: rename_state(spark, d, None), f"with {o} select c_mktsegment as value, count(*) as count from rec where c_mktsegment <> 'BUILDING' group by 1"),
        "delete_list_refinement_state": (rename_list_state, f"with {o} select x as value, count(*) as count from (select unnest(flags) as x from rec) where x <> 'A' group by 1"),
        "inherited_view": (inherited_view, "select c_custkey, c_mktsegment, round(sum(o_totalprice), 2) as spent from customer left join orders on o_custkey = c_custkey group by all"),
        "dictionary_combined": (combined_dictionary, f"with {R.ORDERS_SQL} select cast(1000000 as bigint) as didx, cast(10000000 + row_number() over (order by p_brand) - 1 as bigint) as dvidx, p_brand as value from (select distinct p_brand from part) union all select 1, 10000 + row_number() over (order by cast(o_year as varchar)) - 1, cast(o_year as varchar) from (select distinct o_year from rec)"),
        "child_sync": (child_sync, f"with {R.ORDERS_SQL} select __record_idx, case when o_orderkey % 2 = 0 then n_name end as note from rec where o_orderkey % 3 <> 0"),
        "grants_changed": (granted, GRANTED_SQL),
        "rows_that_do_not_fit": (misfit_rows, "select 'name' as field, 'too long' as problem, count(*) as n from part where length(p_name) + 3 > 12 union all select 'more', 'unknown', 1"),
        "page_by_time": (page(lambda b: b.order_by_descending("__timestamp").records_per_page(40)), page_sql("__timestamp desc nulls last, o_orderkey", "limit 40")),
        "slice_long": (lambda spark, d: (lambda r: r.cross_counts(SliceQuery(r.query().group_by("n_name").q, "o_orderpriority")))(R.orders(spark, d)), f"with {o} select n_name, o_orderpriority as value, count(*) as count from rec group by all"),
        "export_round_trip": (exported, "select event_id, event_type, value from events"),
        "altered_state": (altered, f"with {KV_SQL} select id, name, cast(null as varchar) as note, __record_idx from kv"),
        "cleared_table": (cleared, "select distinct 'names' as part, p_brand as value from part"),
        "snapshot_table_facets": (upsert_table, facet_sql("parts", "true", ("p_brand", "p_type"), ("words",), (("p_size", 10),))),
    }
    return out


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def slice_sql(keys: str, where: str = "true") -> str:
    counts = ", ".join(f"count(*) filter (where o_orderpriority = '{p}') as \"{p}\"" for p in PRIORITIES)
    return f"with {R.ORDERS_SQL} select {keys}, {counts} from rec where {where} group by {keys}"


def keyword(text: str):
    return lambda spark, d: R.documents(spark, d).query().where_keyword(text).everything().select("doc_id")


def keyword_sql(pattern: str, text: str = "text") -> str:
    return f"with {R.DOCUMENTS_SQL} select doc_id from rec where regexp_matches({text}, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){pattern}($|[^\\p{{L}}\\p{{N}}_])')"


def queries():
    return {n: build for n, (build, _) in registered().items()}


def oracle_sql():
    return {n: sql for n, (_, sql) in registered().items() if sql}
