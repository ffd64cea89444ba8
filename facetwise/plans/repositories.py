"""Repositories modelled on the star-schema tables, and the SQL that gives the same records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..repository import Repository
from ..schema import Field, Kind, Schema, dimension

K = Kind


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def system(rows: DataFrame, key: str) -> DataFrame:
    """Record id and time from the key, the same in SQL."""
    return rows.withColumns({"__record_idx": F.col(key).cast("long"), "__timestamp": (F.col(key) % 1000).cast("int"), "__hash": F.xxhash64(key)})


ORDERS = Schema(
    "orders",
    (
        Field("o_orderkey", K.LONG, primary_key=True, nullable=False),
        Field("o_custkey", K.LONG),
        Field("o_totalprice", K.FLOAT),
        Field("o_orderdate", K.DATETIME),
        Field("c_nationkey", K.INT),
        Field("c_acctbal", K.FLOAT),
        Field("urgent", K.BOOL),
        dimension("o_orderstatus", K.STRING),
        dimension("o_orderpriority", K.STRING),
        dimension("c_mktsegment", K.STRING),
        dimension("r_name", K.STRING),
        dimension("n_name", K.STRING, parent="r_name"),
        dimension("o_year", K.INT),
        dimension("price_band", K.LONG, numeric_break=50000),
        dimension("flags", K.LIST),
    ),
    permission_field="c_nationkey",
)
ORDERS_SQL = """
rec as (
  select o_orderkey, o_custkey, o_totalprice, o_orderdate, c_nationkey, c_acctbal, o_orderpriority in ('1-URGENT', '2-HIGH') as urgent,
         nullif(o_orderstatus, 'P') as o_orderstatus, o_orderpriority, c_mktsegment, r_name, n_name, cast(year(o_orderdate) as int) as o_year,
         cast(floor(o_totalprice) as bigint) as price_band, flags, cast(o_orderkey as bigint) as __record_idx, cast(o_orderkey % 1000 as int) as __timestamp
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  left join (select l_orderkey, list(distinct l_returnflag) as flags from lineitem group by l_orderkey) f on l_orderkey = o_orderkey
)"""


def orders(spark: SparkSession, d: str, **options) -> Repository:
    flags = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("flags"))  # at most as many as there are flags
    rows = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = rows.join(flags, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    rows = rows.withColumns({
        "urgent": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderstatus": F.nullif(F.col("o_orderstatus"), F.lit("P")),
        "o_year": F.year("o_orderdate").cast("int"), "price_band": F.floor("o_totalprice").cast("long"),
    })
    rows = system(rows, "o_orderkey").select(*[f.name for f in ORDERS.fields], "__record_idx", "__timestamp", "__hash")
    grants = spark.range(1, 11).select(F.col("id").cast("int").alias("user_id"), F.explode(F.sequence(F.lit(0), F.lit(24))).alias("n"))
    grants = grants.filter("n % 5 = user_id % 5").select("user_id", F.col("n").cast("string").alias("fk_field"))
    return Repository(ORDERS, rows, grants=grants, **options)


EVENTS = Schema(
    "events",
    (
        Field("event_id", K.LONG, primary_key=True, nullable=False), Field("ts", K.DATETIME), Field("user_id", K.LONG), Field("value", K.FLOAT), Field("props", K.STRING, length=0),
        dimension("event_type", K.STRING), dimension("value_band", K.INT, numeric_break=50),
    ),
)
EVENTS_SQL = """
rec as (
  select event_id, ts, user_id, value, props, event_type, cast(floor(value) as int) as value_band, event_id as __record_idx, cast(event_id % 1000 as int) as __timestamp from events
)"""


def events(spark: SparkSession, d: str, **options) -> Repository:
    rows = read(spark, d, "events").withColumn("value_band", F.floor("value").cast("int"))
    return Repository(EVENTS, system(rows, "event_id").select(*[f.name for f in EVENTS.fields], "__record_idx", "__timestamp", "__hash"), **options)


PARTS = Schema(
    "parts",
    (
        Field("p_partkey", K.LONG, primary_key=True, nullable=False), Field("p_name", K.STRING, text_search=True), Field("p_retailprice", K.FLOAT),
        dimension("p_brand", K.STRING), dimension("p_type", K.STRING), dimension("p_size", K.INT, numeric_break=10), dimension("words", K.LIST),
    ),
)
PARTS_SQL = """
rec as (
  select p_partkey, p_name, p_retailprice, p_brand, p_type, p_size, list_distinct(string_split(p_name, ' ')) as words,
         p_partkey as __record_idx, cast(p_partkey % 1000 as int) as __timestamp from part
)"""


def parts(spark: SparkSession, d: str, **options) -> Repository:
    rows = read(spark, d, "part").withColumn("words", F.array_distinct(F.split("p_name", " ")))
    return Repository(PARTS, system(rows, "p_partkey").select(*[f.name for f in PARTS.fields], "__record_idx", "__timestamp", "__hash"), **options)


DOCUMENTS = Schema(
    "documents",
    (
        Field("doc_id", K.LONG, primary_key=True, nullable=False), Field("text", K.STRING, length=0, text_search=True), Field("quality", K.INT),
        dimension("lang", K.STRING), dimension("source", K.STRING), dimension("n_chars", K.LONG, numeric_break=1000),
    ),
)
DOCUMENTS_SQL = """
rec as (
  select d.doc_id, d.text, l.quality, d.lang, d.source, d.n_chars, d.doc_id as __record_idx, cast(d.doc_id % 1000 as int) as __timestamp
  from documents d left join labels l on d.doc_id = l.doc_id
)"""


def documents(spark: SparkSession, d: str, **options) -> Repository:
    rows = read(spark, d, "documents").join(read(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return Repository(DOCUMENTS, system(rows, "doc_id").select(*[f.name for f in DOCUMENTS.fields], "__record_idx", "__timestamp", "__hash"), **options)


CUSTOMERS = Schema(
    "customer_geo",
    (
        Field("c_custkey", K.LONG, primary_key=True, nullable=False), Field("c_name", K.STRING), Field("c_acctbal", K.FLOAT), Field("place", K.GEO), dimension("c_mktsegment", K.STRING),
    ),
)
CUSTOMERS_SQL = """
geo as (
  select c_custkey, c_name, c_acctbal, c_mktsegment, cast((c_custkey * 37) % 1200 as double) / 10 - 60 as lat, cast((c_custkey * 101) % 3600 as double) / 10 - 180 as lon, c_custkey as __record_idx from customer
),
halves as (select *, radians(lat + 40.0) / 2 as middle, radians(lat - 40.0) / 2 as half, radians(lon + 75.0) / 2 as turn from geo),
sums as (
  select *, pow(sin(half), 2) * pow(cos(turn), 2) + pow(cos(middle), 2) * pow(sin(turn), 2) as near,
         pow(cos(half), 2) * pow(cos(turn), 2) + pow(sin(middle), 2) * pow(sin(turn), 2) as far from halves
),
arcs as (select *, atan2(sqrt(near), sqrt(far)) as angle, sqrt(near * far) / nullif(atan2(sqrt(near), sqrt(far)), 0) as ratio from sums),
rec as (
  select *, 2 * 6378137.0 / 1609.344 * angle * (case when near < 1e-15 or far < 1e-9 then 1.0 else 1 + 1 / 298.257223563 * (
    (3 * ratio - 1) / (2 * far) * pow(sin(middle), 2) * pow(cos(half), 2) - (3 * ratio + 1) / (2 * near) * pow(cos(middle), 2) * pow(sin(half), 2)) end) as miles from arcs
)"""


def customers(spark: SparkSession, d: str, **options) -> Repository:
    rows = read(spark, d, "customer")
    lat = ((F.col("c_custkey") * 37) % 1200).cast("double") / 10 - 60
    lon = ((F.col("c_custkey") * 101) % 3600).cast("double") / 10 - 180
    rows = rows.withColumn("place", F.struct(lat.alias("lat"), lon.alias("lon")))
    return Repository(CUSTOMERS, system(rows, "c_custkey").select(*[f.name for f in CUSTOMERS.fields], "__record_idx", "__timestamp", "__hash"), **options)


LINES = Schema(
    "lines",
    (
        Field("line", K.STRING, primary_key=True, nullable=False), Field("l_orderkey", K.LONG), Field("l_extendedprice", K.FLOAT), Field("l_quantity", K.FLOAT), Field("l_discount", K.FLOAT), Field("l_shipdate", K.DATETIME),
        dimension("l_returnflag", K.STRING), dimension("l_linestatus", K.STRING), dimension("quantity", K.INT, numeric_break=10),
    ),
)
LINES_SQL = """
rec as (
  select l_orderkey, l_extendedprice, l_quantity, l_discount, l_shipdate, l_returnflag, l_linestatus, cast(l_quantity as int) as quantity from lineitem
)"""


def lines(spark: SparkSession, d: str, **options) -> Repository:
    """Line items; they have no key, so theirs is made of what they say, and only unordered queries are asked."""
    rows = read(spark, d, "lineitem").withColumn("quantity", F.col("l_quantity").cast("int"))
    key = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = rows.withColumns({"line": key, "__record_idx": F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "__timestamp": F.lit(0), "__hash": F.lit(0).cast("long")})
    return Repository(LINES, rows.select(*[f.name for f in LINES.fields], "__record_idx", "__timestamp", "__hash"), **options)
