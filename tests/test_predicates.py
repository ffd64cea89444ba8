"""Filters on the edge cases: NULL, case, metacharacters, type limits, lists, points."""

from datetime import datetime

import pytest
from pyspark.sql import Row

from facetwise.builder import m
from facetwise.errors import QueryError
from facetwise.query import Comparer, Filter, GeoFilter
from facetwise.repository import Repository
from facetwise.schema import Field, Kind, Schema, dimension

SCHEMA = Schema(
    "edge",
    (
        Field("id", Kind.INT, primary_key=True, nullable=False), Field("s", Kind.STRING, text_search=True), Field("i", Kind.INT), Field("l", Kind.LONG), Field("f", Kind.FLOAT),
        Field("b", Kind.BOOL), Field("d", Kind.DATETIME), Field("p", Kind.GEO), dimension("tags", Kind.LIST), dimension("band", Kind.INT, numeric_break=5),
    ),
)
D = datetime
ROWS = [
    (1, "alpha", -7, -7, -1.5, True, D(2020, 1, 1), (40.0, -75.0), ["a", "b"], -7),
    (2, "Alpha", 0, 0, 0.0, False, D(2020, 1, 1, 0, 0, 1), (40.0, -74.0), ["b"], 0),
    (3, None, None, None, None, None, None, None, None, None),
    (4, "", 5, 5, 5.0, True, D(1999, 12, 31, 23, 59, 59), (0.0, 180.0), [], 5),
    (5, "50%_off", 2147483647, 9223372036854775807, 1e300, True, D(2020, 2, 29, 12), (90.0, 0.0), ["a"], 4),
    (6, "a^b", 3, 3, 3.25, False, D(2020, 6, 1), (-90.0, 0.0), ["a^b"], 3),
    (7, "red blue sky", 4, 4, 4.0, False, D(2021, 1, 1), (40.0, -75.0), ["c"], 4),
    (8, "été sky", 6, 6, 6.0, True, D(2021, 1, 1), (40.00001, -75.0), ["A"], 6),
]


@pytest.fixture(scope="module")
def repo(spark):
    rows = [(*r, r[0], r[0], 0) for r in ROWS]
    return Repository(SCHEMA, spark.createDataFrame(rows, SCHEMA.struct(system=True)).cache())


def ids(repo, *terms):
    return sorted(r["id"] for r in repo.query().where(*terms).everything().collect())


CASES = [
    (m("s") == "alpha", [1]), (m("s") != "alpha", [2, 4, 5, 6, 7, 8]), (m("s") == None, [3]), (m("s") != None, [1, 2, 4, 5, 6, 7, 8]),  # noqa: E711
    (m("s").like("50%_off"), [5]), (m("s").like("*%*"), [5]), (m("s").startswith("a"), [1, 6]), (m("s").endswith("sky"), [7, 8]), (m("s").like("al*pha"), [1]), (m("s") == "", [4]),
    (Filter("s", Comparer.ANY, "lph^sky"), [1, 2, 7, 8]), (m("s").contains_any("a^b"), [6]), (m("s").contains_none("a"), [4, 5, 7, 8]),
    (m("i") == -7, [1]), (m("i") <= 0, [1, 2]), (m("i") >= 2147483647, [5]), (m("i") != 0, [1, 4, 5, 6, 7, 8]), (m("l") == 9223372036854775807, [5]), (m("f") > 5, [5, 8]),
    (m("b") == None, [3]), (m("b") != None, [1, 2, 4, 5, 6, 7, 8]), (~m("b"), [2, 6, 7]), (m("b") == "1", [1, 4, 5, 8]),  # noqa: E711
    (m("d") == "2020-01-01 00:00:00", [1]), (m("d") < D(2000, 1, 1), [4]), (m("d") == None, [3]),  # noqa: E711
    (m("tags") == ["a", "c"], [1, 5, 7]), (m("tags") != ["a"], [2, 3, 4, 6, 7, 8]), (m("tags") == "{null}", [3, 4]), (m("tags") != "{null}", [1, 2, 5, 6, 7, 8]), (m("tags") == "A", [1, 5, 6, 8]), (m("tags").like("a*"), [1, 5, 6]),
    (m("p").within(1, 40.0, -75.0), [1, 7, 8]), (GeoFilter("p", Comparer.EQ, 40.0, -75.0, 0), [1, 7, 8]), (m("p").beyond(8900, 40.0, -75.0), [6]), (GeoFilter("p", Comparer.NE, 40.0, -75.0, 0), [2, 4, 5, 6]),
    (m("__timestamp") > 6, [7, 8]),
]


@pytest.mark.parametrize("at", range(len(CASES)))
def test_filter(repo, at):
    terms, expected = CASES[at]
    assert ids(repo, terms) == expected


@pytest.mark.parametrize("terms", [m("b") < True, m("d").like("x"), m("f").contains_any(1), m("tags") > "a", m("p") == 1, GeoFilter("s", Comparer.LE, 0, 0, 1), m("none") == 1, m("i") == "x", m("i") == 2**31, m("i") < None])
def test_refused(repo, terms):
    with pytest.raises(QueryError):
        ids(repo, terms)


def test_compat_ignores_what_it_cannot_read(repo):
    lax = Repository(SCHEMA, repo.records, compat=True)
    assert ids(lax, m("none") == 1, m("i") == "x", m("i") == 3) == [6]


def test_two_distances(repo):
    with pytest.raises(QueryError):
        repo.query().where(m("p").within(1, 0, 0), m("p").within(2, 0, 0))


def test_collation(repo):
    assert ids(Repository(SCHEMA, repo.records, collation="UTF8_LCASE"), m("s") == "ALPHA") == [1, 2]


def test_keyword(repo):
    found = lambda text: sorted(r["id"] for r in repo.query().where_keyword(text).everything().collect())
    assert found("SKY") == [7, 8]
    assert found('"red blue" alpha') == [1, 2, 7]
    assert found("été") == found("ete") == found("E\u0301TE") == [8] and found("t") == [] and found("the") == []


def test_buckets_truncate_toward_zero(repo):
    rows = {(r["value"], r["count"], r["min_value"], r["max_value"]) for r in repo.query().facets().filter("dimension = 'band'").collect()}
    assert rows == {("-5", 1, -5, 0), ("0", 4, 0, 5), ("5", 2, 5, 10)}


def test_distance_column_is_near_the_truth(repo):
    # New York to London on the ellipsoid
    from pyspark.sql import functions as F

    from facetwise.functions.scalar import miles

    spark = repo.records.sparkSession
    got = spark.createDataFrame([Row(a=40.7128, b=-74.006)]).select(miles(F.col("a"), F.col("b"), 51.5074, -0.1278).alias("x")).first()["x"]
    assert abs(got - 3470.5) < 0.1


def test_word_blob(spark):
    from pyspark.sql import functions as F

    from facetwise.functions.scalar import word_blob

    rows = spark.createDataFrame([Row(i=0, t="The Red, red\r\nsky. IS 7 \"x\""), Row(i=1, t=""), Row(i=2, t=None), Row(i=3, t="the")]).orderBy("i")
    assert [r["x"] for r in rows.select(word_blob(F.col("t")).alias("x")).collect()] == ["Red red sky x", None, None, ""]
