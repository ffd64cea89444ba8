"""Snapshot tables against a dict, grants, export, streams."""

import random

import pytest

from facetwise.builder import m
from facetwise.errors import StaleSchemaError
from facetwise.operators import security
from facetwise.repository import Repository
from facetwise.schema import Field, Kind, Schema, dimension
from facetwise.sources import export
from facetwise.sources.storage import Catalog, SnapshotTable
from facetwise.streaming.upsert import changed_since, upsert_stream

SCHEMA = Schema("things", (Field("id", Kind.INT, primary_key=True, nullable=False), Field("name", Kind.STRING, length=6), Field("n", Kind.INT), dimension("color", Kind.STRING), dimension("tags", Kind.LIST)))
BATCH = "id int, name string, n int, color string, tags array<string>, o int"


@pytest.fixture
def table(spark, tmp_path):
    return SnapshotTable(spark, f"file://{tmp_path}/things", SCHEMA)


def state(repo):
    return {r["id"]: (r["name"], r["n"], r["color"], tuple(r["tags"] or ())) for r in repo.records.collect()}


def test_changes_follow_a_dict(spark, table):
    rng, model, repo = random.Random(5), {}, Repository.open(table)
    for now in range(1, 6):
        rows = [(rng.randrange(12), rng.choice(["a", "longer name", None]), rng.randrange(5), rng.choice(["red", "blue", None]), rng.choice([["x"], ["x", "y", "x"], []]), o) for o in range(8)]
        repo.upsert(spark.createDataFrame(rows, BATCH), "o", now)
        for i, s, n, c, t, _ in rows:
            model[i] = (s[:6] if s else s, n, c, tuple(dict.fromkeys(t)))
        assert state(repo) == model
        done = repo.update().where(m("n") == 3).field("color", "green").commit()
        hit = [i for i in model if model[i][1] == 3]
        assert done.count == len(hit)
        for i in hit:
            model[i] = (*model[i][:2], "green", model[i][3])
        assert state(repo) == model
        repo.delete().where(m("n") == now % 5).commit()
        model = {i: v for i, v in model.items() if v[1] != now % 5}
        assert state(repo) == model
    ids = [r["__record_idx"] for r in repo.records.collect()]
    assert len(set(ids)) == len(ids)
    known = {r["value"] for r in repo.dictionary.collect()}
    assert {"red", "blue", "x", "y"} <= known
    repo.clear()
    assert state(repo) == {} and {r["value"] for r in repo.dictionary.collect()} == known


def test_unchanged_rows_only_get_the_time(spark, table):
    repo = Repository.open(table)
    rows = spark.createDataFrame([(1, "a", 1, "red", ["x"], 0), (2, "b", 2, None, None, 0)], BATCH)
    repo.upsert(rows, now=1)
    before = {r["id"]: (r["__record_idx"], r["__hash"]) for r in repo.records.collect()}
    repo.upsert(rows, now=2)
    assert {r["id"]: (r["__record_idx"], r["__hash"]) for r in repo.records.collect()} == before
    assert changed_since(repo, 1).count() == 2 and changed_since(repo, 2).count() == 0
    words = {(r["didx"], r["value"]): r["dvidx"] for r in repo.dictionary.collect()}
    repo.upsert(spark.createDataFrame([(3, "c", 1, "amber", ["w"], 0)], BATCH), now=3)
    after = {(r["didx"], r["value"]): r["dvidx"] for r in repo.dictionary.collect()}
    assert words.items() <= after.items() and len(set(after.values())) == len(after)


def test_versions_and_schema(spark, table):
    repo = Repository.open(table)
    repo.upsert(spark.createDataFrame([(1, "a", 1, "red", ["x"], 0)], BATCH), now=1)
    with pytest.raises(StaleSchemaError):
        repo.upsert(spark.createDataFrame([(1, "a", 1, "red", ["x"], 0)], BATCH), now=1, expected="no")
    version = table.version
    new = Schema("things", (*SCHEMA.fields[:2], dimension("color", Kind.STRING), dimension("size", Kind.STRING)))
    repo.alter(new)
    assert table.version == version + 1 and table.schema.find("tags") is None
    assert repo.records.first()["size"] is None and {r["value"] for r in repo.dictionary.collect()} == {"red"}
    (dvidx,) = [r["dvidx"] for r in repo.dictionary.collect()]
    assert repo.rename_value(dvidx, "crimson") and repo.records.first()["color"] == "crimson"
    assert not repo.rename_value(dvidx, "") and not repo.rename_value(99, "x")
    assert not repo.update().commit().success


def test_writes_store_what_they_change(spark, table, tmp_path):
    """Grants and names leave the records where they are; of two writers of a version one gets an error; old folders go."""
    repo = Repository.open(table)
    repo.upsert(spark.createDataFrame([(1, "a", 1, "red", ["x"], 0)], BATCH), now=1)
    before = table.at("records")
    for i in range(5):
        repo.grant([(i, "a")])
    repo.revoke([(0, "a")])
    assert table.at("records") == before and table.read().count() == 1 and repo.grants.count() == 4
    folders = [n for n in table.files.names(table.path) if n.startswith("version=")]
    assert len(folders) <= 1 + 2 * table.keep and all(set(table.files.names(f"{table.path}/{n}")) == {"grants"} for n in folders if n not in (before.split("/")[-2],))
    old = table.version
    assert not table.files.put(f"{table.path}/{old}.done", "other") and table.version == old and table.schema == SCHEMA
    other = SnapshotTable(spark, table.path)
    put = other.files.put
    other.files.put = lambda path, text: (put(path, text), False)[1]  # another was first
    with pytest.raises(StaleSchemaError):
        Repository.open(other).grant([(9, "b")])
    assert table.read().count() == 1


def test_catalog(spark, tmp_path):
    c = Catalog(spark, f"file://{tmp_path}")
    assert not c.exists("things")
    c.create(SCHEMA)
    assert c.exists("things") and [r["name"] for r in c.listing("thi").collect()] == ["things"] and c.open("things").schema == SCHEMA
    c.create(Schema("tools", SCHEMA.fields))
    assert [r["name"] for r in c.listing(sort="created", descending=True).collect()] == ["tools", "things"] and c.listing(sort="item_count", page=2, per_page=1).count() == 1
    assert c.listing().first()["created"] is not None
    c.drop("things")
    assert not c.exists("things")
    with pytest.raises(FileNotFoundError):
        c.open("things")


def test_grants(spark):
    g = spark.createDataFrame([(1, "a"), (2, "b")], "user_id int, fk_field string")
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(security.grant(g, [(1, "a"), (3, "a")])) == {(1, "a"), (2, "b"), (3, "a")}
    assert as_set(security.grant(g, [(3, "a")], reset=True)) == {(2, "b"), (3, "a")}
    assert as_set(security.revoke(g, [(1, "a")])) == {(2, "b")} and as_set(security.clear(g, user=2)) == {(1, "a")} and as_set(security.clear(g, value="a")) == {(2, "b")} and as_set(security.clear(g)) == set()


@pytest.mark.parametrize("kind", ["parquet", "json", "orc", "csv"])
def test_export(spark, tmp_path, kind):
    rows = spark.createDataFrame([(i, f"n{i}") for i in range(25)], "id int, name string")
    export.export_async(rows, f"file://{tmp_path}/out", kind).result()
    back = export.read(spark, f"file://{tmp_path}/out", rows.schema, kind)
    parts = list(export.items(back, 10))
    assert [len(p) for p in parts] == [10, 10, 5] and {tuple(r) for p in parts for r in p} == {tuple(r) for r in rows.collect()}


def test_stream(spark, table, tmp_path):
    spark.createDataFrame([(i % 3, f"s{i}", i, "red", ["x"], i) for i in range(6)], BATCH).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    rows = spark.readStream.schema(spark.read.parquet(f"file://{tmp_path}/in").schema).parquet(f"file://{tmp_path}/in")
    upsert_stream(rows, table, f"file://{tmp_path}/ck", "o").awaitTermination()
    assert {i: v[0] for i, v in state(Repository.open(table)).items()} == {0: "s3", 1: "s4", 2: "s5"}


def test_threads_and_items(spark, table):
    repo = Repository.open(table)
    rows = spark.createDataFrame([(i, f"n{i}", i % 3, "red", ["x"], 0) for i in range(25)], BATCH)
    assert repo.validate(rows).collect() and {r["problem"] for r in repo.validate(rows).collect()} == {"unknown"}
    repo.upsert(rows, now=1)
    handles = [repo.update().where(m("n") == k).field("color", f"c{k}").commit_async() for k in range(3)]
    assert sum(h.result().count for h in handles) == 25
    assert {(v[1], v[2]) for v in state(repo).values()} == {(0, "c0"), (1, "c1"), (2, "c2")}
    parts = list(repo.query().order_by("id").items(10))
    assert [len(p) for p in parts] == [10, 10, 5] and [r["id"] for p in parts for r in p] == list(range(25))
    repo.fetch(repo.query().q)
    repo.fetch(repo.query().q)
    assert [x["cached"] for x in repo.log] == [False, True] and repo.log[-1]["count"] == 25
    repo.grant([(1, "a"), (2, "b")])
    repo.revoke([(1, "a")])
    assert [tuple(r) for r in repo.grants.collect()] == [(2, "b")]


def test_misfits(spark):
    from facetwise.operators.dml import misfits

    rows = spark.createDataFrame([("1", "short"), (None, "far too long"), ("x", None)], "id string, name string")
    assert {(r["field"], r["problem"], r["n"]) for r in misfits(rows, SCHEMA).collect()} == {("id", "not int", 1), ("id", "null", 1), ("name", "too long", 1)}


def test_items_and_grouping(spark, tmp_path):
    from dataclasses import dataclass, field

    @dataclass
    class Thing:
        id: int
        name: str
        extra_values: dict = field(default_factory=dict)

    schema = Schema("g", (Field("tenant", Kind.STRING, data_grouping=True), Field("id", Kind.INT, primary_key=True, nullable=False), Field("name", Kind.STRING), Field("price", Kind.FLOAT), Field("at", Kind.GEO), dimension("tags", Kind.LIST)))
    table = SnapshotTable(spark, f"file://{tmp_path}/g", schema)
    repo = Repository.open(table)
    repo.upsert_items([Thing(1, "a", {"Price": "2.5", "tenant": "01"}), {"id": "2", "tags": ["x", "x"], "at": (1, 2), "tenant": "2", "nothing": 0}, Thing(1, "b", {"price": 3})], now=1)
    rows = {r["id"]: (r["tenant"], r["name"], r["price"], r["tags"], r["at"] and tuple(r["at"])) for r in repo.records.collect()}
    assert rows == {1: (None, "b", 3.0, None, None), 2: ("2", None, None, ["x"], (1.0, 2.0))}
    repo.upsert_items([{"id": 1, "tenant": "01"}], now=2)
    assert {r["tenant"] for r in repo.records.collect()} == {"01", "2"} and repo.records.columns[:2] == ["tenant", "id"]
    assert "PartitionFilters: [isnotnull(tenant" in repo.query().where(m("tenant") == "01").everything()._jdf.queryExecution().toString()
