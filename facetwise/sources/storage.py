"""Snapshot tables on any Hadoop file system: each write makes a new version, and a marker file makes it the current one.

Under a table's path stand version=N folders with the parquet parts (records, dictionary, grants) that version N wrote. The
marker N.done has the schema and, for each part, the version whose folder holds it, so a write stores only the parts that it
changes: grants and facet names change without a look at the records. A marker is made once and never overwritten: of two
writers of one version the second gets an error. Readers keep the version that they began with.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import StaleSchemaError
from ..operators import dictionary as words
from ..schema import Schema

GRANTS = "user_id int, fk_field string"
PARTS = ("records", "dictionary", "grants")


class Files:
    """The few file operations that the catalog needs, by Hadoop's own file systems."""

    def __init__(self, spark: SparkSession):
        self.spark, self.jvm = spark, spark._jvm

    def _at(self, path: str):
        p = self.jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def names(self, path: str) -> list[str]:
        fs, p = self._at(path)
        return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []

    def exists(self, path: str) -> bool:
        fs, p = self._at(path)
        return fs.exists(p)

    def put(self, path: str, text: str) -> bool:
        """Write a new file; False if there is one already."""
        fs, p = self._at(path)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def get(self, path: str) -> str:
        fs, p = self._at(path)
        stream = fs.open(p)
        text = self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return text

    def drop(self, path: str) -> None:
        fs, p = self._at(path)
        fs.delete(p, True)


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: Schema | None = None, keep: int = 2):
        """The table at path; with a schema it is created if it isn't there. keep: versions that stay after a write."""
        self.spark, self.path, self.keep, self.files = spark, path.rstrip("/"), keep, Files(spark)
        if self.version is None:
            if schema is None:
                raise FileNotFoundError(path)
            self.write(schema, spark.createDataFrame([], schema.struct(system=True)), spark.createDataFrame([], words.COLUMNS), spark.createDataFrame([], T._parse_datatype_string(GRANTS)))

    def versions(self) -> list[int]:
        """Finished versions, ascending."""
        return sorted(int(n.removesuffix(".done")) for n in self.files.names(self.path) if n.endswith(".done"))

    @property
    def version(self) -> int | None:
        """The current version; it changes with every write."""
        return (self.versions() or [None])[-1]

    def _marker(self, version: int) -> dict:
        return json.loads(self.files.get(f"{self.path}/{version}.done"))

    def at(self, part: str, version: int | None = None) -> str:
        """The folder that holds a part of a version."""
        return f"{self.path}/{self._marker(self.version if version is None else version)['parts'][part]}/{part}"

    @property
    def schema(self) -> Schema:
        return self.schema_at(self.version)

    def schema_at(self, version: int) -> Schema:
        return Schema.from_json(self._marker(version)["schema"])

    def created(self) -> int:
        """Milliseconds since 1970 when the table was made."""
        return self._marker(self.version)["created"]

    def read(self, part: str = "records", version: int | None = None) -> DataFrame:
        """A part of a version. Records are read by their schema, as the folders of a grouping field say nothing of its type."""
        version = self.version if version is None else version
        reader = self.spark.read.schema(self.schema_at(version).struct(system=True)) if part == "records" else self.spark.read
        rows = reader.parquet(self.at(part, version))
        return rows.select(*[F.col(f"`{n}`") for n in self.schema_at(version).struct(system=True).names]) if part == "records" else rows

    def write(self, schema: Schema, records: DataFrame | None = None, dictionary: DataFrame | None = None, grants: DataFrame | None = None, expected: str | None = None) -> int:
        """A new version; parts that are None stay where they are. expected: the schema's version hash that the writer knows."""
        now = self.version
        if expected is not None and now is not None and expected != self.schema.version_hash():
            raise StaleSchemaError("the schema has changed")
        new = 0 if now is None else now + 1
        before = self._marker(now) if now is not None else {"parts": {}}
        folder = f"version={new}-{uuid.uuid4().hex[:12]}"  # of this writer alone
        parts = dict(before["parts"])
        for part, rows in zip(PARTS, (records, dictionary, grants)):
            if rows is None:
                continue
            group = next((f.name for f in schema.fields if f.data_grouping), None) if part == "records" else None
            out = rows.write.mode("overwrite")
            (out.partitionBy(group) if group else out).parquet(f"{self.path}/{folder}/{part}")
            parts[part] = folder
        made = before.get("created") or int(self.spark.sql("select unix_millis(current_timestamp())").first()[0])
        if not self.files.put(f"{self.path}/{new}.done", json.dumps({"schema": schema.to_json(), "parts": parts, "created": made})):
            self.files.drop(f"{self.path}/{folder}")
            raise StaleSchemaError(f"version {new} was written by another")
        self._tidy()
        return new

    def _tidy(self) -> None:
        """Drop versions before the last `keep`, and folders of older versions that none of those holds a part in."""
        versions = self.versions()
        least = versions[-self.keep :][0]
        kept = {f for v in versions if v >= least for f in self._marker(v)["parts"].values()}
        for v in versions[: -self.keep]:
            self.files.drop(f"{self.path}/{v}.done")
        for n in self.files.names(self.path):
            if n.startswith("version=") and n not in kept and int(n.removeprefix("version=").split("-")[0]) < least:
                self.files.drop(f"{self.path}/{n}")

    def drop(self) -> None:
        self.files.drop(self.path)


class Catalog:
    """Repositories under one folder."""

    COLUMNS = ("name", "parent", "version_hash", "version", "created", "item_count")

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark)

    def exists(self, name: str) -> bool:
        return any(n.endswith(".done") for n in self.files.names(f"{self.root}/{name}"))

    def create(self, schema: Schema) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{schema.name}", schema)

    def open(self, name: str) -> SnapshotTable:
        return SnapshotTable(self.spark, f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        self.files.drop(f"{self.root}/{name}")

    def listing(self, search: str = "", sort: str = "name", page: int = 1, per_page: int = 10, descending: bool = False) -> DataFrame:
        """(name, parent, version_hash, version, created, item_count), a page of it. Only the repositories of the page are counted, unless the count is the order."""
        if sort not in self.COLUMNS:
            raise ValueError(f"no column {sort}")
        tables = {n: self.open(n) for n in self.files.names(self.root) if self.exists(n) and search.lower() in n.lower()}
        rows = [{"name": n, "parent": t.schema.parent, "version_hash": t.schema.version_hash(), "version": t.version, "created": t.created()} for n, t in sorted(tables.items())]
        if sort == "item_count":
            rows = [r | {"item_count": tables[r["name"]].read().count()} for r in rows]
        rows.sort(key=lambda r: (r[sort] is not None, r[sort]) if r[sort] is not None else (False,), reverse=descending)
        rows = rows[(page - 1) * per_page : page * per_page]
        rows = [r if "item_count" in r else r | {"item_count": tables[r["name"]].read().count()} for r in rows]
        df = self.spark.createDataFrame([(i, *(r[c] for c in self.COLUMNS)) for i, r in enumerate(rows)], "place int, name string, parent string, version_hash string, version int, created long, item_count long")
        return df.orderBy("place").select(*self.COLUMNS[:4], F.timestamp_millis("created").alias("created"), "item_count")
