"""Whole results as files, and files as a stream of rows."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_pool = ThreadPoolExecutor(4)
FORMATS = ("parquet", "json", "orc", "csv", "xml")


def flat(df: DataFrame) -> DataFrame:
    """Lists and points as JSON text, for formats without nesting."""
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if f.dataType.typeName() in ("array", "struct") else F.col(f"`{f.name}`") for f in df.schema.fields])


def export(df: DataFrame, path: str, kind: str = "parquet", compression: str | None = None) -> None:
    """The rows under path, compressed."""
    if kind not in FORMATS:
        raise ValueError(f"no format {kind}")
    out = (flat(df) if kind == "csv" else df).write.mode("overwrite")
    if kind == "csv":
        out = out.option("header", True)
    if kind == "xml":
        out = out.option("rowTag", "item").option("rootTag", "items")
    if kind in ("json", "csv", "xml"):
        out = out.option("compression", compression or "gzip")
    out.format(kind).save(path)


def export_async(df: DataFrame, path: str, kind: str = "parquet") -> Future:
    """export() on a thread; the handle tells whether it is done."""
    return _pool.submit(export, df, path, kind)


def read(spark: SparkSession, path: str, schema, kind: str = "parquet") -> DataFrame:
    source = spark.read.schema(schema)
    if kind == "csv":
        source = source.option("header", True)
    if kind == "xml":
        source = source.option("rowTag", "item")
    return source.format(kind).load(path)


def items(df: DataFrame, size: int) -> Iterator[list]:
    """The rows, so many at a time; one partition is fetched after another."""
    held = []
    for row in df.toLocalIterator(prefetchPartitions=True):
        held.append(row)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held
