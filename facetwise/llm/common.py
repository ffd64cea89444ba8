"""What the training-data operators share: tables in the shared folder, lookups that survive hot keys."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key with at least this share of all rows is hot; so at most HOT_KEYS keys are.
HOT_KEYS = 256
#: Rows of at most three numbers that may be broadcast.
FEW = 500_000
#: Smaller groups are never treated as hot.
HOT_LEAST = 1000
#: Rows with their texts that a worker gets at once, and that it makes an Arrow array of at once.
TEXTS = 1000

_own: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one of our own if all runs in one process; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="facetwise-")
        found = _own[app]
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: lineage ends there, a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> None:
    """Delete what this application's operators have written to the shared folder; their results can't be read any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def texts(docs: DataFrame, *others: str) -> DataFrame:
    """doc_id and text (null text: empty) with the columns named, so that all others can have any name."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *others)


def held_out(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds, is 0. A null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def is_held_out(doc_id: int | None, folds: int) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % folds == 0


def lookup(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int) -> DataFrame:
    """rows left-joined to groups (one row for each key; `size` counts its rows) without a hot task.

    Groups with at least total / HOT_KEYS rows are at most HOT_KEYS in number whatever the data, so they
    are broadcast; the others have a bounded number of rows each and take the shuffle join.
    """
    least = max(HOT_LEAST, total // HOT_KEYS)
    hot, cold = groups.filter(F.col(size) >= least), groups.filter(F.col(size) < least)
    # keys of rows are never null here
    by_hot = rows.join(F.broadcast(hot), keys, "inner")
    by_cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(cold, keys, "left")
    return by_hot.unionByName(by_cold)


def few(keys: DataFrame) -> bool:
    """Whether keys, of a few numbers a row, has so few rows that it may be broadcast."""
    return keys.count() <= FEW


def _on(rows: DataFrame, keys: DataFrame, names: list[str], how: str) -> DataFrame:
    """rows joined with keys by names, nulls being equal, by a broadcast of few keys and otherwise by a shuffle. Of an inner join the key columns are those of rows."""
    other = keys.select(*[F.col(c).alias(f"__{c}") if c in names else F.col(c) for c in keys.columns])
    same = None
    for c in names:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    out = rows.join(F.broadcast(other) if few(keys) else other, same, how)
    return out.drop(*[f"__{c}" for c in names]) if how == "inner" else out


def keep_only(rows: DataFrame, keys: DataFrame, names: list[str], *columns: str) -> DataFrame:
    """The rows whose names are in keys, a settled table with each once; with those columns of keys."""
    if columns:
        return _on(rows, keys.select(*names, *columns), names, "inner")
    return _on(rows, keys.select(*names), names, "left_semi")


def without(rows: DataFrame, keys: DataFrame, names: list[str]) -> DataFrame:
    """The rows whose names aren't in keys, a settled table."""
    return _on(rows, keys.select(*names), names, "left_anti")


_holder: list[tuple[str, Callable[[], None]]] = []


def hold(owner: str, drop: Callable[[], None]) -> None:
    """Say in a worker that owner's memo is in use; that of the operator before is dropped, as workers outlive stages."""
    if _holder and _holder[0][0] != owner:
        _holder[0][1]()
        give_back()
    _holder[:] = [(owner, drop)]


def give_back() -> None:
    """Memory that this process has freed goes back to the system, where the allocators have kept it."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not of glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_by_text(make: Callable, texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """make of each text (None of null) as an array; never all of them as objects of Python."""
    parts = [pa.array([make(t.as_py()) for t in texts.slice(i, TEXTS)], kind) for i in range(0, len(texts), TEXTS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


@contextlib.contextmanager
def rows_a_batch(spark: SparkSession, n: int):
    """What runs inside sends so many rows at once to Python at most: for rows that hold much."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, min(n, int(before)) if int(before) > 0 else n)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_hash(rows: DataFrame, keys: list[str], want: int) -> DataFrame:
    """About `want` different keys and a few more, those with the least hashes, by a threshold: for rows, all that have such keys.

    A sort with a limit would send as many rows from every task to the driver.
    """
    h, span = F.xxhash64(*keys), 1 << 40
    there = rows.agg(F.approx_count_distinct(h, 0.02)).first()[0]
    most = span if there <= want else int(span * (1.2 * want + 40) / there)
    return rows.filter(F.pmod(h, F.lit(span)) < F.lit(most))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
