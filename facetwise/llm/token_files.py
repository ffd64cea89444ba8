"""Token ids as binary files: a concatenated id array, and where its documents begin as Elias-Fano lists.

Documents are written in ascending doc_id order (no doc_id first; equal ones by the hash of their text). A file
holds a stretch of them:

    magic "TOKF", version, bytes of an id (2 or 4), number of documents, of those without doc_id, of ids,
    ids of all documents before in the same partition, least doc_id, length of the two lists
    list of doc_id minus the least | list of the documents' ends in the id array | the ids, little-endian

Files are named by partition and number; a task writes each under a name of its own and then renames it, so a
repeated task leaves the same files. They go to the shared folder over pyarrow's file systems, and are read back by Spark.

A document is found by select on the two lists; no table of offsets is made. Null text counts as empty: its document is the
end id alone. Rows that repeat a doc_id are documents each for itself. An empty table gives no files and no rows.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_path, shuffle_partitions, texts
from .elias_fano import EliasFano, build
from .tokens import library

TOKENIZER, END = "byte_bpe_50k.json", 2
#: Ids of a file before the next is begun.
FILE_IDS = 1 << 22
#: Documents that are read before their rows go out.
READ = 4096
_HEAD = struct.Struct("<4sBBQQQQqQQ")


def pack_file(doc_ids: list[int | None], ids: list[bytes], before: int, width: int) -> bytes:
    """ids: of each document, as little-endian unsigned 32-bit integers; doc_ids ascend, None first."""
    ends = np.cumsum([len(x) // 4 for x in ids]).astype(np.uint64)
    known = [d for d in doc_ids if d is not None]
    least = known[0] if known else 0
    names = build(np.array([d - least for d in known], np.uint64))
    bounds = build(ends)
    array = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    return _HEAD.pack(b"TOKF", 1, width, len(ids), len(ids) - len(known), len(array), before, least, len(names), len(bounds)) + names + bounds + array.tobytes()


class TokenFile:
    def __init__(self, data: bytes):
        data = memoryview(data).cast("B")
        magic, version, self.width, self.n, self.unnamed, self.n_ids, self.before, self.least, names, bounds = _HEAD.unpack_from(data)
        if magic != b"TOKF" or version != 1:
            raise ValueError("not a token file")
        at = _HEAD.size
        self.names, self.ends = EliasFano(data[at : at + names]), EliasFano(data[at + names : at + names + bounds])
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, at + names + bounds)

    def doc_id(self, i: int) -> int | None:
        return None if i < self.unnamed else self.least + self.names.select(i - self.unnamed)

    def span(self, i: int) -> tuple[int, int]:
        """First and last but one place of the i-th document in the id array."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def document(self, i: int) -> np.ndarray:
        lo, hi = self.span(i)
        return self.ids[lo:hi]


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end: int = END, file_ids: int = FILE_IDS, parts: int | None = None) -> list[tuple[int, int]]:
    """Write the documents' ids under path; (partition, number of its ids) for each partition that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), library(tokenizer, True)
        width = 2 if max(encoder.size, end + 1) <= 1 << 16 else 4
        tool, folder = fs.FileSystem.from_uri(path)
        tail = np.array([end], "<u4").tobytes()
        names, ids, held, done, number = [], [], 0, 0, 0

        def put() -> None:
            nonlocal names, ids, held, done, number
            to = f"{folder}/part-{part:08d}-{number:06d}.tok"
            tool.create_dir(folder, recursive=True)
            with tool.open_output_stream(own := f"{folder}/.{uuid.uuid4().hex}.tmp") as f:
                f.write(pack_file(names, ids, done, width))
            tool.move(own, to)
            names, ids, done, held, number = [], [], done + held, 0, number + 1

        for b in batches:
            names_here = b.column("doc_id").to_pylist()
            for name, raw in zip(names_here, map(encoder.ids, b.column("text").to_pylist())):
                names.append(name)
                ids.append(raw + tail)
                held += len(raw) // 4 + 1
                if held >= file_ids:
                    put()
        if ids:
            put()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([done], pa.int64())], ["part", "ids"])

    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    ordered = rows.repartitionByRange(parts or shuffle_partitions(docs.sparkSession), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    return sorted(tuple(r) for r in ordered.select("doc_id", "text").mapInArrow(run, "part long, ids long").collect())


def read(spark, path: str, sizes: list[tuple[int, int]]) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32. sizes: as write() gave them."""
    starts, total = {}, 0
    for part, n in sizes:
        starts[part], total = total, total + n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                file = TokenFile(content.as_buffer())
                base, at = starts[int(name.rpartition("/part-")[2].split("-")[0])] + file.before, 0
                for first in range(0, file.n, READ):
                    found = []
                    for i in range(first, min(file.n, first + READ)):
                        end = file.ends.select(i)
                        found.append((file.doc_id(i), base + at, end - at, zlib.crc32(file.ids[at:end].astype("<u4"))))
                        at = end
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not sizes:
        return spark.createDataFrame([], T._parse_datatype_string(out))
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(path).select("path", "content").mapInArrow(run, out)


def write_and_read(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, file_ids: int = FILE_IDS) -> DataFrame:
    """Write all documents, read the files back: doc_id, start, n_tokens, ids_crc32."""
    path = fresh_path(docs.sparkSession, "token-files")
    return read(docs.sparkSession, path, write(docs, path, tokenizer, end, file_ids))
