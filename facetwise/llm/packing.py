"""Packing of tokenized documents into sequences, by cutting-stock column generation.

A document of T ids gives floor(T / capacity) pieces that fill a sequence each, and a rest. The rests' lengths, in
units of GRAIN ids, make a histogram of capacity / GRAIN classes, whatever the corpus; cutting_stock finds the
patterns over it, and which rests to cut, at multiples of STEP units. Documents are then ranked within their class,
by counts of hash buckets and an order inside each, so that no class goes to one task; a rank says which sequence of
which pattern takes the piece, or how it is cut. Padding comes from the units (less than GRAIN ids a piece) and
from the last few sequences.

Text moves nowhere: tokenizing gives lengths and checksums, and only those are shuffled; checksums of the blocks
of a rest give that of any part. Null text counts as empty; such a document is its end id. Rows that repeat a
doc_id are packed each for itself.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, rows_a_batch, settle, texts
from .cutting_stock import solve
from .tokens import library

TOKENIZER, END, CAPACITY, GRAIN, STEP = "word_bpe_49k.json", 1, 2048, 4, 4
#: Rows of a hash bucket, on average over all classes, within which pieces are ranked.
BUCKET = 5_000


def tokenized(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """row (a number for each row), doc_id, doc_tokens, crcs: the checksum of each stretch of capacity ids and of the rest; blocks: those of the rest's blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        encoder, tail, long, short = library(tokenizer, False), np.array([end], "<u4").tobytes(), 4 * capacity, 4 * GRAIN * STEP
        for b in batches:
            n, crcs, blocks = [], [], []
            for raw in (encoder.ids(t.as_py()) for t in b.column("text")):
                view = memoryview(raw + tail)
                n.append(len(view) // 4)
                crcs.append([zlib.crc32(view[i : i + long]) for i in range(0, len(view), long)])
                blocks.append(struct.pack(f"<{-(-(len(view) % long) // short)}I", *[zlib.crc32(view[i : i + short]) for i in range(len(view) // long * long, len(view), short)]))
            rows = pa.array(np.arange(row, row + len(n)))
            row += len(n)
            yield pa.RecordBatch.from_arrays([rows, b.column("doc_id"), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64())), pa.array(blocks, pa.binary())], ["row", "doc_id", "doc_tokens", "crcs", "blocks"])

    return texts(docs).mapInArrow(run, "row long, doc_id long, doc_tokens long, crcs array<long>, blocks binary")


def joined_crc(blocks: bytes, first: int, length: int) -> int:
    """crc32 of `length` ids from block `first` on, from the blocks' own."""
    size, crc = 4 * GRAIN * STEP, 0
    for i in range(-(-4 * length // size)):
        zeros = bytes(min(size, 4 * length - i * size))
        crc = zlib.crc32(zeros, crc) ^ zlib.crc32(zeros) ^ struct.unpack_from("<I", blocks, 4 * (first + i))[0]
    return crc


def ranked(pieces: DataFrame, total: int) -> DataFrame:
    """pieces with rank: 0, 1, ... within each class, without a task that sees a whole class."""
    buckets = max(1, -(-total // BUCKET))
    rows = pieces.withColumn("bucket", F.pmod(F.xxhash64("row", "start"), F.lit(buckets)))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = rows.groupBy("class", "bucket").agg(F.count(F.lit(1)).alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = Window.partitionBy("class", "bucket").orderBy("row", "start")
    rows = rows.withColumn("nth", F.row_number().over(inside)).join(base, ["class", "bucket"])
    return rows.withColumn("rank", F.col("base") + F.col("nth") - 1).drop("bucket", "base", "nth")


def plan(histogram: dict[int, int], capacity: int) -> tuple[np.ndarray, ...]:
    """Stretches of ranks, sorted by key, class << 44 | first rank. What becomes of them:

    pieces of the class in a sequence, first sequence, first slot; or 0, units cut off, first ranks of the two parts in
    their classes. A class has its own pieces first, then the parts in the order of the longer classes' stretches.
    """
    cuts, bins = solve({c: n for c, n in histogram.items() if c and n}, capacity, STEP)
    ends, taken, rows, sequence = Counter(histogram), Counter(), [(0, 1, 0, 0, 0)], 0
    for (c, off), n in sorted(cuts.items(), reverse=True):
        first = []
        for part in (off, c - off):
            first.append(ends[part])
            ends[part] += n
        rows.append((c << 44 | taken[c], 0, off, *first))
        taken[c] += n
    sequence = histogram.get(0, 0)  # class 0: pieces that fill a sequence
    for pattern, n in bins:
        slot = 0
        for c, k in sorted(pattern.items(), reverse=True):
            rows.append((c << 44 | taken[c], k, sequence, slot, 0))
            taken[c] += n * k
            slot += k
        sequence += n
    return tuple(np.array(x, np.int64) for x in zip(*sorted(rows)))


def assign(pieces: DataFrame, stretches: tuple[np.ndarray, ...]) -> DataFrame:
    """The pieces, cut where the plan says so, with sequence_id and slot. The stretches' number depends on that of the classes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fold, second, third, fourth = stretches
        for b in batches:
            cls, rank, whole = (b.column(c).to_numpy() for c in ("class", "rank", "length"))
            row, skip, length, uncut = np.arange(len(cls)), np.zeros(len(cls), np.int64), whole, np.ones(len(cls), bool)
            while len(row):
                i = np.searchsorted(keys, cls << 44 | rank, "right") - 1
                k = (cls << 44 | rank) - keys[i]
                put = fold[i] > 0
                if put.any():
                    r, s, n, j, m = row[put], skip[put], length[put], i[put], k[put]
                    crc = b.column("ids_crc32").to_numpy()[r].copy()
                    for x in np.flatnonzero(~uncut[put]):
                        crc[x] = joined_crc(b.column("blocks")[int(r[x])].as_py(), int(s[x]) // (GRAIN * STEP), int(n[x]))
                    own = b.take(pa.array(r))
                    yield pa.RecordBatch.from_arrays(
                        [own.column("doc_id"), pa.array(own.column("start").to_numpy() + s), pa.array(n), pa.array(crc), own.column("doc_tokens"), pa.array(second[j] + m // fold[j]), pa.array(third[j] + m % fold[j])],
                        ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"],
                    )
                r, s, n, c, j, m = (x[~put] for x in (row, skip, length, cls, i, k))
                off = second[j]
                row, skip = np.concatenate([r, r]), np.concatenate([s, s + off * GRAIN])
                length, cls = np.concatenate([off * GRAIN, n - off * GRAIN]), np.concatenate([off, c - off])
                rank, uncut = np.concatenate([third[j] + m, fourth[j] + m]), np.zeros(len(row), bool)

    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "slot"]
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "rank", "blocks").mapInArrow(run, ", ".join(f"{n} long" for n in out))


def pack(docs: DataFrame, tokenizer: str = TOKENIZER, end: int = END, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    if capacity % (GRAIN * STEP):
        raise ValueError(f"capacity is a multiple of {GRAIN * STEP}")
    with rows_a_batch(docs.sparkSession, TEXTS):
        done = settle(tokenized(docs, tokenizer, end, capacity), "tokenized")
    rows = done.select("row", "doc_id", "doc_tokens", "blocks", F.posexplode("crcs").alias("pos", "ids_crc32"))
    rows = rows.withColumn("start", F.col("pos").cast("long") * capacity)
    rows = rows.withColumn("length", F.least(F.lit(capacity).cast("long"), F.col("doc_tokens") - F.col("start")))
    full = F.col("length") == capacity
    rows = rows.withColumn("class", F.when(full, F.lit(0)).otherwise(F.ceil(F.col("length") / GRAIN)).cast("long"))
    rows = rows.withColumn("blocks", F.when(~full, F.col("blocks"))).drop("pos")
    counts = rows.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()  # at most capacity / GRAIN + 1 rows
    histogram = {int(r["class"]): int(r["n"]) for r in counts}
    placed = assign(ranked(rows, sum(histogram.values())), plan(histogram, capacity // GRAIN))
    before = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
