r"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: a text's ASCII letters are lower-cased, its words `[^\x20\x09-\x0D]+` make shingles of `width` words,
repeats included, joined by single spaces (fewer words: one shingle of all; none: fingerprint 0). A shingle's hash is
XXH64 of its UTF-8, seed 42; a bit of the fingerprint is 1 if it is set in over half of the hashes.

Tables: position i of the 64 gets a vector m(i) in {0,1}^(r+1), for radius r; each of the 2^(r+1) - 1 other vectors v
gives a mask of the positions with <m(i), v> = 1 (mod 2). At most r differing positions span at most r of the r + 1
dimensions, so some v is orthogonal to all of them, and in its table the two fingerprints agree: every pair within
the radius collides in some table. Nothing is left to chance.

Buckets: different fingerprints that agree in a table. One of at most `most` is searched whole, in blocks, and
gives a link from each of its components' members to the least member: as many links as members at most. A larger
one is dealt out again: the bits that its table doesn't fix are cut into r + 1 blocks, and a pair within the radius
agrees on one of them at least. That repeats until every bucket is small enough, which comes at the latest when so
few bits are free that no more than `most` fingerprints can differ in them. No pair within the radius is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, settle, shuffle_partitions, texts
from .components import components

BITS, RADIUS, WIDTH, SEED = 64, 4, 4, 42
#: Fingerprints of a bucket that one task holds and searches.
MOST = 4096
#: Shingles whose bits are counted at once.
BLOCK = 1 << 15


def shingles(text: str, width: int = WIDTH) -> list[bytes]:
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined] if words else []
    ends = list(accumulate(map(len, words), lambda at, n: at + n + 1))
    starts = [0, *(e + 1 for e in ends)]
    return [joined[s:e] for s, e in zip(starts, ends[width - 1 :])]


def majority(hashes: np.ndarray) -> int:
    """The bits that over half of the hashes (unsigned, 64 bits) have."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), BLOCK):
        block = np.ascontiguousarray(hashes[i : i + BLOCK])
        ones += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def shingle_hashes(text: str, width: int = WIDTH, seed: int = SEED) -> np.ndarray:
    parts = shingles(text, width)
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(seed)), np.uint64, len(parts))


def fingerprint(text: str, width: int = WIDTH, seed: int = SEED) -> int:
    return majority(shingle_hashes(text, width, seed))


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """doc_id, fp: the fingerprint, as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t.as_py(), width, seed) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(run, "doc_id long, fp long")


def masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The masks of the covering tables. The vectors m(i) are dealt out evenly, so that masks are of about equal weight."""
    vectors = [1 + i % (2 ** (radius + 1) - 1) for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(fixed: int, radius: int, bits: int = BITS) -> list[int]:
    """The bits that a mask leaves free in radius + 1 blocks; each with the fixed bits, as masks."""
    free = [i for i in range(bits) if not fixed >> i & 1]
    return [fixed | sum(1 << i for i in free[j :: radius + 1]) for j in range(radius + 1)]


def _groups(masked: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal (table, key) in sorted rows, and the end."""
    new = np.flatnonzero((masked[1:] != masked[:-1]) | (table[1:] != table[:-1])) + 1
    return np.concatenate([[0], new, [len(masked)]])


def local_links(fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of the components among the fingerprints (unsigned, different): each member to the least by signed order."""
    left, a, b = fps, [], []
    while len(left):
        members, frontier = [left[:1]], left[:1]
        left = left[1:]
        while len(frontier) and len(left):
            reached = np.zeros(len(left), bool)
            if len(frontier) * 8 < len(left) or len(frontier) == 1:
                for f in frontier:
                    reached |= np.bitwise_count(left ^ f) <= radius
            else:
                for i, f in enumerate(left):
                    reached[i] = bool((np.bitwise_count(frontier ^ f) <= radius).any())
            frontier, left = left[reached], left[~reached]
            members.append(frontier)
        if len(members) > 1:
            all_ = np.concatenate(members).view(np.int64)
            root = all_.min()
            all_ = all_[all_ != root]
            a.append(all_)
            b.append(np.full(len(all_), root))
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def searcher(radius: int, most: int):
    """Over rows (mask, key, fp) sorted by the first two: links (a, b) of small buckets, (mask, fp) of larger ones."""

    def bucket(fps: np.ndarray):
        if len(fps) == 2:
            close = np.bitwise_count(fps[0] ^ fps[1]) <= radius
            s = np.sort(fps.view(np.int64))
            return (s[1:], s[:1]) if close else (s[:0], s[:0])
        return local_links(fps, radius)

    def out(a: np.ndarray, b: np.ndarray, mask: int | None = None) -> pa.RecordBatch:
        marks = pa.nulls(len(a), pa.int64()) if mask is None else pa.array(np.full(len(a), mask, np.int64))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(np.broadcast_to(b, a.shape)), marks], ["a", "b", "mask"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key, over = [], None, False

        def close() -> Iterator[pa.RecordBatch]:
            """Ends the bucket that is held; one that was too large has gone already."""
            nonlocal held, over
            fps, held, over = (np.concatenate(held) if held else np.zeros(0, np.uint64)), [], False
            if len(fps) > 1:
                a, b = bucket(fps)
                if len(a):
                    yield out(a, b)

        for batch in batches:
            if not batch.num_rows:
                continue
            table, masked, fps = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("mask", "key", "fp"))
            fps = fps.view(np.uint64)
            starts = _groups(masked, table)
            sizes = np.diff(starts)
            # the first run may go on from the batch before, the last into the next
            inner = np.zeros(len(sizes), bool)
            inner[1:-1] = True
            pairs = np.flatnonzero(inner & (sizes == 2))
            if len(pairs):
                x, y = fps[starts[pairs]], fps[starts[pairs] + 1]
                near = np.bitwise_count(x ^ y) <= radius
                x, y = x[near].view(np.int64), y[near].view(np.int64)
                if len(x):
                    yield out(np.maximum(x, y), np.minimum(x, y))
            for g in [0, *np.flatnonzero(inner & (sizes > 2)), *([len(sizes) - 1] if len(sizes) > 1 else [])]:
                part, key = fps[starts[g] : starts[g + 1]], (int(table[starts[g]]), int(masked[starts[g]]))
                if held_key != key:
                    yield from close()
                    held_key = key
                held.append(part)
                if over or sum(map(len, held)) > most:
                    over = True
                    rows = np.concatenate(held).view(np.int64)
                    held = []
                    yield out(rows, rows, key[0])
        yield from close()

    return run


def spread(fps: DataFrame, masks_: Column) -> DataFrame:
    rows = fps.select("fp", F.explode(masks_).alias("mask"))
    return rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")


def near_links(fps: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """Links (a, b) among different fingerprints (column fp) that connect just those within the radius, directly or over others."""
    spark = fps.sparkSession
    parts, most = shuffle_partitions(spark), max(most, 2**radius)
    rows = spread(fps, F.array(*[F.lit(signed(m)).cast("long") for m in masks(radius)]))
    links = None
    while True:
        sorted_ = rows.repartition(parts, "mask", "key").sortWithinPartitions("mask", "key", "fp")
        found = settle(sorted_.mapInArrow(searcher(radius, most), "a long, b long, mask long"), "near-links")
        here = found.filter("mask is null").select("a", "b")
        links = here if links is None else links.unionByName(here)
        large = found.filter("mask is not null").select(F.col("a").alias("fp"), "mask")
        used = [r[0] for r in large.select("mask").distinct().collect()]  # at most radius + 1 times as many masks as before, in a few rounds
        if not used:
            return links.distinct()
        nexts = [(m, [signed(x) for x in block_masks(m % (1 << 64), radius)]) for m in used]
        deal = F.broadcast(spark.createDataFrame(nexts, "mask long, nexts array<long>"))
        rows = spread(large.join(deal, "mask"), F.col("nexts")).distinct()


def classes(rows: DataFrame, radius: int = RADIUS, most: int = MOST) -> DataFrame:
    """rows (doc_id, fp), a settled table -> the same with component_id: the least doc_id reached over fingerprints within the radius.

    Links are over fingerprints, each different one taken once, so copies cost nothing more.
    """
    own = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "different-fingerprints")
    roots = components(near_links(own.select("fp"), radius, most)).select(F.col("node").alias("fp"), "root")
    named = settle(own.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "fingerprint-roots")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("members"))
    of_fps = lookup(named.select("fp", "copies", "root"), ids, ["root"], "members", named.count())
    return lookup(rows, of_fps.select("fp", "copies", "component_id"), ["fp"], "copies", rows.count()).select("doc_id", "fp", "component_id")


def near_duplicates(docs: DataFrame, width: int = WIDTH, radius: int = RADIUS, most: int = MOST, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, fingerprint (16 hex digits), component_id (the least doc_id it reaches).

    Null text counts as empty. Rows that repeat a doc_id, with the same text or another, are rows each for itself. A null
    doc_id is never a component's id unless the component has no other.
    """
    out = classes(settle(fingerprints(docs, width, seed), "fingerprints"), radius, most)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
