"""Near-duplicate groups of documents: SimHash classes verified by word shingles, and every near pair that they miss.

Two documents are near if their sets of `width`-word shingles have a resemblance (Jaccard) of `similarity` or more, computed
from whole texts. What is connected by near pairs is a group, of which the row with the least doc_id stays.

1. Documents with the same shingle set are linked to the first of them, and that one goes on alone.
2. SimHash (simhash.classes: covering tables over fingerprints of the shingle sets) gives classes, whose members are held
   against the class's first one.
3. Fingerprints miss copies with blocks added or cut off. So every document gives a prefix of its shingles in the order of
   their hashes. Two near sets of a and b shingles share t = similarity * max(a, b) at least, so the first a - t + k of the one and
   b - t + k of the other have k in common (k = SHARE of the set and one more). A document of which fewer are in the prefix
   of any other has no near one. Of the few documents that are left all shingles are counted; one that shares fewer than t of them
   has no near one either. Of those t the t - 1 commonest go; a near pair still shares one. No near pair is lost, whatever the
   kind of edit.
4. In the bucket of a shingle each document is held against a few in the middle, whose shingles are the commonest, and against the next one
   in size, and where that leaves a bucket unconnected against a few others of it by chance, which connects nearly all that
   belongs together by about as many pairs as rows. Documents with fewer than t shingles
   in buckets that aren't connected go again. The pairs of a bucket whose documents aren't connected yet are then all held
   against each other, in blocks of `members` documents a side, so no task holds a large bucket.

Null text counts as empty; empty sets are the same set. A row is told by its doc_id and its text: rows that repeat both are one
document, a doc_id with several texts is several documents. Documents without doc_id take part and come last in order.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import simhash
from .common import TEXTS, by_hash, hold, keep_only, lookup, rows_a_batch, settle, shuffle_partitions, texts, without
from .components import components

WIDTH, SIMILARITY = 5, 0.8
#: Share of a set that two near ones have in common in the prefixes, besides one.
SHARE = 0.1
#: Documents of a bucket on one side of a block of pairs.
MEMBERS = 256
#: Rows of a bucket with which each one is held against first.
CENTRES = 6
#: Rows of a bucket with which a row that isn't connected to them is held against next.
TRIES = 6
#: Rows that show which prefix shingles are so common that one task should not get all rows of one; they are then dealt
#: to several, where one of them would have over 1 / HOT of a task's usual rows and HOT_LEAST.
SHOWN, HOT, HOT_LEAST = 4000, 4, 50_000
#: Pairs whose sets a worker holds at once.
BATCH = 500
SLACK = 1e-9


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The different shingles' hashes, as signed numbers that ascend."""
    return np.unique(simhash.shingle_hashes(text, width).view(np.int64))


def least_shared(n: int, similarity: float) -> int:
    return math.ceil(similarity * n - SLACK)


def prefix_length(n: int, similarity: float, share: float = SHARE) -> int:
    return min(n, n - least_shared(n, similarity) + int(share * n) + 1)


def heads(docs: DataFrame, width: int, similarity: float) -> DataFrame:
    """row (a number for each row), doc_id, h (of the text), n, digest (of the set), fp, keys (the prefix)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        hold("near_dedup", dict)
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            sizes, digests, fps, keys = [], [], [], []
            for t in b.column("text"):
                found = shingle_set(t.as_py(), width)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                fps.append(simhash.signed(simhash.majority(found.view(np.uint64))))
                keys.append(found[: prefix_length(len(found), similarity)].copy())
            ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            rows = pa.array(np.arange(row, row + b.num_rows))
            row += b.num_rows
            yield pa.RecordBatch.from_arrays([rows, b.column("doc_id"), b.column("h"), pa.array(sizes, pa.int32()), pa.array(digests, pa.binary()), pa.array(fps, pa.int64()), lists], ["row", "doc_id", "h", "n", "digest", "fp", "keys"])

    named = texts(docs).select("doc_id", F.xxhash64("text").alias("h"), "text")
    return named.mapInArrow(run, "row long, doc_id long, h long, n int, digest binary, fp long, keys array<long>")


def dealt(sets: DataFrame) -> DataFrame:
    """(key, row, n, salt, hot) of a settled table (row, n, keys). salt: 0, but for the commonest keys one of several, so that no task gets all of such a key."""
    rows, docs = sets.select(F.explode("keys").alias("key"), "row", "n"), sets.count()
    shown = by_hash(sets, ["row"], SHOWN).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("shown"))
    total = sets.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    usual = max(HOT_LEAST, total // (HOT * shuffle_partitions(rows.sparkSession)))
    scale = max(1.0, docs / SHOWN)
    hot = shown.filter(F.col("shown") * scale >= usual).select("key", F.ceil(F.col("shown") * scale / usual).cast("int").alias("salts"))
    # such keys have at least `usual` rows each, so there are HOT times as many as tasks at most, and a few that chance adds
    rows = rows.join(F.broadcast(hot), "key", "left")
    return rows.withColumn("salt", F.when(F.col("salts") > 1, F.pmod(F.xxhash64("row"), F.col("salts"))).otherwise(0).cast("int")).withColumn("hot", F.col("salts").isNotNull()).drop("salts")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, salt) those that aren't alone; those of hot keys never count as alone."""
    names, last = ["key", "row", "n"], None  # the row before: its place in the order, itself, whether it has gone out
    for b in batches:
        if not b.num_rows:
            continue
        key, salt, hot = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "hot"))
        again = np.empty(len(key), bool)
        again[0] = last is not None and last[0] == (key[0], salt[0])
        again[1:] = (key[1:] == key[:-1]) & (salt[1:] == salt[:-1])
        out = again | hot
        out[:-1] |= again[1:]
        own = b.select(names)
        if again[0] and not last[2]:
            yield last[1]
        if out.any():
            yield own.filter(pa.array(out))
        last = ((key[-1], salt[-1]), own.slice(b.num_rows - 1), bool(out[-1]))


def in_prefix(similarity: float) -> Column:
    """Keys that a row's prefix shares with a near row's at least: k for the lesser of the two, as their sizes differ by the similarity at most."""
    return F.floor(F.lit(SHARE) * F.ceil(F.lit(similarity) * F.col("n") - SLACK)) + 1


def in_all(similarity: float) -> Column:
    return F.ceil(F.lit(similarity) * F.col("n") - SLACK)


def sharing(sets: DataFrame, need: Column, name: str) -> DataFrame:
    """(key, row, n) of the keys that several rows of a settled table (row, n, keys) have, without rows that have fewer such keys than they need."""
    sorted_ = dealt(sets).repartition(shuffle_partitions(sets.sparkSession), "key", "salt").sortWithinPartitions("key", "salt")
    found = settle(sorted_.mapInArrow(_shared, "key long, row long, n int"), f"shared-{name}")
    some = settle(found.groupBy("row", "n").agg(F.count(F.lit(1)).alias("have")).filter(F.col("have") >= need).select("row"), f"{name}-rows")
    return settle(keep_only(found, some, ["row"]), name)


def sized(rows: DataFrame) -> DataFrame:
    """rows (key, row, n) of keys that are still of several rows, with size: the rows of the key."""
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return settle(lookup(rows, sizes, ["key"], "size", rows.count()).filter("size is not null"), "buckets")


def rarest(rows: DataFrame, similarity: float) -> DataFrame:
    """rows (key, row, n, size) without each row's need - 1 commonest keys, and without rows that have fewer; a near pair still shares one.

    left: the row's keys from this one on, in the order of rarity; centre: how common its keys are."""
    rare, own = Window.partitionBy("row").orderBy("size", "key"), Window.partitionBy("row")  # a row has a prefix of keys at most
    rows = rows.withColumn("nth", F.row_number().over(rare)).withColumn("have", F.count(F.lit(1)).over(own)).withColumn("centre", F.avg("size").over(own)).withColumn("left", F.col("have") - F.col("nth") + 1)
    return rows.filter(F.col("nth") <= F.col("have") - in_all(similarity) + 1).drop("nth", "have")


def _beside(rows: DataFrame, similarity: float, members: int) -> DataFrame:
    """Pairs (a, b): each row with those of its part of a bucket whose keys are the commonest, among those of about its size; with the next one in
    size; and the first such centres of a bucket's parts with one of them."""
    rows = rows.withColumn("part", F.when(F.col("size") > members, F.pmod(F.xxhash64("row"), F.ceil(F.col("size") / members))).otherwise(0).cast("int"))
    rows = rows.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(similarity))).cast("int") if similarity < 1 else F.col("n"))
    after = Window.partitionBy("key", "part").orderBy("n", "row")  # about `members` rows
    middle = Window.partitionBy("key", "part", "band").orderBy(F.desc("centre"), "row").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    centres = F.array(*[F.nth_value("row", i + 1).over(middle) for i in range(CENTRES)])
    rows = rows.select("key", "part", "band", "row", "n", F.lag("row").over(after).alias("before"), F.lag("n").over(after).alias("m"), centres.alias("centres"))
    firsts = rows.filter(F.col("row") == F.get("centres", F.lit(0))).select("key", "band", "row")
    parts = firsts.join(firsts.groupBy("key", "band").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("parts")).filter("parts > 1"), ["key", "band"])
    beside = rows.filter(F.col("m") >= similarity * F.col("n") - SLACK).select(F.col("before").alias("a"), F.col("row").alias("b"))
    return beside.unionByName(rows.select(F.explode("centres").alias("a"), F.col("row").alias("b")).filter("a is not null")).unionByName(parts.select(F.col("first").alias("a"), F.col("row").alias("b")))


def _may_be_near(n: str, left: str, m: str, other: str, similarity: float) -> Column:
    """Whether sizes n and m fit, and what the rows have left from their first shared key on may be enough."""
    fits = F.least(n, m) >= similarity * F.greatest(n, m) - SLACK
    return fits & (F.least(left, other) >= similarity / (1 + similarity) * (F.col(n) + F.col(m)) - SLACK)


def _across(rows: DataFrame, similarity: float, members: int) -> DataFrame:
    """Pairs (a, b) of open rows with different roots: each with the TRIES before it in a shuffled order of its part of a bucket."""
    rows = rows.withColumn("part", F.when(F.col("size") > members, F.pmod(F.xxhash64("row", "key"), F.ceil(F.col("size") / members))).otherwise(0).cast("int"))
    order = Window.partitionBy("key", "part").orderBy(F.xxhash64("row", "key", F.lit(1)), "row")
    before = F.array(*[F.lag(F.struct(F.col("row").alias("a"), F.col("n").alias("m"), F.col("left").alias("other"), F.col("root").alias("r")), i + 1).over(order) for i in range(TRIES)])
    pairs = rows.withColumn("before", before).select("row", "n", "left", "root", F.explode("before").alias("x")).select(F.col("row").alias("b"), "n", "left", "root", "x.*")
    return pairs.filter((F.col("root") != F.col("r")) & _may_be_near("n", "left", "m", "other", similarity)).select("a", "b")


def _crossed(similarity: float):
    """Over rows sorted by (key, lo, hi): pairs (a, b) of a block whose rows have different roots, and sizes and keys left to be near.

    If this key is the first that a pair shares, it shares no more than either has left.
    """

    def pairs(rows: list[np.ndarray], lo: int, hi: int) -> tuple[list, list]:
        n, left, ids, root, block = rows
        order, a, b = np.argsort(n, kind="stable"), [], []
        n, left, ids, root, block = n[order], left[order], ids[order], root[order], block[order]
        ends = np.searchsorted(n, np.floor(n / similarity + SLACK), "right")
        for i in range(len(n)):
            span = slice(i + 1, ends[i])
            ok = (root[span] != root[i]) & (np.minimum(left[span], left[i]) >= similarity / (1 + similarity) * (n[span] + n[i]) - SLACK)
            if lo != hi:
                ok &= block[span] != block[i]
            found = ids[span][ok]
            if len(found):
                a.append(np.minimum(found, ids[i]))
                b.append(np.maximum(found, ids[i]))
        return a, b

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, held_key = [], None

        def close() -> Iterator[pa.RecordBatch]:
            if held:
                a, b = pairs([np.concatenate(c) for c in zip(*held)], *held_key[1:])
                held.clear()
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key, lo, hi, *rest = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "lo", "hi", "n", "left", "row", "root", "block"))
            new = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for s, e in zip([0, *new.tolist()], [*new.tolist(), len(key)]):
                here = (int(key[s]), int(lo[s]), int(hi[s]))
                if here != held_key:
                    yield from close()
                    held_key = here
                held.append([c[s:e] for c in rest])
        yield from close()

    return run


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the settled pairs (a, b) whose sets (row, n, keys) are near."""
    both = pairs.join(sets.select(F.col("row").alias("b"), F.col("keys").alias("second")), "b").join(sets.select(F.col("row").alias("a"), F.col("keys").alias("first")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for c in ("first", "second"):
                lists = batch.column(c)
                ends.append((lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()))
            keep = np.zeros(batch.num_rows, bool)
            (x, xs), (y, ys) = ends
            for i in range(batch.num_rows):
                a, b = x[xs[i] : xs[i + 1]], y[ys[i] : ys[i + 1]]
                if min(len(a), len(b)) >= similarity * max(len(a), len(b)) - SLACK:
                    shared = len(np.intersect1d(a, b, assume_unique=True))
                    keep[i] = shared >= similarity * (len(a) + len(b) - shared) - SLACK
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(pa.array(keep)) for c in ("a", "b")], ["a", "b"])

    with rows_a_batch(pairs.sparkSession, BATCH):
        return settle(both.mapInArrow(run, "a long, b long"), "near-pairs")


def _stars(roots: DataFrame) -> DataFrame:
    """Links (a, b) from the roots to the others: few steps connect what later links join."""
    return roots.filter("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))


def _open(rows: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """The rows of buckets of several roots (node, root), with their roots; size: rows that are left of the key.

    A near pair that isn't connected shares its keys in such buckets only, so rows with too few of them go.
    """
    rows = settle(rows.drop("size").join(roots.withColumnRenamed("node", "row"), "row", "left").withColumn("root", F.coalesce("root", "row")), "bucket-roots")
    open_ = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key", "size")
    rows = lookup(rows.drop("size"), open_, ["key"], "size", rows.count()).filter("size is not null")
    rows = rows.withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("row"))).filter(F.col("have") >= in_all(similarity)).drop("have")
    return settle(rows, "open-rows")


def links(docs: DataFrame, heads_: DataFrame, width: int, similarity: float, members: int) -> DataFrame:
    """Links (a, b) of rows that connect just what all near pairs connect. docs: those of the heads, a settled table."""
    first = settle(heads_.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "same-sets")
    same = lookup(heads_.select("row", "digest"), first, ["digest"], "copies", heads_.count()).filter(F.col("first") != F.col("row"))
    same = settle(same.select(F.col("first").alias("a"), F.col("row").alias("b")), "same-pairs")
    alone = without(heads_, same.select(F.col("b").alias("row")), ["row"])

    ids = settle(sharing(alone.select("row", "n", "keys"), in_prefix(similarity), "prefixes").select("row").distinct(), "prefix-rows")
    with rows_a_batch(docs.sparkSession, TEXTS):
        sets = settle(_sets(docs, keep_only(heads_.select("row", "doc_id", "h"), ids, ["row"]), width), "sets")
    found = sized(sharing(sets, in_all(similarity), "keys"))

    classes = simhash.classes(settle(alone.select(F.col("row").alias("doc_id"), "fp"), "fingerprints"))
    near_fps = classes.filter("doc_id <> component_id").select(F.col("component_id").alias("a"), F.col("doc_id").alias("b"))
    pairs = settle(_ordered(near_fps.unionByName(_beside(rarest(found, similarity), similarity, members))), "pairs")
    roots = components(verified(pairs, sets, similarity))
    open_ = _open(found, roots, similarity)
    more = _ordered(_across(rarest(open_, similarity), similarity, members))
    more = settle(more.join(pairs, ["a", "b"], "left_anti"), "pairs")
    roots = components(_stars(roots).unionByName(verified(more, sets, similarity)))
    left = rarest(_open(open_.drop("root"), roots, similarity), similarity).withColumn("blocks", F.ceil(F.col("size") / members).cast("int"))
    left = left.withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int"))
    left = left.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    left = left.select("key", F.least("block", "with").alias("lo"), F.greatest("block", "with").alias("hi"), "n", "left", "row", "root", "block")
    sorted_ = left.repartition(shuffle_partitions(docs.sparkSession), "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    rest = _ordered(sorted_.mapInArrow(_crossed(similarity), "a long, b long"))
    rest = settle(rest.join(pairs.unionByName(more), ["a", "b"], "left_anti"), "pairs")
    return same.unionByName(_stars(roots)).unionByName(verified(rest, sets, similarity))


def _sets(docs: DataFrame, names: DataFrame, width: int) -> DataFrame:
    """(row, n, keys) of the rows named by (row, doc_id, h); keys: all their shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_set(t.as_py(), width) for t in b.column("text")]
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *found])))
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(np.diff(ends), pa.int32()), lists], ["row", "n", "keys"])

    rows = texts(docs).withColumn("h", F.xxhash64("text"))
    keys = names.groupBy("doc_id", "h").agg(F.min("row").alias("row"))
    # rows that are one document have one set, so one of them goes on only
    picked = keep_only(rows, keys, ["doc_id", "h"], "row").dropDuplicates(["row"]).select("row", "text")
    return picked.mapInArrow(run, "row long, n int, keys array<long>")


def _name(doc_id: str = "doc_id", h: str = "h") -> Column:
    return F.struct(F.col(doc_id).isNull().alias("unnamed"), F.col(doc_id).alias("doc_id"), F.col(h).alias("h"))


def groups(docs: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, members: int = MEMBERS) -> DataFrame:
    """(doc_id, h, root, root_h) of every document in a group of several: h is xxhash64 of its text; root and root_h tell the one that stays."""
    docs = texts(docs)
    with rows_a_batch(docs.sparkSession, TEXTS):
        heads_ = settle(heads(docs, width, similarity), "heads")
    found = settle(components(links(docs, heads_, width, similarity, members)).select(F.col("node").alias("row"), "root"), "group-rows")
    named = settle(keep_only(heads_.select("row", "doc_id", "h"), found, ["row"], "root"), "group-names")
    least = named.groupBy("root").agg(F.min(_name()).alias("least"), F.count(F.lit(1)).alias("rows"))
    out = lookup(named, least, ["root"], "rows", named.count())
    return out.select("doc_id", "h", F.col("least.doc_id").alias("root"), F.col("least.h").alias("root_h")).distinct()


def survivors(docs: DataFrame, **how) -> DataFrame:
    """The rows of docs that are in no group or stay for theirs, with all their columns. Rows that repeat doc_id and text stay or go together."""
    gone = settle(groups(docs, **how).filter(~(F.col("doc_id").eqNullSafe(F.col("root")) & (F.col("h") == F.col("root_h")))).select(F.col("doc_id").alias("__gone_id"), F.col("h").alias("__gone_h")), "gone")
    rows = docs.withColumn("__gone_id", F.col("doc_id").cast("long")).withColumn("__gone_h", F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return without(rows, gone, ["__gone_id", "__gone_h"]).drop("__gone_id", "__gone_h")
