r"""Document fingerprints: bottom-k sketches of word shingles, in DataFrame functions only.

A sketch is the ascending array of the k smallest different shingle hashes of a text (all of them if there are
fewer). The sketch of a text in parts is merge() of the parts' sketches, as long as the parts share the words
that a shingle over the seam needs. From two sketches come the estimated resemblance (Jaccard), containment
and the number of different shingles; they are exact while neither sketch is full.

Words are `[^\x20\x09-\x0D]+`, shingles are SHINGLE words; a shorter text that has words is one shingle. Null text
counts as empty; a text without words has the empty sketch. Two empty sketches are alike (1), an empty and
another are not (0). Rows that repeat a doc_id are rows each for itself; equal texts have equal fingerprints.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions, texts

SHINGLE, K = 5, 128
#: Ranges that are counted, for each one that is dealt out.
FINER = 4


def let(value: Column, body) -> Column:
    """body of value, with value computed once: inside a lambda a plain expression would be computed for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    return F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != "")


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def shingle_hashes(hashes: Column, width: int = SHINGLE) -> Column:
    """Hashes of the shingles of a text given as its words' hashes: of width words each, or of all if there are fewer."""
    n = F.size(hashes)
    inner = F.transform(F.sequence(F.lit(0), n - width), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(width)]))
    short = F.array(F.xxhash64(hashes))
    return F.when(n >= width, inner).when(n > 0, short).otherwise(F.array().cast("array<bigint>"))


def bottom(hashes: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def sketch(text: Column, k: int = K, width: int = SHINGLE) -> Column:
    """The bottom-k sketch of a text."""
    return let(word_hashes(text), lambda h: bottom(shingle_hashes(h, width), k))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of the two shingle sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A or B|: the part of the union's sketch that both have."""
    both = lambda union: F.size(F.array_intersect(F.array_intersect(union, a), b))
    return let(merge(a, b, k), lambda union: F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both(union) / F.size(union)))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of different shingles; exact for a sketch that isn't full."""
    share = (F.element_at(a, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / share)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated |A and B| / |A|."""
    both = resemblance(a, b, k) * distinct_shingles(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), both / distinct_shingles(a, k)))


def as_text(a: Column) -> Column:
    """A sketch as a string: base64 of its hashes, big-endian."""
    return F.replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), F.lit("\r\n"), F.lit(""))


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """doc_id, sketch and the estimated number of different shingles of each row."""
    rows = texts(docs).select("doc_id", sketch(F.col("text"), k).alias("sketch"))
    return rows.withColumn("shingles_est", distinct_shingles(F.col("sketch"), k))


def ranges(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """Places (id, h) that cut the rows into up to FINER * parts ranges of similar numbers. An id with many rows is cut by h, which is spread evenly."""
    n = FINER * parts
    found = rows.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 20 * n)).first()[0] or []
    out = []
    for x in sorted(set(found)):
        k = found.count(x)
        out += [(x, -(2**63) + j * 2**64 // k) for j in range(k)]
    return out


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """doc_id, text, and what tells their order; a row's next is that by descending doc_id, the last one's next is the first.

    Rows go by ranges of (doc_id, hash of the text) that have about as many characters each, every range with one more row that the
    range below begins with, so that text moves once and no task sees more than its range. Rows with equal doc_id
    follow each other by the hash of their text; rows without doc_id come last. Only copies of one row are never parted.
    """
    spark, parts = docs.sparkSession, parts or shuffle_partitions(docs.sparkSession)
    rows = texts(docs).withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).withColumn("h", F.xxhash64("text"))
    cuts, key = ranges(rows, parts), F.struct("id", "h")
    places = F.array(*[F.struct(F.lit(i).alias("id"), F.lit(h).alias("h")) for i, h in cuts]).cast("array<struct<id:bigint,h:bigint>>")
    below = F.size(F.filter(places, lambda c: c <= key))
    fine = rows.groupBy(below.alias("fine")).agg(F.max(key).alias("key"), F.sum(F.length("text") + 1).alias("size")).orderBy("fine").collect()  # as many rows as ranges
    total, before, homes, heads = sum(r["size"] for r in fine), 0, {}, {}
    for r in fine:
        homes[r["fine"]] = at = min(parts - 1, before * parts // total)
        heads[at] = r["key"]  # the greatest of the range comes last
        before += r["size"]
    order = sorted(heads, reverse=True)
    guests = [(heads[r]["id"], heads[r]["h"], order[i - 1]) for i, r in enumerate(order)]
    ranged = F.broadcast(spark.createDataFrame(list(homes.items()), "fine int, at int"))
    guest = F.broadcast(spark.createDataFrame(guests, "id long, h long, to int"))
    also = rows.withColumn("fine", below).join(ranged, "fine").join(guest, ["id", "h"], "left")
    own = F.array(F.struct(F.col("at"), F.lit(0).alias("guest")))
    homes_ = F.when(F.col("to").isNull(), own).otherwise(F.concat(own, F.array(F.struct(F.col("to").alias("at"), F.lit(1).alias("guest")))))
    also = also.select("doc_id", "text", "id", "h", F.explode(homes_).alias("home")).select("doc_id", "text", "id", "h", "home.at", "home.guest")
    return also.repartitionById(parts, "at")


def edited_likeness(docs: DataFrame, k: int = K, parts: int | None = None) -> DataFrame:
    """Fingerprints of each row and of its edited text, and their likeness.

    Edited: the last floor(n_chars / 3) code points replaced by the first as many (or all) of the next row's text.
    Gives doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, shingles_est.
    A single row is its own next.
    """
    rows = with_next(docs, parts).withColumn("sketch", sketch(F.col("text"), k))
    order = Window.partitionBy("at").orderBy(F.col("guest"), F.col("id").desc(), F.col("h").desc())
    rows = rows.withColumn("next_text", F.lead("text").over(order)).withColumn("next_sketch", F.lead("sketch").over(order)).filter("guest = 0")
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - third), F.substring(F.col("next_text"), F.lit(1), third))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"), as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct_shingles(F.col("sketch"), k).alias("shingles_est"),
    )
