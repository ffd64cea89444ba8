"""Exact dedup by content-defined chunk recipes, in DataFrame functions only.

A text is cut into chunks at places that its own characters decide: after at least MIN_CHARS, at the next
sentence end or line break, at MAX_CHARS at the latest. Chunks are deduplicated once for the corpus, which
verifies their identifiers: two different chunks never share one. A text is then its recipe, the ordered list of
its chunks' identifiers, and equal texts are those with equal recipes. Text moves once, as distinct chunks; all
later steps move recipes, some hundredths of that.

Defined results: null text counts as empty; the empty text has the empty recipe, so all empty texts are one
group. Rows that repeat a doc_id with the same text count as rows of the group; if that doc_id is the one that
stays, each of them has kept = true. A null doc_id never stays unless its whole group has none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, settle, texts, without

MIN_CHARS, MAX_CHARS = 256, 2048


def chunks(text: Column, least: int = MIN_CHARS, most: int = MAX_CHARS) -> Column:
    """The text cut at content-defined places; the chunks joined are the text."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{{least},{most - 1}}}?[.!?\n]|.{{1,{most}}}"), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256 and recipe: the ordered identifiers (h, nth) of the text's chunks."""
    rows = texts(docs)
    marked = clash_table(docs, bits)
    plain = F.transform(chunks(F.col("text")), lambda c: chunk_hash(c, bits))
    first = settle(rows.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), plain.alias("hashes")), "recipes")
    if marked.isEmpty():
        return first.select("doc_id", "text_sha256", F.col("hashes").alias("recipe"), F.lit(None).cast("array<bigint>").alias("nths"))
    parts = rows.select("doc_id", F.sha2(F.col("text"), 256).alias("text_sha256"), F.posexplode(chunks(F.col("text"))).alias("pos", "chunk"))
    parts = parts.withColumn("h", chunk_hash(F.col("chunk"), bits)).join(marked, ["h", "chunk"]).select("doc_id", "text_sha256", "pos", "nth").distinct()
    nths = parts.groupBy("doc_id", "text_sha256").agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("nth").cast("long").alias("nth")))).alias("marks"))
    nths = nths.select("doc_id", "text_sha256", F.flatten(F.transform("marks", lambda m: F.array(m["pos"], m["nth"]))).alias("nths"))
    same = (F.col("a.doc_id").eqNullSafe(F.col("b.doc_id"))) & (F.col("a.text_sha256") == F.col("b.text_sha256"))
    return first.alias("a").join(nths.alias("b"), same, "left").select("a.doc_id", "a.text_sha256", F.col("a.hashes").alias("recipe"), "b.nths")


def distinct_chunks(docs: DataFrame, bits: int) -> DataFrame:
    """(h, chunk): every different chunk of the corpus, once."""
    return texts(docs).select(F.explode(chunks(F.col("text"))).alias("chunk")).select(chunk_hash(F.col("chunk"), bits).alias("h"), "chunk").distinct()


def clash_table(docs: DataFrame, bits: int = 64) -> DataFrame:
    """(h, chunk, nth) of every chunk whose hash another chunk has too; nth tells them apart.

    The chunks' text is moved once, to be compared; their hashes are then counted, and only where one
    belongs to several chunks is the text looked at again.
    """
    shared = settle(distinct_chunks(docs, bits).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "chunk-clashes")
    if shared.isEmpty():
        return shared.select("h", F.lit("").alias("chunk"), F.lit(0).alias("nth"))
    # a group holds the different chunks of one 64-bit hash: a few
    nth = F.row_number().over(Window.partitionBy("h").orderBy("chunk"))
    return settle(distinct_chunks(docs, bits).join(shared, "h", "left_semi").withColumn("nth", nth), "chunk-numbers")


def exact_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    bits: of the chunk hash that are used; fewer only to test the verification.
    """
    found = recipes(docs, bits)
    found = found.withColumn("nths", F.coalesce("nths", F.array().cast("array<bigint>")))
    groups = settle(found.groupBy("recipe", "nths").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "recipe-groups")
    out = lookup(found, groups, ["recipe", "nths"], "group_size", found.count())
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def survivors(docs: DataFrame) -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns. A doc_id with several texts is judged for each of them."""
    sha = lambda c: F.unhex(c).alias("__sha")
    gone = exact_dedup(docs).filter("not kept").select(F.col("doc_id").alias("__gone_id"), sha("text_sha256")).distinct()
    rows = docs.withColumn("__gone_id", F.col("doc_id").cast("long")).withColumn("__sha", sha(F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256)))
    return without(rows, settle(gone, "gone"), ["__gone_id", "__sha"]).drop("__gone_id", "__sha")


ORACLE = """
select doc_id,
       max(doc_id) over (partition by coalesce(text, '')) as keep_id,
       count(*) over (partition by coalesce(text, '')) as group_size,
       doc_id is not distinct from max(doc_id) over (partition by coalesce(text, '')) as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
"""
