"""Exact de-duplication by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes; the distinct blocks, in sorted order,
get integer names; adjacent names are paired and the distinct pairs get names in turn, until
one name is left of each document. Equal names then mean equal texts: names are given to
distinct contents, never to digests.

Sorting is by ``(hash, content)``. The hash spreads the blocks evenly whatever the texts look
like, so names are numbered bucket by bucket (top 12 bits of the hash, then the place in the
bucket) without a global sort. Contents travel through one shuffle only, in which equal blocks
are combined map-side; occurrences find their names by the hash, and by the content wherever
several contents share a hash.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shipshape.llm.common import row_tag, staged, text_of

BLOCK_BYTES = 4096
#: A name is the bucket, shifted, plus the place in the bucket.
BUCKET_BITS, PLACE_BITS = 12, 40


def _bucket(h: Column) -> Column:
    return F.shiftrightunsigned(h, 64 - BUCKET_BITS)


def _block_names(docs: DataFrame, block_bytes: int, block_hash: Callable[[Column], Column]) -> DataFrame:
    """(doc_id, tag, n_bytes, pos, name): the named blocks of each distinct (doc_id, text)."""
    text = text_of(docs)
    units = docs.select("doc_id", row_tag(text).alias("tag"), F.octet_length(text).alias("n_bytes"),
                        text.cast("binary").alias("bytes"))
    last = F.greatest(F.ceil(F.col("n_bytes") / block_bytes).cast("int") - 1, F.lit(0))
    blocks = units.select(
        "doc_id", "tag", "n_bytes",
        F.posexplode(F.transform(F.sequence(F.lit(0), last),
                                 lambda i: F.substring(F.col("bytes"), i * block_bytes + 1, F.lit(block_bytes))))
    ).withColumnRenamed("col", "block").withColumn("h", block_hash(F.col("block")))

    contents = blocks.select("h", "block").distinct()
    heads = contents.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy(_bucket(F.col("h"))).orderBy("h")
    first = F.sum("n").over(before.rowsBetween(Window.unboundedPreceding, -1))
    heads = staged(heads.select("h", "n", (F.shiftleft(_bucket(F.col("h")), PLACE_BITS)
                                           + F.coalesce(first, F.lit(0)) + 1).alias("base")), "heads")
    key = ["doc_id", "tag", "n_bytes", "pos"]
    named = blocks.select(*key, "h").join(heads.where("n = 1"), "h").select(*key, F.col("base").alias("name"))
    if not heads.where("n > 1").isEmpty():  # several contents under one hash: told apart by the content itself
        shared = heads.where("n > 1")
        place = F.row_number().over(Window.partitionBy("h").orderBy("block"))
        exact = contents.join(shared, "h").select("h", "block", (F.col("base") + place - 1).alias("name"))
        named = named.unionByName(blocks.join(shared.select("h"), "h", "left_semi").join(exact, ["h", "block"])
                                  .select(*key, "name"))
    return staged(named.distinct(), "names")


def _paired(names: DataFrame) -> DataFrame:
    """One level up: adjacent names of a document become the name of their pair (an odd last
    one pairs with 0, which no content has)."""
    half = F.shiftright("pos", 1)
    even = F.col("pos") % 2 == 0
    pairs = names.groupBy("doc_id", "tag", "n_bytes", half.alias("pos")).agg(
        F.max(F.when(even, F.col("name"))).alias("a"),
        F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(0)).alias("b"))
    pairs = staged(pairs, "pairs")
    h = F.xxhash64("a", "b")
    place = F.row_number().over(Window.partitionBy(_bucket(F.col("h"))).orderBy("h", "a", "b"))
    table = pairs.select("a", "b").distinct().withColumn("h", h).select(
        "a", "b", (F.shiftleft(_bucket(F.col("h")), PLACE_BITS) + place).alias("name"))
    return pairs.join(staged(table, "table"), ["a", "b"]).select("doc_id", "tag", "n_bytes", "pos", "name")


def block_identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES,
                     block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, tag, n_bytes, name): two rows hold equal texts exactly when both ``n_bytes``
    and ``name`` agree. ``tag`` tells rows of one doc_id with different texts apart."""
    names = _block_names(docs, block_bytes, block_hash)
    longest = names.agg(F.max("pos")).first()[0] or 0
    size, done = block_bytes, []
    while True:
        done.append(names.where(F.col("n_bytes") <= size).select("doc_id", "tag", "n_bytes", "name"))
        if longest == 0:
            break
        names = staged(_paired(names.where(F.col("n_bytes") > size)), "level")
        longest, size = longest >> 1, size * 2
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def exact_dedup(docs: DataFrame, block_bytes: int = BLOCK_BYTES,
                block_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, tag.

    Of equal texts the row with the largest doc_id stays. Null texts are empty texts, and
    the empty text is a text like any other. Rows repeated whole (same doc_id, same text)
    are one document; rows that share a doc_id with different texts are two. A null doc_id
    is smaller than any other. An empty table gives an empty result. Further columns of
    ``docs`` are not read, so their names can't clash.
    """
    ident = block_identities(docs, block_bytes, block_hash)
    groups = ident.groupBy("n_bytes", "name").agg(F.max("doc_id").alias("keep_id"),
                                                  F.count(F.lit(1)).alias("group_size"))
    groups = staged(groups, "groups")  # apart from its aggregate, AQE can split the join on a large group
    found = ident.join(groups, ["n_bytes", "name"]).select(F.col("doc_id").alias("id"), F.col("tag").alias("t"),
                                                           "keep_id", "group_size")
    text = text_of(docs)
    texts = docs.select("doc_id", row_tag(text).alias("tag"), F.sha2(text, 256).alias("text_sha256")).distinct()
    return texts.join(found, texts["doc_id"].eqNullSafe(found["id"]) & (texts["tag"] == found["t"])).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        "text_sha256", "tag")
