"""The registered queries of this subpackage: thin, each over its whole table."""
from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipshape.llm import (block_naming, byte_bpe, conversation_repair, html_regions, itq, licenses, packing, quality_fm,
                           rtree_negatives, simhash, suffix_dedup, tool_calls, toxicity_zstd)
from shipshape.sources.tables import table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLE: dict[str, str] = {}


def query(fn):
    LLM_QUERIES[fn.__name__] = fn
    return fn


@query
def op1_packing(spark, sf_dir):
    packed = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "padded_length")


@query
def op2_simhash(spark, sf_dir):
    return simhash.simhash_dedup(table(spark, sf_dir, "documents")).drop("tag")


@query
def op3_itq(spark, sf_dir):
    return itq.embedding_dedup(table(spark, sf_dir, "embeddings"))


@query
def op4_licenses(spark, sf_dir):
    return licenses.scan(table(spark, sf_dir, "documents"))


LLM_ORACLE["op4_licenses"] = licenses.oracle()


@query
def op5_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN), path)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op6_quality_fm(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels"))).drop("tag")


@query
def op7_html_regions(spark, sf_dir):
    return html_regions.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query
def op8_tool_calls(spark, sf_dir):
    """The table's chats are plain; calls and results are derived from its rows."""
    return tool_calls.format_chats(tool_calls.derived_calls(table(spark, sf_dir, "conversations")))


@query
def op9_block_naming(spark, sf_dir):
    return block_naming.exact_dedup(table(spark, sf_dir, "documents")).drop("tag")


@query
def op10_toxicity_zstd(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity_zstd.score(docs, toxicity_zstd.fit(docs, table(spark, sf_dir, "labels"))).drop("tag")


@query
def op11_conversation_repair(spark, sf_dir):
    """The table's conversations, damaged by checksums, and repaired."""
    return conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")))


@query
def op12_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op13_rtree_negatives(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return rtree_negatives.hard_negatives(rows, F.col("vec_id") % 100 == 0, label)


LLM_ORACLE["op13_rtree_negatives"] = rtree_negatives.ORACLE
LLM_ORACLE["op9_block_naming"] = """
WITH d AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
     g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(text) AS text_sha256
FROM d JOIN g USING (text)
"""


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)
