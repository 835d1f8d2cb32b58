"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and calls one operator of ``shipshape.llm`` on all rows that
its predecessor kept; ``run`` writes every stage's result as parquet in the folder that the cluster
shares and rereads it. Rows with null ids or texts are judged like any other. The models of the two
classifiers are fitted on a bounded sample of the stage's own rows with the labels of ``sf_dir``.
"""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipshape.llm import block_naming, packing, quality_fm, simhash, toxicity_zstd
from shipshape.llm.common import row_tag, staged, text_of
from shipshape.sources.tables import table


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id and text (by its tag) are in ``kept``."""
    ids = staged(kept.select(F.col("doc_id").alias("__kept_id"), F.col("tag").alias("__kept_tag")), "kept")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["__kept_id"])
                     & (row_tag(text_of(docs)) == ids["__kept_tag"]), "left_semi")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject."""
    scored = quality_fm.score(docs, quality_fm.fit(docs, table(spark, sf_dir, "labels")))
    return _keep(docs, scored.where("predicted = 1"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distance doesn't find toxic."""
    scored = toxicity_zstd.score(docs, toxicity_zstd.fit(docs, table(spark, sf_dir, "labels")))
    return _keep(docs, scored.where("predicted = 0"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id; rows repeated whole stay once."""
    found = block_naming.exact_dedup(docs)
    kept = _keep(docs, found.where("kept"))
    return kept.withColumn("__tag", row_tag(text_of(kept))).dropDuplicates(["doc_id", "__tag"]).drop("__tag")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document with the smallest doc_id."""
    found = simhash.simhash_dedup(docs)
    return _keep(docs, found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens: the columns of op1, without the ids themselves."""
    packed = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "padded_length")


STAGES = [("quality", quality), ("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup),
          ("packing", pack)]

#: Classifiers and fingerprints are beyond SQL; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
