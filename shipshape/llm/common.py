"""Helpers shared by the operators of this subpackage."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shipshape.session import scratch_dir, ship, staged

__all__ = ["Scratch", "connected_components", "held_out", "row_tag", "ship", "sign", "staged", "text_of"]


class Scratch:
    """Tables of one operator under one new folder of the shared one, deleted when the operator ends;
    ``result`` writes what outlives it."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.root, self.tables = spark, name, scratch_dir(spark, name), []

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def result(self, df: DataFrame, name: str) -> DataFrame:
        return staged(df, f"{self.name}-{name}")

    def __exit__(self, *failed) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(df[name], F.lit(""))


def row_tag(text: Column) -> Column:
    """Tells rows that share a doc_id apart by their text (a row key, never an identity of texts)."""
    return F.xxhash64(text)


def held_out(doc_id: Column) -> Column:
    """The rows that labels are never learned from: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 5 == 0, F.lit(False))


def sign(df: DataFrame) -> tuple:
    """Row count and an order-free checksum, to see whether an iteration changed anything."""
    return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64(*df.columns))).first())


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Components of an undirected graph: one row (node, component) per node that has an
    edge, component being the smallest node reachable.

    Alternates the large-star and the small-star step (each a grouped minimum and an
    equi-join) until the edges no longer change, which takes a number of rounds
    logarithmic in the graph's size. A hub's edges are never gathered: the minimum is
    combined map-side and, as the minima are staged, the join on a hub can be split by AQE.
    Self-loops, repeated edges and edges with a null end count for nothing.
    """
    x, y = F.col(a), F.col(b)
    e = staged(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "edges")
    before = sign(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        low = staged(low, "lows")
        large = (both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        large = staged(large, "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "lows")
        small = large.join(low, "u")
        e = staged(small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "small")
        now = sign(e)
        if now == before:
            break
        before = now
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
