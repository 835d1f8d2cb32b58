"""Bounded samples of labelled rows, for fitting classifiers on the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipshape.llm.common import held_out, staged


def learnable(labels: DataFrame, label: str, docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, y): all labelled ids that may be learned from, of those in ``docs`` if given. Rows
    without an id or a label are left out; an id labelled twice counts once, with its larger label."""
    y = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    y = y.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    return y if docs is None else y.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")


def labelled_ids(labels: DataFrame, label: str, rows: int, per_class: bool = False,
                 docs: DataFrame | None = None) -> DataFrame:
    """(doc_id, y): at most ``rows`` of the ``learnable`` ids (of each class, if ``per_class``), by the
    order of a hash of the id. With ``docs`` no place goes to an id that they don't hold."""
    y = learnable(labels, label, docs)
    if docs is not None:
        y = staged(y, "learnable")
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    if not per_class:
        return y.orderBy(*order).limit(rows)
    return y.where("y = 0").orderBy(*order).limit(rows).unionByName(y.where("y = 1").orderBy(*order).limit(rows))


def rows_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """The documents of those ids, with y. ``ids`` holds no more rows than its sample's bound,
    so it is broadcast and the documents are not shuffled."""
    return docs.join(F.broadcast(ids.select(F.col("doc_id").alias("sample_id"), "y")),
                     docs["doc_id"] == F.col("sample_id"))
