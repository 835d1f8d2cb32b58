"""NearMiss-1 undersampling and the k-nearest-neighbour vote, over the exact k-NN join.

For every row of a larger class: the mean Euclidean distance to its k nearest rows of the smallest
class. Of each larger class the rows with the smallest means are kept, as many as the smallest
class has; that class is kept whole. Identical vectors are searched once. The selection of the n
smallest finds its thresholds by distributed selection (``ranks``); only rows tied at a threshold
are ordered.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipshape.operators.features import key_hash
from shipshape.operators.knn import knn_mean
from shipshape.operators.ranks import values_at_ranks
from shipshape.session import staged


def _vec(feats: list[str]) -> list[Column]:
    return [F.coalesce(F.col(f).cast("double"), F.lit(0.0)).alias(f"_v{i}") for i, f in enumerate(feats)]


def smallest_n(df: DataFrame, n: int, score: str, keys: list[str]) -> DataFrame:
    """The n rows with the smallest (score, hash(keys), keys), exactly, duplicates included."""
    h = key_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in keys]), "nm-")
    d = staged(df.withColumn("_h", h), "smallest")
    total = d.count()
    if n >= total:
        return d.drop("_h")
    s_star = values_at_ranks(d, score, [n])[1][n]
    below, tied = d.filter(F.col(score) < s_star), d.filter(F.col(score) == s_star)
    r1 = n - below.count()
    h_star = values_at_ranks(tied, "_h", [r1])[1][r1]
    tied_below = tied.filter(F.col("_h") < h_star)
    last = tied.filter(F.col("_h") == h_star)  # hash collisions or identical rows only: a handful
    r2 = r1 - tied_below.count()
    ranked = last.withColumn("_rn", F.row_number().over(Window.partitionBy(score, "_h").orderBy(*keys)))
    return below.unionByName(tied_below).unionByName(ranked.filter(F.col("_rn") <= r2).drop("_rn")).drop("_h")


def nearmiss(df: DataFrame, feats: list[str], label: str = "label", keys: list[str] | None = None,
             k: int = 3, digits: int = 6) -> DataFrame:
    """The smallest class (ties: the smallest label) plus, of every other class, as many rows, those
    of smallest mean k-NN distance (rounded to ``digits``). Rows without a label are left out."""
    keys = keys or []
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().collect() if r[label] is not None}  # one per class
    if len(counts) < 2:
        return df
    least = min(counts, key=lambda c: (counts[c], c))
    vec, names = _vec(feats), [f"_v{i}" for i in range(len(feats))]
    rows = staged(df.where(F.col(label).isNotNull()).select("*", *vec), "nearmiss")
    small, others = rows.where(F.col(label) == least), rows.where(F.col(label) != least)
    points = small.groupBy(*names).agg(F.count(F.lit(1)).alias("_m"))
    larger = [c for c in sorted(counts) if c != least]
    wanted = {f"_n{i}": counts[least] for i in range(len(larger))}  # rows of each larger class
    asked = others.select(*names, *[F.when(F.col(label) == c, 1).otherwise(0).alias(n) for n, c in zip(wanted, larger)])
    means = knn_mean(asked, points, len(feats), k, wanted=wanted, room=10.0 ** -digits)
    means = means.withColumn("knn_mean", F.round("knn_mean", digits))
    scored = staged(others.join(means.hint("merge"), names), "nearmiss-scored")
    chosen = [smallest_n(scored.where(F.col(label) == c), counts[least], "knn_mean", keys) for c in larger]
    return reduce(DataFrame.unionByName, [x.select(*df.columns) for x in [small, *chosen]])


def knn_vote(train: DataFrame, test: DataFrame, feats: list[str], label: str = "label", k: int = 5) -> DataFrame:
    """k-nearest-neighbour classifier for 0/1 labels: ``test`` rows get ``prediction`` =
    1.0 when most of their k nearest training rows are positive. Equal distances are
    taken in ascending label order. Exact."""
    vec, names = _vec(feats), [f"_v{i}" for i in range(len(feats))]
    points = (train.select(*vec, F.col(label).cast("double").alias("_lab"))
              .groupBy(*names, "_lab").agg(F.count(F.lit(1)).alias("_m")))
    votes = knn_mean(test.select(*vec), points, len(feats), k, value="_lab")
    pred = votes.select(*names, F.when(F.col("knn_value") * 2 > k, 1.0).otherwise(0.0).alias("prediction"))
    return test.select("*", *vec).join(pred.hint("merge"), names).drop(*names)
