"""Classifiers, importances and cross-validation as Spark ML jobs.

Training runs on the executors (trees are grown level by level from
distributed statistics); only model metadata -- importances, the node table of
a saved model -- is turned back into small DataFrames.
"""
from __future__ import annotations

import math
import uuid
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from contextvars import ContextVar
from functools import reduce

from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       RandomForestClassifier)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.util import inheritable_thread_target

from shipshape.operators import metrics
from shipshape.operators.nearmiss import knn_vote
from shipshape.session import scratch_dir, staged

SEED = 1505


def estimator(kind: str, max_iter: int = 100, num_trees: int = 100, max_depth: int | None = None):
    """dt and rf: unlimited depth in the reference -> Spark's maximum 30, rf with 100 trees, each row's
    node kept between levels, so a level doesn't walk down from the root;
    gbt: 100 rounds (or ``max_iter``) of boosted depth-6 trees, step 0.3 (the reference's library
    defaults); lr / svc: linear models."""
    common = dict(featuresCol="features", labelCol="label", predictionCol="prediction")
    if kind == "dt":
        return DecisionTreeClassifier(seed=SEED, maxDepth=max_depth or 30, cacheNodeIds=True, **common)
    if kind == "rf":
        return RandomForestClassifier(seed=SEED, numTrees=num_trees, maxDepth=max_depth or 30, cacheNodeIds=True, **common)
    if kind == "gbt":
        return GBTClassifier(seed=SEED, maxIter=max_iter, maxDepth=max_depth or 6, stepSize=0.3, **common)
    if kind == "lr":
        return LogisticRegression(maxIter=100, **common)
    if kind == "svc":
        return LinearSVC(maxIter=100, **common)
    raise ValueError(kind)


def train_and_score(train: DataFrame, test: DataFrame, kind: str, **kw) -> DataFrame:
    """Fit on ``train``, score ``test``: one row of weighted and binary metrics."""
    model = estimator(kind, **kw).fit(train)
    return metrics.weighted(model.transform(test).select("label", "prediction")).withColumn("model", F.lit(kind))


def _knn(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """The k-NN vote on assembled vectors."""
    size = len(train.select("features").head().features)
    names = [f"f{i}" for i in range(size)]
    flat = lambda df: df.select("label", vector_to_array("features").alias("x")).select(
        "label", *[F.col("x")[i].alias(n) for i, n in enumerate(names)])
    return knn_vote(flat(train), flat(test), names, "label", k)


def importances(model, names: list[str]) -> DataFrame:
    """(feature, importance) from a tree ensemble (impurity-based, normalised)."""
    from pyspark.sql import SparkSession
    s = SparkSession.getActiveSession()
    vals = model.featureImportances.toArray().tolist()
    return s.createDataFrame(list(zip(names, [float(v) for v in vals])), "feature string, importance double")


def node_table(model) -> DataFrame:
    """The saved model's node rows: treeID, node id, split feature (-1 on leaves),
    threshold, prediction, children."""
    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    path = scratch_dir(spark, "model")
    model.write().overwrite().save(path)
    data = spark.read.parquet(f"{path}/data")
    tree = F.col("treeID") if "treeID" in data.columns else F.lit(0)
    n = F.col("nodeData")
    return data.select(tree.alias("tree_id"), n["id"].alias("node_id"),
                       n["split"]["featureIndex"].alias("feature_index"),
                       F.try_element_at(n["split"]["leftCategoriesOrThreshold"], F.lit(1)).alias("threshold"),
                       n["prediction"].alias("prediction"), n["leftChild"].alias("left_child"),
                       n["rightChild"].alias("right_child"))


def tree_paths(nodes: DataFrame, names: list[str], tree: int) -> DataFrame:
    """One row per leaf of a tree: tree_id, node_id, depth, prediction, and ``conditions``, what a row has to
    meet on the way from the root, as text (empty for a tree that is a leaf).

    A recursive query walks the node table down from the root, a level at a time, by joins of parents with children."""
    spark = nodes.sparkSession
    view, named = f"nodes_{uuid.uuid4().hex}", f"names_{uuid.uuid4().hex}"
    staged(nodes.where(F.col("tree_id") == tree), "tree").createOrReplaceTempView(view)
    spark.createDataFrame(list(enumerate(names)), "feature_index int, feature string").createOrReplaceTempView(named)
    out = spark.sql(f"""
WITH RECURSIVE walk(tree_id, node_id, feature_index, threshold, left_child, right_child, prediction, depth, conditions) MAX RECURSION LEVEL 100 AS (
  SELECT tree_id, node_id, feature_index, threshold, left_child, right_child, prediction, 0, '' FROM {view} WHERE node_id = 0
  UNION ALL
  SELECT n.tree_id, n.node_id, n.feature_index, n.threshold, n.left_child, n.right_child, n.prediction, w.depth + 1,
         concat(w.conditions, CASE WHEN w.depth = 0 THEN '' ELSE ' AND ' END, f.feature,
                CASE WHEN n.node_id = w.left_child THEN ' <= ' ELSE ' > ' END, CAST(w.threshold AS STRING))
  FROM walk w JOIN {view} n ON n.node_id = w.left_child OR n.node_id = w.right_child
  JOIN {named} f ON f.feature_index = w.feature_index
  WHERE w.left_child >= 0)
SELECT tree_id, node_id, depth, prediction, conditions FROM walk WHERE left_child < 0""")
    return staged(out, "paths")


def split_counts(nodes: DataFrame, names: list[str]) -> DataFrame:
    """Number of splits per feature over all trees (xgboost's 'weight' importance)."""
    spark = nodes.sparkSession
    idx = spark.createDataFrame(list(enumerate(names)), "feature_index int, feature string")
    return (nodes.filter(F.col("feature_index") >= 0).groupBy("feature_index").agg(F.count(F.lit(1)).alias("splits"))
                 .join(F.broadcast(idx), "feature_index"))


_AT_ONCE: ContextVar[int] = ContextVar("folds at once", default=1)


@contextmanager
def folds_at_once(n: int):
    """Within it, cross-validations fit ``n`` folds at once."""
    token = _AT_ONCE.set(n)
    try:
        yield
    finally:
        _AT_ONCE.reset(token)


#: Rows that a task of a fit should have at least.
FIT_ROWS = 16_384


def compact(frame: DataFrame) -> DataFrame:
    """The rows in no more partitions than their number asks for: an iterative fit runs hundreds of jobs, whose
    tasks cost more than their rows where a small frame has many partitions."""
    return frame.coalesce(max(1, math.ceil(frame.count() / FIT_ROWS)))


#: Rows of a task of a fit, beyond which idle cores take some over.
SPREAD_ROWS = 4096


def spread(frame: DataFrame) -> DataFrame:
    """The rows in as many partitions as there are cores, or as their number asks for if that is less: a small file is one
    partition, and a deep forest goes over its rows hundreds of times. Frames with as many partitions stay as they are."""
    wanted = min(frame.sparkSession.sparkContext.defaultParallelism, math.ceil(frame.count() / SPREAD_ROWS))
    return frame.repartition(wanted) if frame.rdd.getNumPartitions() < wanted else frame


def cross_validate(frame: DataFrame, kind: str, k: int = 5, fold_col: str = "fold", fit: str | None = None,
                   parallel: int | None = None, **kw) -> DataFrame:
    """fold, accuracy, precision, recall, f1 (binary, positive class 1) for each held-out fold.

    Every row of a fold is scored. ``fit``, a condition, bounds the rows of the other folds that a
    model is fitted on; k-NN fits nothing and looks its neighbours up in all of them. ``parallel`` folds
    are fitted at once, as jobs of the one session (unless given, as many as ``folds_at_once`` says, else one)."""
    parallel = parallel or _AT_ONCE.get()

    def one(f: int) -> DataFrame:
        train = frame.filter(F.col(fold_col) != f)
        if fit is not None and kind != "knn":
            train = train.filter(fit)
        if parallel > 1 and kind != "knn":
            train = compact(train)
        test = frame.filter(F.col(fold_col) == f)
        if kind == "knn":
            s = metrics.weighted(_knn(train, test))
        else:
            s = train_and_score(train, test, kind, **kw)
        return s.select(F.lit(f).alias("fold"), "accuracy", F.col("precision_pos").alias("precision"),
                        F.col("recall_pos").alias("recall"), F.col("f1_pos").alias("f1"))

    if parallel > 1:
        with ThreadPoolExecutor(parallel) as pool:
            rows = list(pool.map(inheritable_thread_target(frame.sparkSession)(one), range(k)))
    else:
        rows = [one(f) for f in range(k)]
    return reduce(DataFrame.unionByName, rows)
