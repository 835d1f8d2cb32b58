"""Classification metrics from (label, prediction) as SQL aggregates.

The confusion counts are one grouped count, the classes' sums one conditional aggregate over that
small table; predictions never come to the driver."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_class(pred: DataFrame, label: str = "label", prediction: str = "prediction",
              keys: list[str] | None = None) -> DataFrame:
    """keys..., class, precision, recall, f1, support (scikit-learn's report; 0 when undefined)."""
    return _per_class(pred, label, prediction, keys or []).drop("tp")


def _per_class(pred: DataFrame, label: str, prediction: str, keys: list[str]) -> DataFrame:
    conf = pred.groupBy(*keys, label, prediction).agg(F.count(F.lit(1)).alias("n"))
    own, said = F.col(label) == F.col("class"), F.col(prediction) == F.col("class")
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    j = (conf.select("*", F.explode(F.array_distinct(F.array(label, prediction))).alias("class"))
             .groupBy(*keys, "class").agg(count(own & said).alias("tp"), count(own).alias("support"),
                                          count(said).alias("predicted")))
    prec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("predicted").cast("double")), F.lit(0.0))
    rec = F.coalesce(F.try_divide(F.col("tp").cast("double"), F.col("support").cast("double")), F.lit(0.0))
    j = j.withColumn("precision", prec).withColumn("recall", rec)
    f1 = F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
                    F.lit(0.0))
    return j.withColumn("f1", f1).select(*keys, "class", "precision", "recall", "f1",
                                         F.col("support").cast("long").alias("support"), "tp")


def weighted(pred: DataFrame, label: str = "label", prediction: str = "prediction",
             keys: list[str] | None = None) -> DataFrame:
    """keys..., accuracy and support-weighted precision / recall / F1, plus binary
    (positive class 1) precision / recall / F1."""
    keys = keys or []
    pc = _per_class(pred, label, prediction, keys)
    s = F.col("support").cast("double")
    w = pc.groupBy(*keys).agg(
        (F.sum("tp") / F.sum(s)).alias("accuracy"),
        F.sum("support").cast("long").alias("rows"),
        (F.sum(F.col("precision") * s) / F.sum(s)).alias("precision_weighted"),
        (F.sum(F.col("recall") * s) / F.sum(s)).alias("recall_weighted"),
        (F.sum(F.col("f1") * s) / F.sum(s)).alias("f1_weighted"),
        F.max(F.when(F.col("class") == 1, F.col("precision"))).alias("precision_pos"),
        F.max(F.when(F.col("class") == 1, F.col("recall"))).alias("recall_pos"),
        F.max(F.when(F.col("class") == 1, F.col("f1"))).alias("f1_pos"))
    return w.fillna(0.0, ["precision_pos", "recall_pos", "f1_pos"])


def fit_verdict(train_acc, test_acc, margin: float = 0.05):
    """'overfitting' if train > test + margin, 'underfitting' if train < test - margin, else 'good'."""
    return (F.when(train_acc > test_acc + margin, F.lit("overfitting"))
             .when(train_acc < test_acc - margin, F.lit("underfitting"))
             .otherwise(F.lit("good")))
