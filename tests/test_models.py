"""Model helpers on a small frame: better than the majority, equal for equal seeds, nodes that add up."""
import random

import pytest
from pyspark.sql import functions as F

from shipshape.operators import features, models

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def frame(spark):
    rnd = random.Random(1)
    rows = []
    for i in range(300):
        x = [rnd.random() for _ in NAMES]
        rows.append((*x, float(x[0] + 0.3 * x[1] > 0.7), i % 5))
    return features.assemble(spark.createDataFrame(rows, "a double, b double, c double, label double, fold int"), NAMES)


def test_scores_and_seed(frame):
    train, test = frame.where("fold < 4"), frame.where("fold = 4")
    majority = max(r["count"] for r in test.groupBy("label").count().collect()) / test.count()
    one, two = (models.train_and_score(train, test, "dt").first() for _ in range(2))
    assert one == two and one.rows == test.count() and majority < one.accuracy <= 1


def test_split_counts_add_up_to_the_inner_nodes(frame):
    model = models.estimator("gbt", max_iter=3, max_depth=3).fit(frame)
    nodes = models.node_table(model)
    inner = nodes.where("left_child >= 0").count()
    assert models.split_counts(nodes, NAMES).agg(F.sum("splits")).first()[0] == inner > 3
    imp = {r.feature: r.importance for r in models.importances(model, NAMES).collect()}
    assert abs(sum(imp.values()) - 1) < 1e-9 and max(imp, key=imp.get) == "a"


def test_cross_validation_with_knn(frame):
    folds = models.cross_validate(frame, "knn", 2).collect()
    assert [r.fold for r in folds] == [0, 1] and all(0.7 < r.accuracy <= 1 for r in folds)


@pytest.mark.parametrize("kind", ["dt", "knn"])
def test_cross_validation_scores_every_row_of_a_fold(frame, monkeypatch, kind):
    seen = []
    of = models.metrics.weighted
    monkeypatch.setattr(models.metrics, "weighted", lambda s: seen.append(s.count()) or of(s))
    fits, name = [], "_knn" if kind == "knn" else "train_and_score"
    run = getattr(models, name)
    monkeypatch.setattr(models, name, lambda train, *a, **kw: fits.append(train.count()) or run(train, *a, **kw))
    third = frame.withColumn("fit", (F.crc32(F.col("a").cast("string")) % 3 == 0).cast("int"))
    folds = models.cross_validate(third, kind, 5, fit="fit = 1").collect()
    assert len(folds) == 5 and seen == [60] * 5
    marked = [third.where(f"fold <> {f} and fit = 1").count() for f in range(5)]
    assert fits == ([240] * 5 if kind == "knn" else marked) and all(0 < m < 240 for m in marked)


def test_train_folds_score_all_training_rows(spark, monkeypatch):
    """The registered queries hand all training rows over, not only those that are fitted on."""
    from shipshape.plans import catalog
    rows = spark.createDataFrame([(i, i % 5, int(i % 7 == 0), int(i % 3 == 0 and i % 7 > 0)) for i in range(70)],
                                 "k int, fold int, is_test int, fit int")
    handed = {}
    monkeypatch.setattr(catalog, "_training", lambda *a: rows)
    monkeypatch.setattr(catalog, "materialized", lambda spark, folder, name, build: build())
    monkeypatch.setattr(models, "cross_validate", lambda t, kind, k, **kw: handed.update({kind: (t.count(), kw)}))
    for kind, part in (("dt", "train"), ("knn", "train"), ("gbt", "test")):
        catalog._fold_table(spark, "", kind, part)
    assert handed == {"dt": (60, {"fit": "fit = 1"}), "knn": (60, {"fit": "fit = 1"}), "gbt": (10, {"fit": None})}


def test_models_are_fitted_on_all_training_rows(spark, monkeypatch):
    """Before, on those of a tenth of the orders."""
    from shipshape.plans import catalog
    names = features.FIXTURE_FEATURES
    rows = spark.createDataFrame([(f"SO{i}", "P1", "D1", 1.0, *[float((i * 7 + j) % 5) for j in range(len(names))], float(i % 2)) for i in range(100)],
                                 ", ".join([*(f"{k} {'double' if k.endswith('so') else 'string'}" for k in catalog.MF_KEYS),
                                            *(f"{n} double" for n in names), "label double"]))
    monkeypatch.setattr(catalog, "_nearmiss", lambda *a: rows)
    monkeypatch.setattr(catalog, "materialized", lambda spark, folder, name, build: build())
    t = catalog._training(spark, "")
    train = t.where("is_test = 0").count()
    assert t.where("fit = 1").count() == train == t.where("is_test = 0 AND fit = 1").count() and 60 < train < 100


def test_importances_are_of_all_training_lines(spark, monkeypatch):
    """Before, of a tenth of the orders."""
    from shipshape.plans import catalog
    lines = spark.createDataFrame([(f"SO{i}", float(i % 2)) for i in range(100)], "k_order_no string, label double")
    handed = []
    monkeypatch.setattr(catalog, "_model_columns", lambda *a: lines)
    monkeypatch.setattr(catalog, "remembered", lambda *a: "")
    monkeypatch.setattr(catalog, "materialized", lambda spark, folder, name, build: build())
    monkeypatch.setattr(features, "encoded_vectors", lambda frame, path, keys: (frame, ["a"]))
    monkeypatch.setattr(models, "importances", lambda model, names: spark.createDataFrame([("a", 1.0)], "feature string, importance double"))
    monkeypatch.setattr(models, "estimator", lambda kind: _Counts(handed))
    catalog.feature_importance_top15(spark, "")
    assert handed == [features.split_by_key(lines, "k_order_no", 20, 1505).where("is_test = 0").count()] and handed[0] > 60


class _Counts:
    """An estimator that notes how many rows it is fitted on."""

    def __init__(self, seen):
        self.fit = lambda frame: seen.append(frame.count())


def test_a_fit_spreads_over_the_cores(spark):
    rows = spark.range(3 * models.SPREAD_ROWS - 5).coalesce(1)
    out = models.spread(rows)
    assert out.rdd.getNumPartitions() == min(3, spark.sparkContext.defaultParallelism) and out.distinct().count() == rows.count()
    assert models.spread(rows.limit(7)).rdd.getNumPartitions() == 1 and models.spread(out.repartition(9)).rdd.getNumPartitions() == 9
    assert models.spread(rows.limit(0)).count() == 0


def test_label_inputs_are_excluded():
    assert features.exclude_label_inputs(["distance_km", "delivery_day", "days_off_count", "day_processing"]) == ["distance_km"]


@pytest.mark.parametrize("kind", ["dt", "rf"])
def test_deep_trees_keep_each_rows_node_between_levels(frame, kind):
    kw = {"num_trees": 5} if kind == "rf" else {}
    kept = models.estimator(kind, **kw)
    assert kept.getCacheNodeIds()
    assert kept.fit(frame).toDebugString.split("\n")[1:] == kept.copy({kept.cacheNodeIds: False}).fit(frame).toDebugString.split("\n")[1:]
