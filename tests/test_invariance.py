"""Hash sampling, splits and folds do not depend on partitioning; folds are stratified."""
from pyspark.sql import functions as F

from shipshape.operators import features


def _frame(spark):
    rows = [(f"SO{i}", f"P{i % 37}", f"D{i % 11}", float(i % 50 + 1), float(i % 5 != 0)) for i in range(3000)]
    return spark.createDataFrame(rows, "order_no string, item_code string, distributor_code string, "
                                       "totalec_so double, label double")


def test_sample_split_folds_partition_invariant(spark):
    base = _frame(spark)
    results = []
    for n in (1, 3, 7):
        df = base.repartition(n)
        s = sorted(r.order_no for r in features.sample_by_key(df, "order_no", 10, 1).collect())
        t = sorted(r.order_no for r in features.split_by_key(df, "order_no").filter("is_test = 1").collect())
        f = sorted((r.order_no, r.fold) for r in features.stratified_folds(df, 5, "label").collect())
        results.append((s, t, f))
    assert results[0] == results[1] == results[2]


def test_folds_are_stratified(spark):
    f = features.stratified_folds(_frame(spark), 5, "label")
    counts = f.groupBy("label", "fold").count().collect()
    by_label = {}
    for r in counts:
        by_label.setdefault(r.label, []).append(r["count"])
    for c in by_label.values():
        assert len(c) == 5 and max(c) - min(c) <= 1


def test_folds_do_not_depend_on_the_number_of_ranges(spark):
    df = _frame(spark)
    a, b = (sorted((r.order_no, r.fold) for r in features.stratified_folds(df, 5, "label", bucket_bits=n).collect())
            for n in (6, 12))
    assert a == b
