"""Feature preparation: key-hash sampling and splits, model frame, one-hot,
feature assembly, stratified folds.

Sampling and splitting hash a key instead of drawing random numbers, so the
result does not depend on partitioning or task retries (``df.sample`` does) and
lines of one order stay together.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipshape.operators.cleaning import fill_defaults


def key_hash(key: Column, salt: str) -> Column:
    """Non-negative 32-bit hash from md5(salt || key); portable to other SQL engines."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(salt), key)), 1, 8), 16, 10).cast("bigint")


def sample_by_key(df: DataFrame, key: str = "order_no", buckets: int = 10, keep: int = 1,
                  seed: int = 1505) -> DataFrame:
    """Keep rows whose key hash falls in the first ``keep`` of ``buckets`` (keep/buckets share)."""
    return df.filter(key_hash(F.col(key), f"{seed}-") % buckets < keep)


def split_by_key(df: DataFrame, key: str = "order_no", test_pct: int = 20, seed: int = 1505) -> DataFrame:
    """Adds ``is_test`` (1 for about ``test_pct`` % of keys)."""
    h = key_hash(F.col(key), f"split-{seed}-") % 100
    return df.withColumn("is_test", F.when(h < test_pct, 1).otherwise(0))


NUMERIC_FEATURES = ["totalec_so", "distance_km", "delivery_day", "days_off_count", "day_processing",
                    "urban_rate", "isfreegood_order_no"]
CATEGORICAL_FEATURES = ["region", "channelname", "segmentation", "brand", "pack_type", "pack_size", "month"]
ROW_KEY = ["order_no", "item_code", "distributor_code", "totalec_so"]


def swap_names(df: DataFrame, a: str, b: str) -> DataFrame:
    """Exchange two column names in one projection (renaming both at once is not a swap)."""
    return df.select(*[F.col(c).alias(b if c == a else a if c == b else c) for c in df.columns])


def model_frame(df: DataFrame, label: str = "difot", keys: list[str] = ROW_KEY, swap: bool = True,
                defaults: dict | None = None, fill: bool = True) -> DataFrame:
    """Row key, 7 numeric features, 7 categories (month from order_date), label.

    As in the reference, ``channelname`` and ``segmentation`` trade names before the
    defaults are applied."""
    f = df.select(*[F.col(k).alias(f"k_{k}") for k in keys], *NUMERIC_FEATURES,
                  *[c for c in CATEGORICAL_FEATURES if c != "month"],
                  F.month("order_date").alias("month"), F.col(label).alias("label"))
    if swap:
        f = swap_names(f, "channelname", "segmentation")
    return fill_defaults(f, defaults) if fill else f


def one_hot_long(frame: DataFrame, keys: list[str], cats: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """Sparse one-hot: one row (keys..., feature, value=1.0) per row and category whose
    value is not the column's first (smallest) value -- drop='first' semantics.
    Feature names are ``<column>_<value>``. One pass for the first values (one row
    back), one pass that explodes every row's categories."""
    # smallest value per column in its own order (months numerically)
    firsts = frame.agg(*[F.min(c).alias(c) for c in cats]).first()
    entries = F.array(*[F.struct(F.concat(F.lit(f"{c}_"), F.col(c).cast("string")).alias("feature"),
                                 (F.col(c).isNotNull() & (F.col(c) != F.lit(firsts[c]))).alias("keep"))
                        for c in cats])
    e = frame.select(*keys, F.explode(entries).alias("_e")).filter(F.col("_e.keep"))
    return e.select(*keys, F.col("_e.feature").alias("feature"), F.lit(1.0).alias("value"))


def encoded_features(frame: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    """Dense selection of named features: numeric columns as they are, ``<col>_<value>``
    as a 0/1 indicator (a value that never occurs gives a column of 0)."""
    cols = []
    for f in features:
        if f in frame.columns:
            cols.append(F.col(f).cast("double").alias(f))
            continue
        col, _, val = next(((c, "_", f[len(c) + 1:]) for c in CATEGORICAL_FEATURES if f.startswith(c + "_")),
                           (None, None, None))
        if col is None:
            raise ValueError(f"unknown feature {f!r}")
        cols.append(F.when(F.col(col).cast("string") == val, 1.0).otherwise(0.0).alias(f))
    return frame.select(*keys, *cols, "label")


# the reference's 15 selected features, expressed on the test fixtures' names and values
FIXTURE_FEATURES = ["day_processing", "delivery_day", "totalec_so", "distance_km", "days_off_count",
                    "urban_rate", "isfreegood_order_no", "month_3", "pack_size_29ML", "month_4",
                    "month_8", "region_ASIA", "pack_size_30ML", "segmentation_MACHINERY", "segmentation_BUILDING"]


#: Features that the label is computed from (delivery days, days off, processing days).
LABEL_INPUTS = ["delivery_day", "days_off_count", "day_processing"]


def exclude_label_inputs(features: list[str]) -> list[str]:
    """The features without those that define the label, for models that are to predict it ahead."""
    return [f for f in features if f not in LABEL_INPUTS]


#: Columns that a dense frame of all features may have; beyond that ``encoded_vectors`` gives sparse ones.
MAX_DENSE = 4096


def all_features(frame: DataFrame) -> list[str]:
    """Every numeric feature and every ``<column>_<value>`` of the one-hot encoding but each
    column's first value, as they stand before selection. Their number is checked first."""
    sizes = frame.agg(*[F.approx_count_distinct(c).alias(c) for c in CATEGORICAL_FEATURES]).first()
    if sum(sizes) > MAX_DENSE:
        raise ValueError(f"about {sum(sizes)} features: use encoded_vectors")
    values = frame.agg(*[F.array_sort(F.collect_set(F.col(c).cast("string"))).alias(c) for c in CATEGORICAL_FEATURES
                         ]).first()  # categories are small dimensions
    return NUMERIC_FEATURES + [f"{c}_{v}" for c in CATEGORICAL_FEATURES
                               for v in (sorted(values[c], key=int) if c == "month" else values[c])[1:]]


def assemble(frame: DataFrame, features: list[str], out: str = "features") -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    return VectorAssembler(inputCols=features, outputCol=out, handleInvalid="keep").transform(frame)


def stratified_folds(df: DataFrame, k: int = 5, label: str = "label", order: list[str] | None = None,
                     seed: int = 1505, bucket_bits: int = 12) -> DataFrame:
    """Exact stratified k-fold assignment: rows of each class are ranked by a key
    hash and dealt round-robin (fold = rank mod k), so every fold holds
    floor or ceil of 1/k of each class.

    The rank is counted by ranges of the hash (its highest ``bucket_bits`` bits): the
    counts of the ranges are summed up, and the row number inside a range is added.
    Ranges follow the order of the hash, so folds don't depend on their number."""
    order = order or ROW_KEY
    h = key_hash(F.concat_ws("|", *[F.col(c).cast("string") for c in order]), f"fold-{seed}-")
    d = df.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 32 - bucket_bits))
    counts = d.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(F.col(label).alias("_label"), F.col("_b").alias("_ob"),
                         F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"))
    inner = Window.partitionBy(label, "_b").orderBy("_h", *order)
    ranked = d.withColumn("_r", F.row_number().over(inner) - 1)
    out = ranked.join(offs, ranked[label].eqNullSafe(offs["_label"]) & (ranked["_b"] == offs["_ob"]))
    return (out.withColumn("fold", ((F.col("_off") + F.col("_r")) % k).cast("int"))
               .drop("_h", "_b", "_r", "_off", "_label", "_ob"))


def fit_encoder(frame: DataFrame, path: str, cats: list[str] = CATEGORICAL_FEATURES) -> None:
    """Learns the categories' values from ``frame`` and saves the encoder, a pipeline of an indexer and a
    one-hot encoder with sparse vectors, at ``path``.

    Values are ordered as text, whole numbers by size; the first one has no feature of its own. Null and,
    later, unseen values are kept apart, as a place that no feature stands for."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import OneHotEncoder, StringIndexer
    spots = [f"__{c}" for c in cats]
    index = StringIndexer(inputCols=spots, outputCols=[f"{s}_i" for s in spots], stringOrderType="alphabetAsc",
                          handleInvalid="keep")
    hot = OneHotEncoder(inputCols=[f"{s}_i" for s in spots], outputCols=[f"{s}_v" for s in spots], dropLast=False)
    Pipeline(stages=[index, hot]).fit(_spelled(frame, cats)).write().overwrite().save(path)


def _spelled(frame: DataFrame, cats: list[str]) -> DataFrame:
    """The categories as text that sorts as they do: whole numbers are filled up with zeros."""
    kinds = dict(frame.dtypes)
    return frame.withColumns({f"__{c}": F.lpad(F.col(c).cast("string"), 19, "0") if kinds[c] in ("int", "bigint", "smallint",
                             "tinyint") else F.col(c).cast("string") for c in cats})


def encode_long(frame: DataFrame, path: str, keys: list[str], cats: list[str] = CATEGORICAL_FEATURES) -> DataFrame:
    """(keys..., feature, value) by the saved encoder: a row for each category whose value it knows and that is
    not the column's first. Null and unseen values have no row."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.functions import vector_to_array
    model = PipelineModel.load(path)
    kinds, labels = dict(frame.dtypes), model.stages[0].labelsArray
    plain = lambda c, v: str(int(v)) if kinds[c] in ("int", "bigint", "smallint", "tinyint") else v
    coded = model.transform(_spelled(frame, cats))
    entries = []
    for c, values in zip(cats, labels):
        names = F.array(*[F.lit(f"{c}_{plain(c, v)}") for v in values]) if values else F.array().cast("array<string>")
        place = F.array_position(vector_to_array(f"__{c}_v"), 1.0)  # from 1; the last one stands for unseen values
        entries.append(F.when((place > 1) & (place <= len(values)), F.try_element_at(names, place.cast("int"))))
    out = coded.select(*keys, F.explode(F.array(*entries)).alias("feature"))
    return out.where("feature IS NOT NULL").select(*keys, "feature", F.lit(1.0).alias("value"))


def encoded_vectors(frame: DataFrame, path: str, keys: list[str], numeric: list[str] = NUMERIC_FEATURES,
                    cats: list[str] = CATEGORICAL_FEATURES, out: str = "features") -> tuple[DataFrame, list[str]]:
    """keys and ``out``, a sparse vector of the numeric columns (null as 0) and of the saved encoder's features, and
    their names. A row costs its own values, however many a column has; the names are the encoder's own list."""
    from pyspark.ml import PipelineModel
    from pyspark.ml.feature import VectorAssembler, VectorSlicer
    model = PipelineModel.load(path)
    kinds = dict(frame.dtypes)
    names, chosen, at = list(numeric), list(range(len(numeric))), len(numeric)
    for c, values in zip(cats, model.stages[0].labelsArray):
        whole = kinds[c] in ("int", "bigint", "smallint", "tinyint")
        names += [f"{c}_{int(v) if whole else v}" for v in values[1:]]
        chosen += range(at + 1, at + len(values))  # neither the first value nor the place for unseen ones
        at += len(values) + 1
    coded = model.transform(_spelled(frame, cats)).select(
        *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"__n_{c}") for c in numeric], *[f"__{c}_v" for c in cats])
    whole = VectorAssembler(inputCols=[f"__n_{c}" for c in numeric] + [f"__{c}_v" for c in cats], outputCol="__all").transform(coded)
    return VectorSlicer(inputCol="__all", outputCol=out, indices=chosen).transform(whole).select(*keys, out), names
