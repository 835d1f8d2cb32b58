"""Stage 1 (distance, cleaning, delivery labels) and stage 2 (enrichment) plans.

``labelled`` goes from the order-line scan to the DIFOT label:
  fact -> left joins to customer / distributor GPS -> haversine distance
  -> median fill -> IQR outlier filter -> delivery days
  -> days off (running-count spine) -> processing days -> labels.

Distance depends only on the (customer, distributor) pair, so the median and
the quartiles are taken over one row per pair weighted by its line count. The pair
table is a stage, written once; the selections of the median and of both quartiles run
a few grouped sums over it when they are first needed, and their values enter the line
plan as literals. The result is identical to the row-level statistics.
"""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shipshape.functions.columns import clamp0, flag01, order_key
from shipshape.functions.geo import haversine_km
from shipshape.operators import cleaning, joins, ranks
from shipshape.plans.stages import materialized, remembered
from shipshape.session import scratch_dir
from shipshape.sources import fixtures

LABEL_COLUMNS = ["distance_km", "delivery_day", "order_key", "days_off_count", "day_processing",
                 "ontime", "infull", "difot"]
GPS_COLUMNS = ["gps_cus_latitude", "gps_cus_longitude", "gps_dist_latitude", "gps_dist_longitude"]

# fixed values: label thresholds of the reference
ONTIME_MAX_DAYS = 2
INFULL_MAX_DIFF = 0.1
IQR_K = 2.0


@dataclass
class Inputs:
    fact: DataFrame
    gps_customer: DataFrame
    gps_distributor: DataFrame
    day_off: DataFrame
    urban: DataFrame
    free_goods: DataFrame
    source: tuple[SparkSession, str] | None = None  # where stages and values are remembered
    own: dict = field(default_factory=dict)
    heads: DataFrame | None = None  # the orders that the fact is made of, and what gives their lines
    lines: Callable[[DataFrame], DataFrame] | None = None

    def stage(self, name: str, build) -> DataFrame:
        """A table written once for these inputs."""
        if self.source:
            return materialized(*self.source, name, build)
        if name not in self.own:
            path = scratch_dir(self.fact.sparkSession, f"stage-{name}")
            build().write.parquet(path)
            self.own[name] = self.fact.sparkSession.read.parquet(path)
        return self.own[name]

    def value(self, name: str, compute):
        """A value computed once for these inputs."""
        if self.source:
            return remembered(*self.source, name, compute)
        if name not in self.own:
            self.own[name] = compute()
        return self.own[name]

    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str, materialize: bool = True) -> "Inputs":
        """The six inputs as plans over the driver's tables, so that a query reads and shuffles only the columns it
        needs; with ``materialize`` the calendar, a few hundred days, and what stages and values come of the inputs are
        written once per session (see ``stages``)."""
        calendar = lambda: fixtures.day_off(spark, sf_dir)
        return cls(fixtures.order_lines(spark, sf_dir), fixtures.gps_customer(spark, sf_dir),
                   fixtures.gps_distributor(spark, sf_dir),
                   materialized(spark, sf_dir, "day_off", calendar) if materialize else calendar(),
                   fixtures.urbanization(spark, sf_dir), fixtures.free_goods(spark, sf_dir),
                   (spark, sf_dir) if materialize else None, heads=fixtures.order_heads(spark, sf_dir),
                   lines=lambda heads: fixtures.lines_of(spark, sf_dir, heads))


def add_distance(df: DataFrame) -> DataFrame:
    """Haversine distance, evaluated once per row.

    The fill and the IQR filter each refer to the distance more than once, and
    filter push-down substitutes the expression at every reference (about
    thirty trigonometric calls per row instead of six). Emitting it through a
    one-element ``explode`` makes it a generated column the optimizer cannot
    inline; exactly one row comes out per input row, a NULL distance included."""
    return df.select("*", F.explode(F.array(haversine_km(*GPS_COLUMNS))).alias("distance_km"))


Step = Callable[[DataFrame], DataFrame]  # joins by an order's columns alone: its date, number and customer


def lines_after(inp: Inputs, step: Step) -> DataFrame:
    """The fact after a step. Such joins give the same rows before an order meets its lines as after, so where the
    orders are known they take the step: rows a few times fewer are shuffled, and the lines once, by their order."""
    return inp.lines(step(inp.heads)) if inp.lines else step(inp.fact)


def with_distance(inp: Inputs, step: Step | None = None) -> DataFrame:
    """Fact + four coordinates + raw haversine distance (NULL when a point is missing), after a further step if given."""
    located = lambda d: joins.with_customer_gps(d, inp.gps_customer)
    lines = lines_after(inp, (lambda d: step(located(d))) if step else located)
    return add_distance(joins.with_distributor_gps(lines, inp.gps_distributor))


def line_codes(inp: Inputs) -> DataFrame:
    """The two codes of every line, which the statistics of the distance read more than once (a stage)."""
    return inp.stage("line-codes", lambda: inp.fact.select("customer_code", "distributor_code"))


def pair_distances(inp: Inputs) -> DataFrame:
    """One row per (customer, distributor) pair: coordinates, distance, line count (a stage)."""
    def build():
        pairs = line_codes(inp).groupBy("customer_code", "distributor_code").agg(F.count(F.lit(1)).alias("n_lines"))
        return add_distance(joins.with_gps(pairs, inp.gps_customer, inp.gps_distributor))
    return inp.stage("pairs", build)


def distance_rows(inp: Inputs) -> DataFrame:
    """What the statistics of the distance are counted over: the pairs, weighted by their lines, where they are
    less than half as many; else the lines themselves, without the shuffle that would pair them (a stage)."""
    def fewer() -> bool:
        r = line_codes(inp).agg(F.count(F.lit(1)).alias("n"),
                         F.approx_count_distinct(F.struct("customer_code", "distributor_code")).alias("pairs")).first()
        return 2 * r.pairs < r.n
    if inp.value("fewer-pairs", fewer):
        return pair_distances(inp)
    return inp.stage("line-distances", lambda: add_distance(joins.with_gps(
        line_codes(inp), inp.gps_customer, inp.gps_distributor)).select(*GPS_COLUMNS, "distance_km", F.lit(1).cast("long").alias("n_lines")))


def _statistics(inp: Inputs, strict: bool = False) -> tuple[int, float | None, float | None, float | None]:
    """Lines in the median's population, their median, and the quartiles of the distances after its fill, exact.

    Both populations are selected in one set of rounds. The fill puts w lines at the median m, so the k-th filled
    distance is m or one of the good distances of ranks k and k - w."""
    def compute():
        bad, w = cleaning.needs_fill(), F.col("n_lines")
        valid = F.when(cleaning.valid_gps_condition(strict), w).otherwise(0)
        probs = [0.25, 0.75]

        def ranks_of(totals):
            n, good, filled = totals
            needed = ranks.places(good + filled, probs)
            return [ranks.places(n, [0.5]), needed + [k - filled for k in needed] + ranks.places(good, probs)]
        (n, good, filled), (mid, at) = ranks.ranked_values(
            distance_rows(inp), "distance_km", [valid, F.when(~bad, w).otherwise(0)], ranks_of, [F.when(bad, w).otherwise(0)])
        (median,) = ranks.interpolated(n, [0.5], mid)
        if median is None:  # nothing to fill with: the good distances alone
            return n, None, *ranks.interpolated(good, probs, at)

        def filled_at(k: int) -> float:
            if k in at and at[k] < median:
                return at[k]
            return at[k - filled] if k - filled in at and at[k - filled] > median else median
        total = good + filled
        return n, median, *ranks.interpolated(total, probs, {k: filled_at(k) for k in ranks.places(total, probs)})
    return inp.value(f"distance-statistics-{strict}", compute)


def median_distance(inp: Inputs, strict: bool = False) -> tuple[int, float | None]:
    """Lines in the median's population and their exact median distance."""
    return _statistics(inp, strict)[:2]


def quartiles(inp: Inputs, median: float | None = None, rel_error: float | None = None) -> tuple[float, float]:
    """Q1 and Q3 of the filled distances: exact, or within ``rel_error`` over the lines
    (``percentile_approx`` takes no weights). A run on given inputs keeps them."""
    if median is None and rel_error is None:
        return _statistics(inp)[2:]
    median = median_distance(inp)[1] if median is None else median

    def compute():
        if rel_error is not None:
            return cleaning.approx_quartiles(filled_lines(inp, median), "distance_km", rel_error)
        return tuple(ranks.quantiles(cleaning.fill_distance(distance_rows(inp), median), "distance_km",
                                     [0.25, 0.75], "n_lines")[1])
    return inp.value(f"quartiles-{median}-{rel_error}", compute)


def filled_lines(inp: Inputs, median: float | None = None, step: Step | None = None) -> DataFrame:
    """All lines, with bad distances replaced by the median."""
    return cleaning.fill_distance(with_distance(inp, step), median_distance(inp)[1] if median is None else median)


def cleaned(inp: Inputs, median: float | None = None, k: float = IQR_K, rel_error: float | None = None,
            step: Step | None = None) -> DataFrame:
    """Lines with filled distance that lie inside the IQR bounds."""
    lo, hi = cleaning.bounds(*quartiles(inp, median, rel_error), k)
    return cleaning.between(filled_lines(inp, median, step), "distance_km", lo, hi)


def add_labels(df: DataFrame, day_off: DataFrame) -> DataFrame:
    """Delivery days, days off, processing days and the three 1.0/0.0 labels."""
    d = df.withColumn("delivery_day", F.datediff("settlement_date", "order_date").cast("double"))
    d = joins.days_off(d, day_off)
    d = d.withColumn("order_key", order_key())
    d = d.withColumn("day_processing", clamp0(F.col("delivery_day") - F.col("days_off_count")))
    ontime = F.col("day_processing") <= ONTIME_MAX_DAYS
    infull = F.col("diff_ec") <= INFULL_MAX_DIFF
    return (d.withColumn("ontime", flag01(ontime))
             .withColumn("infull", flag01(infull))
             .withColumn("difot", flag01((F.col("ontime") == 1.0) & (F.col("infull") == 1.0))))


def labelled(inp: Inputs, median=None, k: float = IQR_K, rel_error: float | None = None,
             step: Step | None = None) -> DataFrame:
    """Stage-1 output: fact + coordinates + LABEL_COLUMNS, and those of ENRICHED_EXTRA that a step brings."""
    out = add_labels(cleaned(inp, median, k, rel_error, step), inp.day_off)
    return out.select(*fixtures.FACT_COLUMNS, *GPS_COLUMNS, *LABEL_COLUMNS, *[c for c in ENRICHED_EXTRA if c in out.columns])


ENRICHED_EXTRA = ["city", "province_standard", "urban_rate", "isfreegood_order_no"]


def with_rates(inp: Inputs) -> DataFrame:
    """Labelled lines with an urbanisation rate."""
    return labelled(inp, step=lambda d: joins.with_urban(d, inp.urban))


def enriched(inp: Inputs, dedupe_free_goods: bool = False, labelled_df: DataFrame | None = None,
             flag_last: bool = False) -> DataFrame:
    """Stage-2 output: labelled lines with an urbanisation rate, plus the free-good flag. With ``flag_last`` the flag
    is joined to the lines at the end, where Spark drops that join if neither the flag nor repeated lines count."""
    rate = lambda d: joins.with_urban(d, inp.urban)
    flag = lambda d: joins.with_free_good(d, inp.free_goods, dedupe=dedupe_free_goods)
    if labelled_df is not None:
        return flag(rate(labelled_df))
    return flag(with_rates(inp)) if flag_last else labelled(inp, step=lambda d: flag(rate(d)))
