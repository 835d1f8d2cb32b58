"""Exact order statistics by distributed selection.

One algorithm at every size: values are counted in equal-width ranges between the least and the
greatest, the ranges that hold the wanted ranks are counted again in finer ones, until each range
holds one value. A round is one grouped sum, combined map-side, with at most ``RANGES`` rows per
open range; nothing is sorted and no task sees all values.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Ranges that a round cuts an open range into.
RANGES = 4096


def ranked_values(df: DataFrame, x: str, weights: list[Column], ranks, counts: list[Column] | None = None
                  ) -> tuple[list[int], list[dict[int, float]]]:
    """Order statistics of several populations in one set of rounds.

    ``weights`` says how often a row counts in each population; null, NaN and infinite values of ``x`` don't
    count. ``counts`` are further sums over all rows, whatever their value. ``ranks`` maps the list of totals, populations
    first, to a list of 1-based ranks for each population; ranks outside 1..n are left out. Gives the totals
    and, for each population, the values at its ranks. Each round scans ``df``, so callers stage what is costly."""
    counts = counts or []
    v = F.col(x).cast("double")
    names = [f"w{j}" for j in range(len(weights))]
    fine = v.isNotNull() & (F.abs(v) < float("inf"))
    vals = df.select(F.when(fine, v).alias("v"), *[F.when(fine, F.coalesce(w.cast("long"), F.lit(0))).otherwise(0).alias(n)
                                                   for w, n in zip(weights, names)],
                     *[F.coalesce(c.cast("long"), F.lit(0)).alias(f"c{j}") for j, c in enumerate(counts)])
    used = F.greatest(*names) > 0 if len(names) > 1 else F.col("w0") > 0
    head = vals.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names],
                    *[F.coalesce(F.sum(f"c{j}"), F.lit(0)).alias(f"c{j}") for j in range(len(counts))],
                    F.min(F.when(used, F.col("v"))).alias("lo"), F.max(F.when(used, F.col("v"))).alias("hi")).first()
    totals = [head[n] for n in names] + [head[f"c{j}"] for j in range(len(counts))]
    wanted = [sorted({k for k in some if 1 <= k <= n}) for some, n in zip(ranks(totals), totals)]
    found: list[dict[int, float]] = [{} for _ in weights]
    if not any(wanted):
        return totals, found
    vals = vals.where(used).select("v", *names)
    if head["lo"] == head["hi"]:
        return totals, [dict.fromkeys(some, head["lo"]) for some in wanted]
    open_ranges = [(head["lo"], head["hi"], [0] * len(weights), wanted)]  # least, greatest, weights below, ranks within
    while open_ranges:
        which, place = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, _, _) in enumerate(open_ranges):
            inside = (F.col("v") >= lo) & (F.col("v") <= hi)
            share = (F.col("v") / 2 - lo / 2) / (hi / 2 - lo / 2)
            which = F.when(inside, i).otherwise(which)
            place = F.when(inside, F.least(F.floor(share * RANGES).cast("int"), F.lit(RANGES - 1))).otherwise(place)
        rows = (vals.select(which.alias("i"), place.alias("p"), "v", *names).where("i IS NOT NULL").groupBy("i", "p")
                .agg(*[F.sum(n).alias(n) for n in names], F.min("v").alias("lo"), F.max("v").alias("hi")).collect())
        later = []
        for i, (_, _, below, inner) in enumerate(open_ranges):
            below = list(below)
            for r in sorted((r for r in rows if r.i == i), key=lambda r: r.p):
                here = [[k for k in some if b < k <= b + r[n]] for some, b, n in zip(inner, below, names)]
                if any(here) and r.lo == r.hi:
                    for f, some in zip(found, here):
                        f.update(dict.fromkeys(some, r.lo))
                elif any(here):
                    later.append((r.lo, r.hi, list(below), here))
                below = [b + r[n] for b, n in zip(below, names)]
        open_ranges = later
    return totals, found


def values_at_ranks(df: DataFrame, x: str, ranks, weight: str | None = None) -> tuple[int, dict[int, float]]:
    """The total weight n of the finite values of ``x`` (null and NaN don't count) and the values
    at the given 1-based ranks; ``ranks`` is a list or a function of n. Ranks outside 1..n are left out.

    ``weight`` counts a row several times, as for one row per distinct value."""
    totals, found = ranked_values(df, x, [F.col(weight) if weight else F.lit(1)],
                                  lambda t: [ranks(t[0]) if callable(ranks) else ranks])
    return totals[0], found[0]


def places(n: int, probs: list[float]) -> list[int]:
    """The ranks that interpolated quantiles rest on."""
    return [i + 1 for p in probs for i in (math.floor((n - 1) * p), math.ceil((n - 1) * p))] if n else []


def interpolated(n: int, probs: list[float], at) -> list[float | None]:
    """The quantiles from the values at their ranks, as ``percentile`` gives them; None where there are no values."""
    out = []
    for p in probs:
        place = (n - 1) * p
        lo, hi = math.floor(place), math.ceil(place)
        out.append(None if not n else at[lo + 1] if lo == hi
                   else (hi - place) * at[lo + 1] + (place - lo) * at[hi + 1])
    return out


def quantiles(df: DataFrame, x: str, probs: list[float], weight: str | None = None) -> tuple[int, list[float | None]]:
    """n and the interpolated quantiles, as ``percentile`` gives them; None where there are no values."""
    n, at = values_at_ranks(df, x, lambda n: places(n, probs), weight)
    return n, interpolated(n, probs, at)


def sketch_by(df: DataFrame, keys: list[str], x: str, size: int = 400) -> DataFrame:
    """keys and ``sketch``: a mergeable quantile sketch of ``x`` for each group, to be stored; its
    normalised rank error is about 1.3 / size ^ 0.9. Nulls don't count."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys).agg(
        F.kll_sketch_agg_double(F.col(x).cast("double"), F.lit(size)).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, probs: list[float], keys: list[str] | None = None) -> DataFrame:
    """keys, n, q0, q1, ...: approximate quantiles of all values behind the sketches of a group (of
    all, without keys), merged map-side; the values are not read again."""
    merged = sketches.groupBy(*(keys or [])).agg(F.kll_merge_agg_double("sketch").alias("__merged"))
    return merged.select(*(keys or []), F.kll_sketch_get_n_double("__merged").alias("n"), *[
        F.kll_sketch_get_quantile_double("__merged", F.lit(float(p))).alias(f"q{i}") for i, p in enumerate(probs)])
