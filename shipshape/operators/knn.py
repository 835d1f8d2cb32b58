"""Exact k-nearest neighbours by a pivot-partitioned join.

The points to search belong to the cell of their nearest pivot; a cell keeps the least and the
greatest distance to its pivot, its box and its number of points. A query first visits the nearest cells
that hold k points, which bounds its k-th distance; it then needs only the cells whose points can lie within
that bound, by the triangle inequality, by the box and by the plane between the cell's pivot and its own. Both visits are equi-joins on the cell. Cells are
cut into parts of about ``PART`` points, and the queries of a part into groups of about ``GROUP``,
so no task grows with a crowded cell. Within a part, points and queries are halved along their widest columns into
blocks, and a block of queries meets the blocks of points by their distance, until none can be nearer than what it has
found; pairs are sifted by products of matrices before their distance is computed. A group returns only its k best for each query.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipshape.operators.ranks import ranked_values
from shipshape.session import ship, staged

#: Pivots, taken from the points in the order of a hash: one for ``CELL`` points, within bounds.
PIVOTS = (16, 4096)
CELL = 4096
PART, GROUP = 8192, 8192
#: Queries of a block, points of a block, and rows whose distances to all pivots are computed at once.
CHUNK, LEAF, ROWS = 64, 32, 1024
#: Distances that agree to so many decimals are ties.
DIGITS = 9
#: Room for rounding in the triangle inequality.
SLACK = 1e-8


#: The same for distances to pivots, which come from products, as a share of the vectors' lengths.
LOOSE = 1e-6
#: And for squares of distances from products, as a share of the squares of the vectors' lengths.
ROOM = 1e-12


def _matrix(column, d: int):
    import numpy as np
    return np.stack(column.to_numpy()).astype(float, copy=False) if len(column) else np.zeros((0, d))


def _distances(q, x):
    import numpy as np
    return np.sqrt(((q[:, None, :] - x[None, :, :]) ** 2).sum(-1))


def _paired(q, x):
    """The distance of each row of ``q`` to the row of ``x`` at its place."""
    import numpy as np
    return np.sqrt(((q - x) ** 2).sum(1))


def _to_pivots(q, p):
    """Distances by products of matrices: quick, right up to ``LOOSE``, good for the choice of cells only."""
    import numpy as np
    square = (q ** 2).sum(1)[:, None] + (p ** 2).sum(1) - 2 * (q @ p.T)
    return np.sqrt(np.maximum(np.nan_to_num(square, nan=np.inf), 0))


def _blocks(x, size: int) -> list:
    """The row numbers of ``x`` in blocks of at most ``size``, halved along the widest column."""
    import numpy as np
    out, left = [], [np.arange(len(x))]
    while left:
        rows = left.pop()
        if len(rows) <= size:
            out.append(rows)
            continue
        v, half = x[rows], len(rows) // 2
        order = np.argpartition(v[:, np.ptp(v, axis=0).argmax()], half)
        left += [rows[order[:half]], rows[order[half:]]]
    return out


def _search(q, bound, x, val, k: int):
    """(query rows, point rows, distances) by blocks of queries: of the points not beyond a query's bound the k
    best by (distance, value); what lies beyond it may come along. Pairs are sifted by products of matrices around the
    points' mean, with room for their rounding; only those left have their distance computed."""
    import numpy as np
    leaves = _blocks(x, LEAF)
    low, high = np.array([x[r].min(0) for r in leaves]), np.array([x[r].max(0) for r in leaves])
    own, ends = np.concatenate(leaves), np.cumsum([0, *map(len, leaves)])
    x, val = x[own], val[own]
    centre = x.mean(0)
    near_x = x - centre
    square = (near_x ** 2).sum(1)
    longest = square.max()
    for rows in _blocks(q, CHUNK):
        mine, limit = q[rows], bound[rows]
        gap = np.maximum(0, np.maximum(low - mine.max(0), mine.min(0) - high))
        far = np.sqrt((gap ** 2).sum(1))
        order = np.argsort(far, kind="stable")
        far = far[order]
        near_q = mine - centre
        length = (near_q ** 2).sum(1)
        sift = bool(np.isfinite(longest + length.max()))
        room = ROOM * (1 + length + longest)
        row, at, dist = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
        i, step = 0, 1
        while i < len(order):
            reach = limit * (1 + SLACK) + SLACK
            end = min(i + step, int(np.searchsorted(far, reach.max(), side="right")))
            if end <= i:
                break
            cols = np.concatenate([np.arange(ends[j], ends[j + 1]) for j in order[i:end]])
            if sift:
                about = square[cols] - 2 * (near_q @ near_x[cols].T) + (length - room)[:, None]  # squares, not above the true ones
                if len(cols) >= k and np.isinf(limit).any():
                    kth = np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * room
                    reach = np.minimum(reach, np.sqrt(np.maximum(kth, 0)) * (1 + SLACK) + SLACK)
                r, c = np.nonzero(about <= (reach ** 2)[:, None])
                new = np.round(_paired(mine[r], x[cols[c]]), DIGITS)
            else:
                r, c = np.divmod(np.arange(len(rows) * len(cols)), len(cols))
                new = np.round(_distances(mine, x[cols]), DIGITS).ravel()
            i, step = i + step, min(2 * step, 16)
            hit = new <= reach[r]
            if not hit.any():
                continue
            row, at, dist = (np.concatenate([old, e[hit]]) for old, e in ((row, r), (at, cols[c]), (dist, new)))
            best = np.lexsort((val[at], dist, row))
            row, at, dist = row[best], at[best], dist[best]
            place = np.arange(len(row)) - np.searchsorted(row, np.arange(len(rows)))[row]  # k points hold k or more
            kth, limit = place == k - 1, limit.copy()
            limit[row[kth]] = np.minimum(limit[row[kth]], dist[kth])
            row, at, dist = row[place < k], at[place < k], dist[place < k]
        yield rows[row], own[at], dist


def _merged(found: DataFrame, k: int) -> DataFrame:
    """Of each query's candidates the k best by (distance, value), with multiplicities."""
    w = Window.partitionBy("qid").orderBy("dist", "val").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    top = found.withColumn("before", F.sum("m").over(w) - F.col("m")).where(F.col("before") < k)
    return top.withColumn("take", F.least(F.col("m"), k - F.col("before")))


def _visits(queries: DataFrame, points: DataFrame, parts: DataFrame, k: int) -> DataFrame:
    """(qid, dist, val, m): the k best of every (query, cell, part) within the query's bound; ``queries`` has (qid,
    vec, bound, cell), bound NaN where there is none yet."""
    units = queries.join(parts, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sizes = units.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
    sizes = staged(sizes, "knn-units")  # one row per part of a cell
    group = F.pmod(F.xxhash64("qid"), F.col("groups")).cast("int")
    left = units.join(sizes, ["cell", "part"]).select("cell", "part", group.alias("grp"), "qid", "vec", "bound")
    right = points.join(sizes, ["cell", "part"]).withColumn("grp", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    right = right.select("cell", "part", "grp", "vec", "m", "val")

    def nearest(q, x):
        import numpy as np
        import pandas as pd
        if not len(q) or not len(x):
            return pd.DataFrame({"qid": [], "dist": [], "val": [], "m": []})
        bound = np.nan_to_num(q["bound"].to_numpy(float), nan=np.inf)
        width = len(q["vec"].iloc[0])
        found = _search(_matrix(q["vec"], width), bound, _matrix(x["vec"], width), x["val"].to_numpy(float), k)
        row, point, dist = map(np.concatenate, zip(*found))
        near = dist <= bound[row] * (1 + SLACK) + SLACK
        row, point = row[near], point[near]
        return pd.DataFrame({"qid": q["qid"].to_numpy()[row], "dist": dist[near], "val": x["val"].to_numpy(float)[point],
                             "m": x["m"].to_numpy()[point]})

    key = ["cell", "part", "grp"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(
        nearest, "qid long, dist double, val double, m long")


def _mean() -> Column:
    """Of a query's rows of ``_merged``."""
    return F.sum(F.col("dist") * F.col("take")) / F.sum("take")


def _cap(met: DataFrame, wanted: dict[str, int], room: float) -> float:
    """A mean that, with ``room`` to spare, as many rows don't exceed as are wanted of each column; ``mean`` of ``met`` is not below
    the true one. Infinity if there are fewer."""
    at = ranked_values(met, "mean", [F.col(c) for c in wanted], lambda totals: [[n] for n in wanted.values()])[1]
    if not all(at):
        return math.inf
    return max(v for found in at for v in found.values()) * (1 + SLACK) + SLACK + room


def knn_mean(a: DataFrame, b: DataFrame, d: int, k: int = 3, value: str | None = None,
             pivots: int | None = None, wanted: dict[str, int] | None = None, room: float = 0.0) -> DataFrame:
    """(_v0.._v{d-1}, knn_mean[, knn_value]) for each distinct point of ``a``; ``b`` has _v* and
    multiplicity ``_m``. Exact in any number of dimensions; if ``b`` holds fewer than k points, over
    those, and without points no row. With ``value`` (a column of ``b``), neighbours at equal
    distance are taken in ascending ``value`` order and ``knn_value`` is the sum of their values
    (e.g. the number of positive labels among the k).

    ``wanted`` asks for the rows of least means only: it maps columns of ``a`` that count rows to how many of them are wanted
    at least. Points whose mean is greater, by more than ``room``, than that of all those rows may then be left out, which spares
    them the search; every mean that is given is right. The k nearest of the first visit have no lesser mean than
    the true one, so a mean that enough rows reach there is a ``cap``. A query's mean is not above it only if a point is
    as near as the cap: the second visit looks no farther, and a third one goes on for those that have found one,
    as far as the cap allows with what they have."""
    spark = a.sparkSession
    ship(spark)
    names = [f"_v{i}" for i in range(d)]
    vec = F.array(*[F.col(c).cast("double") for c in names]).alias("vec")
    queries = a.select(*names).distinct() if not wanted else a.groupBy(*names).agg(*[F.sum(c).alias(c) for c in wanted])
    queries = staged(queries.select(vec, F.monotonically_increasing_id().alias("qid"), *(wanted or {})), "knn-queries")
    points = staged(b.select(vec, F.col("_m").cast("long").alias("m"),
                             (F.col(value).cast("double") if value else F.lit(0.0)).alias("val")), "knn-points")
    if pivots is None:
        pivots = min(PIVOTS[1], max(PIVOTS[0], math.ceil(points.count() / CELL)))
    centres = [list(r[0]) for r in points.select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(pivots).collect()]
    out = names + ["knn_mean"] + ["knn_value"] * bool(value)
    if not centres:
        return spark.createDataFrame([], ", ".join(f"{c} double" for c in out))

    def placed(batches):
        import numpy as np
        p = np.array(centres)
        for x in batches:
            v = _matrix(x["vec"], d)
            dist = [_to_pivots(v[i:i + ROWS], p) for i in range(0, len(v), ROWS)]
            x["cell"] = np.concatenate([np.zeros(0, "int32"), *[a.argmin(1) for a in dist]]).astype("int32")
            x["r"] = np.concatenate([np.zeros(0), *[a.min(1) for a in dist]])
            yield x

    points = staged(points.mapInPandas(placed, "vec array<double>, m long, val double, cell int, r double"), "knn-cells")
    cells = points.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"), F.sum("m").alias("n"), F.min("r").alias("lo"),
                                       F.max("r").alias("hi"), F.array(*[F.min(F.col("vec")[i]) for i in range(d)]).alias("low"),
                                       F.array(*[F.max(F.col("vec")[i]) for i in range(d)]).alias("high")).orderBy(
        "cell").collect()  # one row per pivot
    parts = spark.createDataFrame([(c.cell, math.ceil(c.rows / PART)) for c in cells], "cell int, parts int")
    parts = F.broadcast(parts)  # one row per pivot
    points = points.join(parts, "cell").select(
        "cell", F.pmod(F.xxhash64("vec", "val"), F.col("parts")).cast("int").alias("part"), "vec", "m", "val")
    number, held = [c.cell for c in cells], [c.n for c in cells]
    rings, boxes = ([c.lo for c in cells], [c.hi for c in cells]), ([list(c.low) for c in cells], [list(c.high) for c in cells])

    def visited(batches):
        """The cells to visit: at first (no bound yet) the nearest that hold k points, later all
        others that the bound reaches."""
        import numpy as np
        p, ids, n = np.array(centres)[number], np.array(number), np.array(held)
        (inner, outer), (low, high) = map(np.array, rings), map(np.array, boxes)
        longest = np.sqrt((p ** 2).sum(1)).max()

        def cells_of(v, bound):
            dist = _to_pivots(v, p)
            one = dist.argmin(1)
            first = np.zeros(dist.shape, dtype=bool)
            first[np.arange(len(v)), one] = True
            few = np.flatnonzero(n[one] < k)  # more than one cell is needed
            if len(few):
                order = np.argsort(dist[few], axis=1, kind="stable")
                before = np.take_along_axis(np.broadcast_to(n, order.shape), order, 1).cumsum(1)
                some = np.zeros(order.shape, dtype=bool)
                np.put_along_axis(some, order, np.hstack([np.zeros((len(few), 1)), before[:, :-1]]) < k, 1)
                first[few] = some
            start = np.isnan(bound)
            reach = bound * (1 + SLACK) + SLACK
            if not start.all():
                loose = (LOOSE * (1 + longest + np.sqrt((v ** 2).sum(1))))[:, None]
                ring = np.maximum(dist - outer, inner - dist) <= reach[:, None] + 2 * loose
                first = np.where(start[:, None], first, ring & ~first)
            row, cell = np.nonzero(first)
            gap = np.maximum(0, np.maximum(low[cell] - v[row], v[row] - high[cell]))
            near = start[row] | (np.sqrt((gap ** 2).sum(1)) <= reach[row])
            row, cell = row[near], cell[near]
            # a cell's points are no nearer to the query's own pivot than to theirs: they lie beyond the plane between the two
            mine = one[row]
            ahead = dist[row, cell] ** 2 - dist[row, mine] ** 2 - LOOSE ** 2 * (1 + longest + np.sqrt((v ** 2).sum(1)[row])) ** 2
            near = start[row] | ~(ahead > 2 * np.sqrt(((p[cell] - p[mine]) ** 2).sum(1)) * reach[row])
            row, cell = row[near], cell[near]
            return np.split(ids[cell], np.searchsorted(row, np.arange(1, len(v))))

        for q in batches:
            v, bound = _matrix(q["vec"], d), q["bound"].to_numpy(float)
            q["cells"] = [c.tolist() for i in range(0, len(v), ROWS) for c in cells_of(v[i:i + ROWS], bound[i:i + ROWS])]
            yield q[["qid", "vec", "bound", "cells"]]

    def visits(rows: DataFrame) -> DataFrame:
        to = rows.select("qid", "vec", "bound").mapInPandas(visited, "qid long, vec array<double>, bound double, cells array<int>")
        to = staged(to.select("qid", "vec", "bound", F.explode("cells").alias("cell")), "knn-visits")
        return staged(_visits(to, points, parts, k), "knn-found")

    one = visits(queries.withColumn("bound", F.lit(float("nan"))))
    met = _merged(one, k).groupBy("qid").agg(F.max("dist").alias("bound"), _mean().alias("mean"))
    cap = math.inf
    if wanted:
        met = staged(queries.select("qid", *wanted).join(met.hint("merge"), "qid"), "knn-bounds")
        cap = _cap(met, wanted, room)
    bound = met.select("qid", F.least("bound", F.lit(cap)).alias("bound"))
    two = visits(queries.join(bound.hint("merge"), "qid"))
    if cap < math.inf:
        near = F.when(F.col("dist") <= cap, F.col("take"))
        some = _merged(one.unionByName(two), k).groupBy("qid").agg(F.max("dist").alias("far"), F.sum(near).alias("n"), F.sum(F.col("dist") * near).alias("s"))
        some = some.where((F.col("far") > cap) & (F.col("n") > 0))  # n within the cap, the others beyond it
        some = staged(some.select("qid", F.least("far", (F.col("n") + 1) * cap - F.col("s")).alias("bound")), "knn-open")
        three = visits(queries.join(some.hint("merge"), "qid"))  # has what the second visit found, too
        two = two.join(some.select("qid").hint("merge"), "qid", "left_anti").unionByName(three)
    best = _merged(one.unionByName(two), k).groupBy("qid").agg(_mean().alias("knn_mean"), F.sum(F.col("val") * F.col("take")).alias("knn_value"))
    if cap < math.inf:
        best = best.where(F.col("knn_mean") <= cap)
    return queries.join(best.hint("merge"), "qid").select(*[F.col("vec")[i].alias(c) for i, c in enumerate(names)], *out[d:])
