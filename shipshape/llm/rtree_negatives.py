"""Hard negatives by best-first search in STR-packed R-trees.

Items are tiled by the sort-tile-recursive rule: ranges of the coordinate that varies most are the
shards (ties go on by the next coordinate and the id, so equal vectors spread over shards), and
inside a shard rows are sorted label by label and tiled by the next coordinates into leaves of
``LEAF`` rows. Boxes of leaves, and of every ``FANOUT`` boxes below, bound each coordinate, so a
box gives the least and the greatest inner product that an anchor can have with what is in it. An
anchor's queue opens the box of greatest possible score first; boxes whose labels don't qualify,
whose interval misses the score windows, or whose greatest score is strictly below the kth found
are never opened. Each shard answers with its k best and the answers are merged by a window.

Anchors are a stated query set: every block of ``BLOCK`` anchors meets every shard in a cogroup, so
a task holds one shard and one block whatever the table's size.
"""
from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from shipshape.llm.common import ship, staged

LEAF, FANOUT = 128, 16
#: Rows of a shard and anchors of a block.
SHARD, BLOCK = 65_536, 16_384
#: Coordinates that rows are tiled by.
TILED = 3
SCALE = 256
_LONG = 2 ** 63 - 1


def _bounded(score) -> int:
    return max(-_LONG, min(_LONG, int(score)))


def str_order(matrix, labels, ids, dims):
    """The order of rows that packs them: by label, then tiled by ``dims`` into slabs of equal
    height, the last one sorted; ties by id. Gives the order and the start of each leaf."""
    import numpy as np
    n = len(ids)
    leaves = []

    def tile(rows, left):
        if len(rows) <= LEAF or not left:
            leaves.extend(rows[i:i + LEAF] for i in range(0, len(rows), LEAF))
            return
        rows = rows[np.lexsort((ids[rows], matrix[rows, left[0]]))]
        if len(left) == 1:
            tile(rows, [])
            return
        slabs = math.ceil((len(rows) / LEAF) ** (1 / len(left)))
        for part in np.array_split(rows, slabs):
            tile(part, left[1:])

    order = np.lexsort((ids, labels))
    cuts = np.flatnonzero(np.diff(labels[order])) + 1
    for rows in np.split(order, cuts) if n else []:
        tile(rows, list(dims))
    starts = np.cumsum([0] + [len(x) for x in leaves[:-1]]) if leaves else np.zeros(0, int)
    return (np.concatenate(leaves) if leaves else np.zeros(0, int)), starts


class RTree:
    """Levels of boxes over packed rows; level 0 are the leaves, the last level is the root's children."""

    def __init__(self, matrix, labels, ids, starts):
        import numpy as np
        self.np, self.x, self.labels, self.ids = np, matrix, labels, ids
        self.starts = np.append(starts, len(ids))
        self.levels = []
        if not len(ids):
            return
        cuts = starts
        box = (np.minimum.reduceat(matrix, cuts), np.maximum.reduceat(matrix, cuts), np.minimum.reduceat(labels, cuts),
               np.maximum.reduceat(labels, cuts), np.minimum.reduceat(ids, cuts))
        self.levels.append(box)
        while len(box[0]) > FANOUT:
            cuts = np.arange(0, len(box[0]), FANOUT)
            box = tuple(f.reduceat(b, cuts) for f, b in zip((np.minimum, np.maximum, np.minimum, np.maximum, np.minimum), box))
            self.levels.append(box)

    def bounds(self, level: int, a: int, b: int, q):
        """Least and greatest inner product of ``q`` with the boxes a to b of a level."""
        lo, hi = self.levels[level][0][a:b] * q, self.levels[level][1][a:b] * q
        return self.np.minimum(lo, hi).sum(1), self.np.maximum(lo, hi).sum(1)

    def best(self, q, windows, k: int, admit, admits_box, own: int):
        """For each window (least, greatest score; None: open) its k best (score, id), best first.

        ``admit`` maps labels to a mask, ``admits_box`` a box's least and greatest label to whether it
        can hold a row that qualifies. Rows whose id is ``own`` are left out."""
        np = self.np
        found: list[list] = [[] for _ in windows]  # heaps of (score, -id): the worst on top
        if not self.levels:
            return found

        def wanted(lo, hi, first) -> bool:
            """Whether a box of that interval and least id can change a window's k best."""
            for heap, (least, most) in zip(found, windows):
                if (most is not None and lo > most) or (least is not None and hi < least):
                    continue
                top = hi if most is None else min(hi, most)
                if len(heap) < k or top > heap[0][0] or (top == heap[0][0] and -first > heap[0][1]):
                    return True
            return False

        queue: list = []

        def push(level, a, b):
            low, high = self.bounds(level, a, b, q)
            labels_lo, labels_hi, firsts = (c[a:b] for c in self.levels[level][2:])
            for i, (lo, hi, x, y, first) in enumerate(zip(low.tolist(), high.tolist(), labels_lo.tolist(),
                                                          labels_hi.tolist(), firsts.tolist())):
                if admits_box(x, y) and wanted(lo, hi, first):
                    heapq.heappush(queue, (-hi, lo, first, level, a + i))

        push(len(self.levels) - 1, 0, len(self.levels[-1][0]))
        while queue:
            high, lo, first, level, i = heapq.heappop(queue)
            if not wanted(lo, -high, first):
                continue
            if level:
                push(level - 1, i * FANOUT, min((i + 1) * FANOUT, len(self.levels[level - 1][0])))
                continue
            a, b = self.starts[i], self.starts[i + 1]
            score, ids = self.x[a:b] @ q, self.ids[a:b]
            ok = admit(self.labels[a:b]) & (ids != own)
            for heap, (least, most) in zip(found, windows):
                mask = ok
                if least is not None:
                    mask = mask & (score >= least)
                if most is not None:
                    mask = mask & (score <= most)
                if len(heap) >= k:
                    mask = mask & (score >= heap[0][0])
                for s, j in zip(score[mask].tolist(), ids[mask].tolist()):
                    if len(heap) < k:
                        heapq.heappush(heap, (s, -j))
                    elif (s, -j) > heap[0]:
                        heapq.heapreplace(heap, (s, -j))
        return [[(s, -j) for s, j in sorted(heap, reverse=True)] for heap in found]


def items_of(rows: DataFrame, label: Column) -> DataFrame:
    """(vec_id, label, dim, vec): rows that take part, vec being the floors of 256 times the components."""
    v = rows["embedding"]
    fine = F.forall(v, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return rows.where(rows["vec_id"].isNotNull() & label.isNotNull() & F.coalesce(fine, F.lit(False))).select(
        rows["vec_id"].cast("long").alias("vec_id"), label.cast("long").alias("label"), F.size(v).alias("dim"),
        F.transform(v, lambda x: _floor(x.cast("double") * SCALE)).alias("vec"))


def _floor(x: Column) -> Column:
    """The floor as a double, for values beyond a long, too (those are whole already)."""
    return F.when(F.abs(x) < 2.0 ** 53, F.floor(x).cast("double")).otherwise(x)


def _matrix(column, dim: int):
    import numpy as np
    flat = column.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(column) else np.zeros(0)
    return np.ascontiguousarray(flat, dtype=np.float64).reshape(len(column), dim)


def _exact(x, q):
    """Matrices whose inner products are exact: doubles where they are, Python's integers elsewhere."""
    import numpy as np
    if not x.size or not q.size or np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2.0 ** 53:
        return x, q
    whole = np.frompyfunc(int, 1, 1)
    return whole(x).astype(object), whole(q).astype(object)


def packed(items: DataFrame, shard_rows: int = SHARD) -> DataFrame:
    """The items with shard, leaf and place in the packing order (staged)."""
    spark = items.sparkSession
    ship(spark)
    width = items.agg(F.max("dim")).first()[0] or 0
    spread = []
    if width:  # sums for each coordinate: a row per coordinate reaches the driver
        spread = [r.i for r in items.select(F.posexplode("vec").alias("i", "x")).groupBy("i").agg(
            F.var_pop("x").alias("v")).orderBy(F.col("v").desc(), "i").limit(TILED + 1).collect()]
    n = items.count()
    shards = max(math.ceil(n / shard_rows), min(spark.sparkContext.defaultParallelism, math.ceil(n / (4 * LEAF))), 1)
    by = [F.col("dim"), *[F.col("vec").getItem(i) for i in spread[:2]], F.col("vec_id")]
    ranged = items.repartitionByRange(shards, *by)

    def pack(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        base, dims = TaskContext.get().partitionId(), t.column("dim").to_numpy()
        for dim in np.unique(dims):  # vectors of different lengths never meet
            part = t.filter(pa.array(dims == dim))
            x = _matrix(part.column("vec"), int(dim))
            labels, ids = part.column("label").to_numpy(), part.column("vec_id").to_numpy()
            order, starts = str_order(x, labels, ids, [i for i in spread[1:] if i < dim])
            leaf = np.zeros(len(order), np.int32)
            leaf[starts[1:]] = 1
            part = part.take(pa.array(order)).append_column("leaf", pa.array(np.cumsum(leaf, dtype=np.int32)))
            part = part.append_column("shard", pa.array(np.full(len(order), base, np.int32)))
            yield from part.select(["shard", "dim", "leaf", "vec_id", "label", "vec"]).to_batches(10_000)

    return staged(ranged.mapInArrow(pack, "shard int, dim int, leaf int, vec_id long, label long, vec array<double>"), "rtree")


def _search(tree_rows: DataFrame, anchors: DataFrame, schema: str, answer) -> DataFrame:
    """Every block of anchors against every shard of its dimension; ``answer(tree, anchor row, q)`` yields tuples."""
    blocks = anchors.agg(F.max("block")).first()[0]
    if blocks is None:
        return anchors.sparkSession.createDataFrame([], schema)
    shards = tree_rows.select("shard", "dim").distinct()
    left = tree_rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(int(blocks)))))
    shards = shards.groupBy("dim").agg(F.collect_list("shard").alias("shards"))  # a number for 65,536 rows
    right = anchors.join(shards, "dim").withColumn("shard", F.explode("shards")).drop("shards")
    names = [c.split()[0] for c in schema.split(", ")]

    def run(key, items, asked):
        import numpy as np
        import pyarrow as pa
        kinds = {"long": pa.int64(), "int": pa.int32()}
        fields = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in schema.split(", ")])
        out = []
        if items.num_rows and asked.num_rows:
            items = items.sort_by([("leaf", "ascending"), ("vec_id", "ascending")])
            dim = items.column("dim")[0].as_py()
            x, q = _exact(_matrix(items.column("vec"), dim), _matrix(asked.column("vec"), dim))
            starts = np.append(0, np.flatnonzero(np.diff(items.column("leaf").to_numpy())) + 1)
            tree = RTree(x, items.column("label").to_numpy(), items.column("vec_id").to_numpy(), starts)
            for row, v in zip(asked.drop_columns(["vec"]).to_pylist(), q):
                out += answer(tree, row, v)
        return pa.table({c: pa.array(v, fields.field(c).type) for c, v in zip(names, zip(*out) if out else [()] * len(names))},
                        schema=fields)

    key = ["shard", "dim", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, schema)


def _first(found: DataFrame, keys: list[str], k: int, by: list[Column], name: str) -> DataFrame:
    return found.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col(name) <= k)


def hard_negatives(rows: DataFrame, anchors: Column, label: Column | None = None, positives: int = 5, negatives: int = 10,
                   least_pct: int = 30, most_pct: int = 90, shard_rows: int = SHARD, block_rows: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` has vec_id, embedding, label (or ``label``, an expression over it); ``anchors`` is a
    condition on vec_id. A row's score is the inner product with the anchor of floor(256 x), whole
    numbers, exact at any size (beyond a long they are reported as its bounds). An anchor's positives
    are its ``positives`` best other rows of its label; for each of them the ``negatives`` best
    rows of other labels with least_pct * p <= 100 * score <= most_pct * p. Higher scores come first,
    ties by smaller vec_id. Rows with a null id, label or vector, or with a null or non-finite component take no
    part; vectors of different lengths never meet (empty ones score 0). Rows that share a vec_id count each for
    themselves, but none meets an anchor of its own id. An anchor without positives, and a positive without
    negatives in its window, have no rows; an empty table gives none. Further columns are not read.
    """
    items = staged(items_of(rows, rows["label"] if label is None else label), "items")
    tree = packed(items, shard_rows)
    asked = items.where(anchors).withColumn("aid", F.monotonically_increasing_id())
    blocks = max(1, math.ceil(asked.count() / block_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("aid"), F.lit(blocks)).cast("int")).withColumnRenamed(
        "vec_id", "anchor_id")
    asked = staged(asked, "anchors")  # numbered once

    def near(t, row, q):
        mine = row["label"]
        got = t.best(q, [(None, None)], positives, lambda x: x == mine, lambda lo, hi: lo <= mine <= hi, row["anchor_id"])
        return [(row["aid"], j, _bounded(s)) for s, j in got[0]]

    found = _search(tree, asked, "aid long, positive_id long, positive_score long", near)
    best = staged(_first(found, ["aid"], positives, [F.col("positive_score").desc(), F.col("positive_id")], "place"), "positives")
    listed = best.groupBy("aid").agg(F.collect_list(F.struct("place", "positive_score")).alias("windows"))  # at most ``positives``

    def hard(t, row, q):
        mine = row["label"]
        windows = [(-(-least_pct * w["positive_score"] // 100), most_pct * w["positive_score"] // 100) for w in row["windows"]]
        open_ = [i for i, (lo, hi) in enumerate(windows) if lo <= hi]
        got = t.best(q, [windows[i] for i in open_], negatives, lambda x: x != mine,
                     lambda lo, hi: lo != mine or hi != mine, row["anchor_id"])
        return [(row["aid"], row["windows"][i]["place"], j, _bounded(s)) for i, heap in zip(open_, got) for s, j in heap]

    found = _search(tree, asked.join(listed, "aid"), "aid long, place int, negative_id long, negative_score long", hard)
    ranked = _first(found, ["aid", "place"], negatives, [F.col("negative_score").desc(), F.col("negative_id")], "rank")
    return (ranked.join(best, ["aid", "place"]).join(asked.select("aid", "anchor_id"), "aid")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


#: DuckDB: all pairs of anchors and rows.
ORACLE = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS other, b.label AS bl,
         CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE al = bl
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other AS negative_id, positive_score,
       score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE al <> bl AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)
QUALIFY row_number() OVER w <= 10
"""
