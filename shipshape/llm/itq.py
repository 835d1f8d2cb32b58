"""Embedding near-de-duplication by iterative quantisation.

A rotation learned on a bounded sample turns unit vectors into balanced binary codes. Codes are
cut into ``BLOCKS`` blocks and every choice of ``AGREE`` blocks is a table of a multi-index: two
codes that agree in as many blocks meet in a bucket. In the buckets, pairs within ``RADIUS`` bits
are reranked by the cosine of the original vectors, in double precision.

Equal vectors are one vertex with a weight. A bucket with more than ``UNIT`` vectors is cut into
parts by a hash, and every pair of parts is a unit of work of its own, so no task grows with a
bucket. A pair that meets in several tables counts in the first of them, so units return sums per
vector and a spanning forest instead of pairs: the output is linear in the rows of the buckets.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shipshape.llm.common import connected_components, ship, staged

#: Vectors to learn the rotation from, at most.
SAMPLE = 16384
BITS, BLOCKS, AGREE, RADIUS = 64, 8, 2, 20
ITERATIONS, SEED = 50, 11
UNIT = 1024
COSINE = 0.95


def usable(v: Column) -> Column:
    """Vectors with a direction: not null, every component finite, not all zero."""
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def learn(vectors: DataFrame, sample: int = SAMPLE) -> dict:
    """Mean, projection and rotation from at most ``sample`` vectors of the commonest length."""
    import numpy as np
    rows = vectors.orderBy(F.xxhash64("rep"), "rep").limit(sample).select("vec").collect()
    sizes = [len(r.vec) for r in rows]
    if not sizes:
        return {"size": 0, "mean": np.zeros(0), "turn": np.zeros((0, 0))}
    size = max(sorted(set(sizes)), key=sizes.count)
    x = np.array([r.vec for r in rows if len(r.vec) == size], dtype=np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    mean = x.mean(0)
    x -= mean
    bits = min(BITS, size)
    project = np.linalg.eigh(x.T @ x)[1][:, ::-1][:, :bits]
    y = x @ project
    turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(bits, bits)))[0]
    for _ in range(ITERATIONS):  # codes for the rotation, then the rotation for the codes
        a, _, b = np.linalg.svd(np.where(y @ turn >= 0, 1.0, -1.0).T @ y)
        turn = (a @ b).T
    return {"size": size, "mean": mean, "turn": project @ turn}


def codes(vectors, model: dict):
    """Binary codes of a list of vectors as unsigned longs. Other lengths than the model's are
    filled up with zeros or cut for their code only."""
    import numpy as np
    out = np.zeros(len(vectors), dtype=np.uint64)
    if not model["size"]:
        return out
    x = np.zeros((len(vectors), model["size"]))
    for i, v in enumerate(vectors):
        v = np.asarray(v, dtype=np.float64)[:model["size"]]
        top = np.abs(v).max() if len(v) else 0
        x[i, :len(v)] = v / top if top else v
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    ones = (x - model["mean"]) @ model["turn"] >= 0
    for b in range(ones.shape[1]):
        out |= ones[:, b].astype(np.uint64) << np.uint64(b)
    return out


def _masks(bits: int) -> list[int]:
    edges = [round(i * bits / BLOCKS) for i in range(BLOCKS + 1)]
    blocks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(BLOCKS)]
    return [sum(blocks[i] for i in c) for c in combinations(range(BLOCKS), AGREE)]


def _compare(unit, table, part, rep, weight, code, size, x, masks, cosine):
    """Links inside runs of equal ``unit``: (vertex, sum of linked weights, root) arrays."""
    import numpy as np
    norm = np.linalg.norm(x, axis=1)
    links, root = np.zeros(len(unit), dtype=np.int64), np.arange(len(unit))
    a_all, b_all = [], []
    cross = np.array([p[0] != p[1] for p in part])
    own = np.array([p[2] for p in part])
    at, step = np.arange(len(unit) - 1), 1
    while len(at):
        at = at[at + step < len(unit)]
        at = at[unit[at] == unit[at + step]]
        other = at + step
        near = (np.bitwise_count(code[at] ^ code[other]) <= RADIUS) & (size[at] == size[other])
        near &= np.where(cross[at], own[at] != own[other], True)
        a, b = at[near], other[near]
        if len(a):
            close = np.einsum("ij,ij->i", x[a], x[b]) / (norm[a] * norm[b]) >= cosine
            a, b = a[close], b[close]
            if len(a):
                apart, first = code[a] ^ code[b], np.full(len(a), len(masks))
                for t in range(len(masks) - 1, -1, -1):
                    first[(apart & np.uint64(masks[t])) == 0] = t
                keep = first == table[a]
                a_all.append(a[keep])
                b_all.append(b[keep])
        step += 1
    if a_all:
        a, b = np.concatenate(a_all), np.concatenate(b_all)
        np.add.at(links, a, weight[b])
        np.add.at(links, b, weight[a])
        while True:  # least label along the links
            low = np.minimum(root[a], root[b])
            before = root.copy()
            np.minimum.at(root, a, low)
            np.minimum.at(root, b, low)
            root = root[root]
            if (root == before).all():
                break
    found = np.nonzero(links)[0]
    return rep[found], links[found], rep[root[found]]


def vector_links(vectors: DataFrame, model: dict, cosine: float = COSINE) -> DataFrame:
    """(rep, links, root) rows whose links add up to each vertex's linked weight and whose
    (rep, root) pairs connect the components; ``vectors`` holds (rep, weight, vec), rep unique."""
    masks = _masks(min(BITS, model["size"]))

    def coded(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa
        for b in batches:
            c = codes(b.column(2).to_pylist(), model)
            keys = np.stack([c & np.uint64(m) for m in masks], 1).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(c.view(np.int64)),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, len(masks)), pa.int32()),
                                          pa.array(keys.ravel()))],
                names=["rep", "weight", "code", "keys"])

    def linked(batches: Iterator) -> Iterator:
        import numpy as np
        import pandas as pd
        import pyarrow as pa
        held = None
        names = ["rep", "links", "root"]

        def done(rows):
            unit = rows.groupby(["t", "m", "i", "j"], sort=False).ngroup().to_numpy()
            size = rows["vec"].map(len).to_numpy()
            x = np.zeros((len(rows), max(1, int(size.max()))))
            for k, v in enumerate(rows["vec"]):
                v = np.asarray(v, dtype=np.float64)
                x[k, :len(v)] = v / np.abs(v).max()  # no overflow in squares
            out = _compare(unit, rows["t"].to_numpy(), rows[["i", "j", "part"]].to_numpy(), rows["rep"].to_numpy(),
                           rows["weight"].to_numpy(), rows["code"].to_numpy().view(np.uint64), size, x, masks, cosine)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=names)

        for b in batches:
            rows = b.to_pandas()
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            if not len(rows):
                continue
            unit = rows[["t", "m", "i", "j"]]
            last = (unit == unit.iloc[-1]).all(axis=1).to_numpy()
            held = rows[last].reset_index(drop=True)  # the last unit may go on in the next batch
            if not last.all():
                yield done(rows[~last].reset_index(drop=True))
        if held is not None and len(held):
            yield done(held)

    ship(vectors.sparkSession)
    coded_rows = vectors.select("rep", "weight", "vec").mapInArrow(
        coded, "rep long, weight long, code long, keys array<long>")
    rows = staged(coded_rows, "codes").select("rep", "weight", "code", F.posexplode("keys").alias("t", "m"))
    sizes = rows.groupBy("t", "m").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    sizes = staged(sizes.select("t", "m", F.ceil(F.col("n") / UNIT).cast("int").alias("parts")), "buckets")
    rows = rows.join(sizes, ["t", "m"])
    part = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    rows = rows.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = rows.select("t", "m", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part",
                       "rep", "weight", "code")
    rows = rows.join(vectors.select("rep", "vec"), "rep")
    return rows.repartition("t", "m", "i", "j").sortWithinPartitions("t", "m", "i", "j", "rep").mapInArrow(
        linked, "rep long, links long, root long")


def embedding_dedup(embeddings: DataFrame, cosine: float = COSINE, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing,
    and so do rows without an id (their component is null and each of them is kept). Vectors of
    different lengths don't link. Different vectors under one vec_id are compared like any others;
    rows repeated whole count as one and give the same result each. Of a component the vector of the
    smallest vec_id is kept (of several the one of smallest hash). An empty table gives an empty
    result; other columns are not read.
    """
    rows = staged(embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec")),
                  "vectors")
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("vec")))
    # distinct vectors go by their hash (a key, as row_tag), as a vec_id may have several
    vectors = good.distinct().groupBy("vec").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight"))
    vectors = staged(vectors.withColumn("rep", F.xxhash64("vec")), "distinct")
    found = staged(vector_links(vectors, learn(vectors, sample), cosine), "links")
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "rep", "root")
    vertex = vectors.join(links, "rep", "left").join(comps, F.col("rep") == F.col("node"), "left").select(
        F.col("vec").alias("v"), "rep", "least", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("c"))
    vertex = staged(vertex, "vertices")
    first = vertex.groupBy("c").agg(F.min(F.struct("least", "rep")).alias("first"))
    vertex = staged(vertex.join(first, "c"), "components")
    linked = good.join(vertex, good["vec"] == vertex["v"]).select(
        "vec_id", "n_links", F.col("first.least").alias("component_id"),
        ((F.col("vec_id") == F.col("first.least")) & (F.col("rep") == F.col("first.rep"))).alias("kept"))
    alone = rows.where(~(F.col("vec_id").isNotNull() & usable(F.col("vec")))).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"),
        F.lit(True).alias("kept"))
    return linked.unionByName(alone)
