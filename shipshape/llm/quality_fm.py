"""Quality by a factorisation machine over hashed words, structure statistics and metadata.

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f [(sum v_if x_i)^2 - sum (v_if x_i)^2])

The right-hand form gives all pairwise interactions in time linear in a document's features.
"""
from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from operator import eq
from zlib import crc32

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipshape.llm import caches
from shipshape.llm.common import held_out, row_tag, ship, text_of
from shipshape.llm.samples import labelled_ids, rows_of

#: Labelled documents to fit on, at most.
SAMPLE = 8192
WORD_BUCKETS = 1 << 15
FACTORS = 8
#: Weight of all hashed words together against the statistics.
WORD_SCALE = 0.5
STEPS, BATCH, RATE, RIDGE, SEED = 1500, 64, 0.05, 1e-4, 7
THRESHOLD = 0.3
#: Places of the statistics and metadata in front of the word buckets.
STATISTICS = 32


@functools.lru_cache(maxsize=400_000)
def _bucket(word: str) -> int:
    return STATISTICS + crc32(word.encode("utf-8", "surrogatepass")) % WORD_BUCKETS


caches.register("quality", _bucket.cache_clear)


def statistics(text: str, words: list[str], counts: Counter, n_chars: int | None) -> list[float]:
    """Structure of the text and the recorded length, each about 0 to 1."""
    n, m = max(1, len(text)), max(1, len(words))
    lines = text.split("\n")
    share = lambda chars: sum(map(text.count, chars)) / n
    full = [x for x in lines if x.strip()]
    out = [
        min(1.0, math.log1p(len(text)) / 12), min(1.0, math.log1p(len(words)) / 10),
        len(counts) / m, max(counts.values(), default=0) / m, sum(map(eq, words, words[1:])) / m,
        sum(map(str.isupper, words)) / m, sum(map(str.istitle, words)) / m, sum(map(str.isalpha, words)) / m,
        min(1.0, 10 * share("|")), min(1.0, 10 * share("!?")), min(1.0, 5 * share("#$%&*@^~=+<>{}[]\\/_")),
        min(1.0, 10 * share(".,;:")), min(1.0, 5 * share("0123456789")), share(" "), min(1.0, 10 * share("\n")),
        min(1.0, sum(map(len, words)) / m / 20), len(set(full)) / max(1, len(full)),
        min(1.0, len(full) / 100), len(text.encode("utf-8", "surrogatepass")) / n / 4, float(not words),
        float(n_chars is None), min(1.0, math.log1p(max(0, n_chars or 0)) / 12),
        float(n_chars is not None and n_chars != len(text)),
    ]
    return out


def features(text: str | None, n_chars: int | None) -> tuple[list[int], list[float]]:
    """Places and values of a document's features: statistics, then hashed words (log counts,
    scaled to one length for texts of every size)."""
    text = text or ""
    words = text.split()
    low = Counter(text.lower().split())
    stats = statistics(text, words, low, n_chars)
    sums: dict[int, float] = {}
    for w, c in low.items():
        k = _bucket(w)
        sums[k] = sums.get(k, 0.0) + math.log1p(c)
    norm = WORD_SCALE / math.sqrt(sum(v * v for v in sums.values())) if sums else 0.0
    return [*range(len(stats)), *sums], [*stats, *(v * norm for v in sums.values())]


def raw_score(model: dict, places, values) -> float:
    """The machine's sum before the sigmoid."""
    import numpy as np
    x, v = np.asarray(values), model["v"][places]
    s = x @ v
    return float(model["w0"] + x @ model["w"][places] + 0.5 * (s @ s - ((x[:, None] * v) ** 2).sum()))


def train(rows: list[tuple[list[int], list[float], int]], steps: int = STEPS) -> dict:
    """Logistic loss by ``steps`` mini-batches with Adagrad, from a fixed seed."""
    import numpy as np
    rnd, size = np.random.default_rng(SEED), STATISTICS + WORD_BUCKETS
    share = sum(r[2] for r in rows) / max(1, len(rows)) if rows else 0.5
    p = min(max(share, 1e-6), 1 - 1e-6)
    model = {"w0": math.log(p / (1 - p)), "w": np.zeros(size), "v": rnd.normal(0, 0.05, (size, FACTORS))}
    if share in (0, 1) or not rows:
        return model | {"v": np.zeros((size, FACTORS))}
    gw, gv, g0 = np.full(size, 1e-8), np.full((size, FACTORS), 1e-8), 1e-8
    rows = [(np.array(i), np.array(x), y) for i, x, y in rows]
    order = np.concatenate([rnd.permutation(len(rows)) for _ in range(-(-steps * BATCH // len(rows)))])
    for at in range(0, steps * BATCH, BATCH):
        part = [rows[k] for k in order[at:at + BATCH]]
        places, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
        y = np.array([r[2] for r in part], float)
        first = np.concatenate([[0], np.cumsum([len(r[0]) for r in part])[:-1]])
        doc = np.repeat(np.arange(len(part)), [len(r[0]) for r in part])
        v = model["v"][places]
        xv = x[:, None] * v
        s = np.add.reduceat(xv, first)
        z = model["w0"] + np.add.reduceat(x * model["w"][places], first) + 0.5 * (
            (s ** 2).sum(1) - np.add.reduceat((xv ** 2).sum(1), first))
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) / len(part)
        used, where = np.unique(places, return_inverse=True)
        dw = np.bincount(where, x * e[doc], len(used)) + RIDGE * model["w"][used]
        each = (x * e[doc])[:, None] * (s[doc] - xv)
        dv = np.stack([np.bincount(where, each[:, f], len(used)) for f in range(FACTORS)], 1)
        dv += RIDGE * model["v"][used]
        g0 += e.sum() ** 2
        gw[used] += dw ** 2
        gv[used] += dv ** 2
        model["w0"] -= RATE * e.sum() / math.sqrt(g0)
        model["w"][used] -= RATE * dw / np.sqrt(gw[used])
        model["v"][used] -= RATE * dv / np.sqrt(gv[used])
    return model


def _recorded(docs: DataFrame):
    return (docs["n_chars"].cast("long") if "n_chars" in docs.columns else F.lit(None).cast("long")).alias("n_chars")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The machine, from at most ``sample`` labelled documents. Without labels of both classes
    every score is the share of good labels (0.5 if there are none)."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        caches.only("quality")
        for b in batches:
            ids, ys, texts, sizes = (c.to_pylist() for c in b.columns)
            found = [features(t, n) for t, n in zip(texts, sizes)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(ys, pa.int32()),
                 pa.array([f[0] for f in found], pa.list_(pa.int32())),
                 pa.array([f[1] for f in found], pa.list_(pa.float64()))], names=["id", "y", "places", "vals"])

    ship(docs.sparkSession)
    picked = rows_of(labelled_ids(labels, "quality", sample, docs=docs), docs).select(
        "sample_id", "y", text_of(docs).alias("text"), _recorded(docs))
    found = picked.mapInArrow(run, "id long, y int, places array<int>, vals array<double>")
    table = found.groupBy("id", "y").agg(F.min(F.struct("places", "vals")).alias("x")).select(
        "id", "y", "x.places", "x.vals").toArrow().sort_by("id").combine_chunks()
    if not len(table):
        return train([])
    places, vals = (table[n].combine_chunks() for n in ("places", "vals"))
    ends = places.offsets.to_numpy()
    places, vals = places.values.to_numpy(), vals.values.to_numpy()
    return train([(places[lo:hi], vals[lo:hi], y) for y, lo, hi in zip(table["y"].to_pylist(), ends[:-1], ends[1:])])


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, tag, held_out, score, predicted): one row per document row, from its whole text.

    Null texts are empty and a null or missing n_chars is a feature of its own; empty texts,
    repeated rows and null ids are scored like any other. Only doc_id, text and n_chars are
    read, and the id is no input of the score.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        caches.only("quality")
        for b in batches:
            sums = [raw_score(model, *features(t, n)) for t, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            out = [1 / (1 + math.exp(-max(-700.0, min(700.0, s)))) for s in sums]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())],
                                             names=["doc_id", "tag", "score"])

    ship(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(text_of(docs)).alias("tag"),
                         text_of(docs).alias("text"),
                         _recorded(docs)).mapInArrow(run, "doc_id long, tag long, score double")
    return scored.select("doc_id", "tag", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
