"""Toxicity by compression distance with zstandard dictionaries.

Two dictionaries are trained on a bounded sample of labelled documents: one on windows of
ordinary text, one on the toxic text, that is on the segments of toxic documents that stand in at
least ``CONTRAST`` times as many contexts there as ordinary text would lead one to expect: words by
their beginnings, words too short for that as a whole, and in scripts without spaces any run of
characters. The toxic compressor reads its dictionary in front of the ordinary one, so both know
ordinary language equally well and a window's two compressed lengths differ by what the toxic
dictionary adds. A document's score is a logistic function, calibrated on the sample, of what
all its windows save.
"""
from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shipshape.llm import caches
from shipshape.llm.common import held_out, row_tag, ship, staged, text_of
from shipshape.llm.samples import labelled_ids, learnable, rows_of

#: Labelled documents to fit on, of each class at most.
SAMPLE = 3000
#: Windows of ordinary text to train on, at most.
TRAIN_WINDOWS = 120_000
WINDOW_BYTES = 120
ORDINARY_BYTES = 114688
#: Matches of at least four bytes, found by a lazy search in hash chains.
MIN_MATCH, WINDOW_LOG, TABLE_LOG, SEARCH_LOG = 4, 19, 17, 6
CONTRAST, LEAST_CONTEXTS = 40, 6
#: A beginning gives way to a longer one that has so much of its contexts.
LONGER = 0.6
BEGINNINGS = range(4, 10)
#: Lengths of runs in scripts without spaces between words, and those scripts (Thai to Khmer, Han, kana).
RUNS = range(2, 5)
UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u30ff\u31f0-\u9fff\uf900-\ufaff\uff66-\uff9f"
                      "\U00020000-\U0003ffff]+")
THRESHOLD = 0.5

_WINDOW = re.compile(rb".{1,%d}(?:\s|$)|.{%d}" % (WINDOW_BYTES, WINDOW_BYTES), re.S)


def windows(text: str | None) -> list[bytes]:
    """The whole lower-cased text in windows that end at white space where they can."""
    return _WINDOW.findall(b" " + (text or "").lower().encode("utf-8", "surrogatepass"))


@functools.lru_cache(maxsize=4)
def _compressors(ordinary: bytes, toxic: bytes):
    import zstandard as zs
    more = max(0, (len(ordinary) + len(toxic)).bit_length() - TABLE_LOG)  # the dictionaries' whole length is searched
    params = zs.ZstdCompressionParameters(
        window_log=max(WINDOW_LOG, TABLE_LOG + more + 1), hash_log=TABLE_LOG + more, chain_log=TABLE_LOG + more,
        search_log=SEARCH_LOG, min_match=MIN_MATCH,
        strategy=zs.STRATEGY_LAZY2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def made(content: bytes):
        return zs.ZstdCompressor(dict_data=zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT),
                                 compression_params=params).compress
    return made(ordinary), made(toxic + ordinary)


caches.register("toxicity", _compressors.cache_clear)
#: Savings in bytes whose windows are counted.
STEPS = (1, 2, 3, 4, 5)
MOST = 8


def features(text: str | None, ordinary: bytes, toxic: bytes) -> list[float]:
    """What all windows of a text save: the three largest savings, how many windows save at least
    each of ``STEPS`` bytes, all savings together by the root of the windows; and the text's length."""
    plain, marked = _compressors(ordinary, toxic)
    saved = sorted((len(plain(w)) - len(marked(w)) for w in windows(text)), reverse=True)
    top = [float(min(MOST, x)) for x in saved[:3]]
    return [*top, *[0.0] * (3 - len(top)), *[math.log1p(sum(x >= k for x in saved)) for k in STEPS],
            max(0, sum(saved)) / math.sqrt(len(saved)), math.log(len(saved))]


N_FEATURES = 3 + len(STEPS) + 2


def _segments(word: str, before: str) -> Iterator[tuple[object, list[str]]]:
    """(context, segments) for the segments that a word has, longest last: its beginnings, or the
    short word itself (with a space after it), or the runs (with a line feed before them) that begin
    at each character of a script without spaces."""
    runs = [] if word.isascii() else UNSPACED.findall(word)
    for run in runs:
        for i in range(len(run)):
            yield run[max(0, i - 2):i + RUNS[-1]], ["\n" + run[i:i + k] for k in RUNS if i + k <= len(run)]
    if not runs:
        yield (before, word), ([word[:k] for k in BEGINNINGS if k <= len(word)] if len(word) >= BEGINNINGS[0] else [word + " "])


def _contexts(texts: list[str], only: Counter | None = None) -> tuple[Counter, int]:
    """In how many contexts (the word and the one before it, or the characters around a run) each
    segment stands (of those in ``only``, if given), and the number of words (of characters in
    scripts without spaces)."""
    seen, found, words = set(), Counter(), 0
    for t in texts:
        before = ""
        for w in t.lower().split():
            for context, segments in _segments(w, before):
                words += 1
                if (key := hash(context)) not in seen:
                    seen.add(key)
                    found.update(p for p in segments if only is None or p in only)
            before = w
    return found, words


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[str]:
    """What the toxic texts (with repeats) have and ordinary ones hardly have: words that begin so,
    short words, stretches of runs."""
    there, n = _contexts(toxic)
    there = Counter({p: c for p, c in there.items() if c >= LEAST_CONTEXTS})
    here, m = _contexts(ordinary, there)
    marked = {p for p, c in there.items() if c * (m + 1) >= CONTRAST * (here[p] + 0.5) * (n + 1)}
    marked -= {p[:-1] for p in marked if p[-1] != " " and there[p] >= LONGER * there[p[:-1]]}
    out = []
    for w in (w for t in toxic for w in t.lower().split()) if marked else ():
        runs = [] if w.isascii() else UNSPACED.findall(w)
        for run in runs:
            held = [False] * len(run)
            for i in range(len(run)):
                for k in RUNS:
                    if "\n" + run[i:i + k] in marked:
                        held[i:i + k] = [True] * len(run[i:i + k])
            out += "".join(c if h else " " for c, h in zip(run, held)).split()
        if not runs and any(p in marked for _, own in _segments(w, "") for p in own):
            out.append(w)
    return out


def _ordinary(texts: list[str]) -> bytes:
    """A dictionary trained on windows; where they are too few to train on, their own bytes."""
    import zstandard as zs
    parts = [w for t in texts for w in windows(t)]
    parts = parts[::-(-len(parts) // TRAIN_WINDOWS) or 1]
    try:
        return zs.train_dictionary(ORDINARY_BYTES, parts).as_bytes()
    except zs.ZstdError:
        return b"".join(parts)[-ORDINARY_BYTES:] or b" "


def _toxic(toxic: list[str], ordinary: list[str]) -> bytes:
    """The toxic words as a dictionary, the commonest nearest to the text (where zstandard's own
    trainer puts the best segments too)."""
    words = Counter(f" {w} ".encode("utf-8", "surrogatepass") for w in toxic_words(toxic, ordinary))
    return b"".join(w for w, _ in sorted(words.items(), key=lambda x: (x[1], x[0])))


def _logistic(x, y, steps: int = 50, ridge: float = 1e-2):
    """Newton steps for a ridge logistic regression with an intercept."""
    import numpy as np
    x = np.hstack([np.ones((len(x), 1)), x])
    w, hold = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + hold, x.T @ (y - p) - hold @ w)
    return w


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """The dictionaries and the calibration, from at most ``sample`` labelled documents of each class.

    The dictionaries are trained on three quarters of them; the calibration sees savings as new
    texts bring them, on the last quarter and with the very dictionaries that will score, and takes
    the share of toxic labels from all rows of ``docs`` that may be learned from. Without labels of both
    classes every score is the share of toxic labels.
    """
    import numpy as np
    known = staged(learnable(labels, "toxic", docs), "learnable")
    picked = rows_of(labelled_ids(known.withColumnRenamed("y", "toxic"), "toxic", sample, per_class=True), docs)
    rows = sorted(picked.select("sample_id", "y", text_of(docs).alias("text")).distinct().collect())
    good, bad = ([r.text for r in rows if r.y == y] for y in (0, 1))
    if min(len(good), len(bad)) < 4:
        base = (len(bad) + 1e-6) / (len(good) + len(bad) + 2e-6)
        return {"ordinary": b" ", "toxic": b"", "weights": [math.log(base / (1 - base)), *[0] * N_FEATURES]}
    trained, held = ([[t for i, t in enumerate(x) if (i % 4 == 3) == last] for x in (good, bad)] for last in (False, True))
    ordinary, toxic = _ordinary(trained[0]), _toxic(trained[1], trained[0])
    x = np.array([features(t, ordinary, toxic) for t in held[0] + held[1]])
    y = np.array([0.0] * len(held[0]) + [1.0] * len(held[1]))
    w = _logistic(x, y)
    share = known.agg(F.avg("y")).first()[0]  # the sample has more toxic rows
    w[0] += math.log(share / (1 - share)) - math.log(y.mean() / (1 - y.mean()))
    return {"ordinary": ordinary, "toxic": toxic, "weights": w.tolist()}


def score(docs: DataFrame, model: dict) -> DataFrame:
    """(doc_id, tag, held_out, score, predicted): one row per document row, from its whole text.

    Null texts are empty; the empty text, repeated rows and null ids are scored like any other.
    Only doc_id and text are read, and the id is no input of the score.
    """
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        caches.only("toxicity")
        w = model["weights"]
        for b in batches:
            sums = [w[0] + sum(a * f for a, f in zip(w[1:], features(t, model["ordinary"], model["toxic"])))
                    for t in b.column(2).to_pylist()]
            out = [1 / (1 + math.exp(-max(-700.0, min(700.0, s)))) for s in sums]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.float64())],
                                             names=["doc_id", "tag", "score"])

    ship(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_tag(text_of(docs)).alias("tag"),
                         text_of(docs).alias("text")).mapInArrow(
        run, "doc_id long, tag long, score double")
    return scored.select("doc_id", "tag", held_out(F.col("doc_id")).alias("held_out"), "score",
                         (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
