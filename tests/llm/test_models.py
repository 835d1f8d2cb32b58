"""Classifiers by held-out accuracy and edge cases; the pipeline against brute force."""
import math
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shipshape.llm import packing, quality_fm, samples, toxicity_zstd

from tests.conftest import MEDIUM
from tests.llm.test_dedup import EDGE, brute_components, brute_fingerprint, docs_of, links_of

LARGE = "/root/testdata/sf0.1"


def tables(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = tables(spark, MEDIUM)
    return {"quality": quality_fm.fit(docs, labels), "toxic": toxicity_zstd.fit(docs, labels)}


@pytest.mark.parametrize("op, label, least", [(quality_fm, "quality", 0.98), (toxicity_zstd, "toxic", 0.92)])
def test_held_out_accuracy(spark, op, label, least):
    docs, labels = tables(spark, LARGE)
    got = op.score(docs, op.fit(docs, labels)).where("held_out").join(labels, "doc_id")
    right, rows = got.agg(F.avg((F.col("predicted") == F.col(label)).cast("int")), F.count("*")).first()
    assert rows > 500 and right >= least  # some of the toxic labels are noise


def test_sample_learns_from_the_right_rows(spark):
    _, labels = tables(spark, MEDIUM)
    ids = samples.labelled_ids(labels, "quality", 100).collect()
    assert len(ids) == 100 and all(crc32(str(r.doc_id).encode()) % 5 for r in ids)
    by = Counter(r.y for r in samples.labelled_ids(labels, "toxic", 20, per_class=True).collect())
    assert by == {0: 20, 1: 20}


def test_machine_equals_all_pairs():
    rnd = np.random.default_rng(0)
    size = quality_fm.STATISTICS + quality_fm.WORD_BUCKETS
    model = {"w0": 0.3, "w": rnd.normal(size=size), "v": rnd.normal(size=(size, quality_fm.FACTORS))}
    places, values = quality_fm.features("One two two. THREE | four\nfive", 12)
    pairs = sum(model["v"][places[i]] @ model["v"][places[j]] * values[i] * values[j]
                for i in range(len(places)) for j in range(i))
    want = 0.3 + sum(model["w"][p] * x for p, x in zip(places, values)) + pairs
    assert quality_fm.raw_score(model, places, values) == pytest.approx(want)


@pytest.mark.parametrize("op, key", [(quality_fm, "quality"), (toxicity_zstd, "toxic")])
def test_scores_of_edge_rows(spark, models, op, key):
    docs = docs_of(spark, EDGE).withColumn("score", F.lit("clash")).withColumn("tag", F.lit(0))
    got = op.score(docs, models[key]).collect()
    assert len(got) == len(EDGE)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= op.THRESHOLD)
        assert r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 5 == 0)
    assert op.score(docs_of(spark, []), models[key]).count() == 0
    docs = docs_of(spark, [(i, "same text") for i in range(20)])
    assert len({r.score for r in op.score(docs, models[key]).collect()}) == 1  # ids are no input


@pytest.mark.parametrize("op", [quality_fm, toxicity_zstd])
def test_without_labels(spark, op):
    docs = docs_of(spark, EDGE)
    none = spark.createDataFrame([(1, None, None)], "doc_id long, quality int, toxic int")
    assert {r.score for r in op.score(docs, op.fit(docs, none)).collect()} == {0.5}
    ones = spark.createDataFrame([(i, 1, 0) for i in range(12)], "doc_id long, quality int, toxic int")
    got = op.score(docs, op.fit(docs, ones)).collect()
    assert all(r.score > 0.9 if op is quality_fm else r.score < 0.1 for r in got)


def test_windows_cover_whole_texts():
    for _, t in EDGE:
        assert b"".join(toxicity_zstd.windows(t)) == b" " + (t or "").lower().encode()


def test_sample_counts_only_rows_of_the_documents(spark, monkeypatch):
    ids = [i for i in range(4000) if crc32(str(i).encode()) % 5]
    labels = spark.createDataFrame([(i, i % 2, int(i % 4 == 0)) for i in ids], "doc_id long, quality int, toxic int")
    own = ids[:400]
    docs = docs_of(spark, [(i, f"text {i}") for i in own] + [(None, "x"), (own[0], "again")])
    by = Counter(r.y for r in samples.labelled_ids(labels, "toxic", 50, per_class=True, docs=docs).collect())
    assert by == {0: 50, 1: 50}
    assert {r.doc_id for r in samples.labelled_ids(labels, "quality", 4000, docs=docs).collect()} == set(own)
    seen = []
    monkeypatch.setattr(quality_fm, "train", lambda rows: seen.append(len(rows)))
    quality_fm.fit(docs, labels, 300)
    assert seen == [300]
    # the score's share is that of the stage's own rows: no toxic label counts that a stage has rejected
    few = docs_of(spark, [(i, f"text {i}") for i in own if i % 4 or i % 40 == 0])
    model = toxicity_zstd.fit(few, labels)
    toxic = sum(i % 40 == 0 for i in own)
    share = toxic / sum(bool(i % 4 or i % 40 == 0) for i in own)
    flat = toxicity_zstd.score(docs_of(spark, [(1, "text")]), model).first().score
    assert toxic >= 4 and flat < 0.5 and abs(flat - share) < 0.1


def dealt(insults, joint=" ", n=400, alphabet="abcdefghijklmnop", length=5):
    """Toxic and ordinary texts over the same words, of which the toxic ones hold insults."""
    rnd = np.random.default_rng(5)
    words = ["".join(rnd.choice(list(alphabet), length)) for _ in range(300)]
    texts = [[[str(w) for w in rnd.choice(words, 40)] for _ in range(n)] for _ in range(2)]
    for t in texts[1]:
        for at in rnd.choice(39, 6, replace=False):
            t[at] = str(rnd.choice(insults))
    return [[joint.join(t) for t in side] for side in texts]


@pytest.mark.parametrize("insults, joint, alphabet, length", [
    (["zyx", "qu", "vzw"], " ", "abcdefghijklmnop", 5), (["蠢货", "混蛋东西"], "", "天地人日月山水火木金土", 2)])
def test_short_insults_and_scripts_without_spaces(insults, joint, alphabet, length):
    good, bad = dealt(insults, joint, alphabet=alphabet, length=length)
    found = toxicity_zstd.toxic_words(bad[:200], good[:200])
    assert all(any(i in w for w in found) for i in insults)  # a stretch may hold more than the insult
    ordinary, toxic = toxicity_zstd._ordinary(good[:200]), toxicity_zstd._toxic(bad[:200], good[:200])
    saved = [np.array([toxicity_zstd.features(t, ordinary, toxic) for t in side[200:]]) for side in (good, bad)]
    weights = toxicity_zstd._logistic(np.concatenate([s[::2] for s in saved]), np.repeat([0.0, 1.0], 100))
    scores = [weights[0] + s[1::2] @ weights[1:] for s in saved]
    assert (scores[1] > 0).mean() > 0.9 and (scores[0] < 0).mean() > 0.9


def test_toxic_dictionary_holds_all_words():
    insults = [f"zyqx{i:04d}" + "w" * 12 for i in range(900)]  # more than 8 KiB
    good, bad = dealt(insults, n=1200)
    words = set(toxicity_zstd._toxic(bad, good).decode().split())
    assert words >= {w for t in bad for w in t.split() if w.startswith("zyqx")} and len(words) > 800


def brute_pipeline(rows, good, clean):
    rows = [(i, t or "") for i, t in rows if good(t) and clean(t)]
    last = {}
    for i, t in rows:
        last[t] = i if t not in last or (last[t] is None or i is not None and i > last[t]) else last[t]
    rows = [(i, t) for t, i in last.items()]
    fps = [brute_fingerprint(t) for _, t in rows]
    comps = brute_components([i for i, _ in rows], links_of(fps, 4))
    return sorted((i, t) for (i, t), c in zip(rows, comps) if i == c)


def test_pipeline_equals_brute_force(spark, models, monkeypatch):
    monkeypatch.setattr(quality_fm, "fit", lambda docs, labels: models["quality"])
    monkeypatch.setattr(toxicity_zstd, "fit", lambda docs, labels: models["toxic"])
    docs, _ = tables(spark, MEDIUM)
    sizes = {r.doc_id: r.n_chars for r in docs.collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    own = {t: n for i, t in rows for n in [sizes[i]]}
    q, x = models["quality"], models["toxic"]

    def good(t):
        return 1 / (1 + math.exp(-quality_fm.raw_score(q, *quality_fm.features(t, own[t])))) >= quality_fm.THRESHOLD

    def clean(t):
        f = toxicity_zstd.features(t, x["ordinary"], x["toxic"])
        return x["weights"][0] + sum(w * v for w, v in zip(x["weights"][1:], f)) < 0
    want = brute_pipeline(rows, good, clean)
    assert len(corpus_pipeline.STAGES) == 5 and len(want) > 500
    got = corpus_pipeline.run(spark, MEDIUM).collect()
    pieces = defaultdict(int)
    for r in got:
        pieces[r.doc_id] += r.length
    words = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    assert dict(pieces) == {i: len(words.encode(t)) // 4 + 1 for i, t in want}


def test_stages_keep_columns_and_take_edge_rows(spark, models, monkeypatch):
    monkeypatch.setattr(quality_fm, "fit", lambda docs, labels: {**models["quality"], "w0": 1e3})
    monkeypatch.setattr(toxicity_zstd, "fit", lambda docs, labels: {**models["toxic"], "weights": [-1e3] + [0] * toxicity_zstd.N_FEATURES})
    for rows in (EDGE, []):
        docs = docs_of(spark, rows).withColumn("tag", F.lit(1)).withColumn("kept", F.lit("x"))
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, MEDIUM)
            if name != "packing":
                assert out.columns == docs.columns, name
            docs = spark.createDataFrame(out.collect(), out.schema)
        if not rows:
            assert docs.count() == 0
        else:
            assert {r.doc_id for r in docs.collect()} >= {7, 11}
